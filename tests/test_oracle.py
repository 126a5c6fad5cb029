"""Every registered query equals its DuckDB oracle statement (sf0.001).

The driver runs the same comparison at sf0.01; ``tools/oracle_check.py``
runs it at any scale.
"""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from agora.catalog import QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, _rows

KEYS = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[key])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(df.columns, s_rows, False) == _rows(d_cols, d_rows, False)


def test_entry_is_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "seller_id", "order_volume", "avg_review_score", "late_pct", "seller_flag", "top_category", "items_sold",
    ]
    assert df.count() > 0


TIME_KEYS = ["monthly_trend", "delivery_time_overall", "windowed_retention", "coerce_order_dates", "on_time_rate"]


@pytest.mark.parametrize("key", TIME_KEYS)
def test_results_do_not_depend_on_session_time_zone(spark, con, key):
    # A zone with daylight-saving jumps at midnight: wall-clock timestamps
    # (timestamp_ntz) must come out the same as under UTC.
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = entry.queries()[key](spark, SF_SMALL)
        s_rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    cur = con.execute(entry.oracle_sql()[key])
    d_cols = [c[0] for c in cur.description]
    assert _rows(df.columns, s_rows, False) == _rows(d_cols, cur.fetchall(), False)
