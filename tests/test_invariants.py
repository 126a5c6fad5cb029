
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from agora.catalog import clean
from agora.operators import cleaning
from tests.conftest import SF_ORACLE

Q = entry.queries()


@pytest.fixture(scope="module")
def run(spark):
    return lambda key: Q[key](spark, SF_ORACLE).collect()


def test_status_shares_at_most_100(run):
    r = run("order_status_mix")[0]
    assert sum(r) <= 100.0 + 0.02


def test_late_plus_on_time_at_most_100(run):
    r = run("on_time_rate")[0]
    assert r["late_pct"] + r["on_time_pct"] <= 100.0 + 0.1


def test_state_shares(run):
    rows = run("revenue_by_state")
    assert max(r["cumulative_pct"] for r in rows) == 100.0
    assert abs(sum(r["pct_of_total"] for r in rows) - 100.0) <= 0.01 * len(rows)


def test_one_time_plus_repeat_is_100(run):
    r = run("repeat_customers")[0]
    assert round(r["one_time_pct"] + r["repeat_pct"], 1) == 100.0


def test_risk_sellers_are_scorecard_sellers(run):
    scorecard = {r["seller_id"] for r in run("seller_scorecard")}
    risky = {r["seller_id"] for r in run("seller_risk")}
    assert risky and risky <= scorecard
    assert {r["seller_flag"] for r in run("seller_risk")} == {"At Risk", "High Risk"}


def test_collapsed_payments_one_row_per_order(spark):
    t = clean(spark, SF_ORACLE)
    assert t.payments.count() == t.payment_legs.select("order_id").distinct().count()


def test_flat_table_keeps_every_order(spark):
    t = clean(spark, SF_ORACLE)
    flat = cleaning.flat_orders(t)
    assert flat.select("order_id").distinct().count() == t.orders.count()
    assert flat.filter(F.col("order_id").isNull()).count() == 0
