"""Rules of the analysis that the generated tables don't exercise: exact
means, hot sellers and persons, repeated orders, CSV contracts, result order."""

from __future__ import annotations

import os
import tempfile
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from agora.catalog import QUERIES, clean
from agora.operators import category, cleaning, customer, overview, payment, seller
from agora.plans.inspect import plan_text
from agora.sources.readers import CsvHeaderError, corrupt_rows, read_csv_table
from agora.sources.schema import CSV_TABLES
from tests.conftest import SF_SMALL
from tests.golden import day, item, order, tables
from tests.test_skew import _data, skew_session  # noqa: F401
from tools.oracle_check import TABLES

N = 20_001


@pytest.fixture(scope="module")
def cents(spark):
    """20 001 orders whose amounts sum to 20 101.00: a mean of 1.0049997."""
    rows = spark.range(N).select(F.concat(F.lit("o"), "id").alias("order_id"), F.when(F.col("id") < 10_000, "1.01").otherwise("1.00").cast("decimal(18,2)").alias("v"), "id")
    base = tables(spark, cleaned=False)
    stamp = F.lit(day(0)).cast("timestamp_ntz")
    t = base.with_(
        orders=rows.select(
            "order_id", F.concat(F.lit("c"), "id").alias("customer_id"), F.lit("delivered").alias("order_status"), *[stamp.alias(c) for c in base.orders.columns[3:]]
        ),
        order_items=rows.select("order_id", F.lit("p1").alias("product_id"), F.lit("s1").alias("seller_id"), F.col("v").alias("price"), F.lit(0).cast("decimal(18,2)").alias("freight_value")),
        payments=rows.select("order_id", F.lit("card").alias("payment_type"), F.col("v").alias("payment_value")),
        customers=rows.select(F.concat(F.lit("c"), "id").alias("customer_id"), F.concat(F.lit("u"), "id").alias("customer_unique_id"), F.lit("x").alias("customer_city"), F.lit("ST").alias("customer_state")),
    )
    assert rows.agg(F.sum("v")).first()[0] == Decimal("20101.00")
    return cleaning.clean_tables(t)


def test_means_are_rounded_once(cents):
    assert overview.overview_totals(cents.orders, cents.payments).first()["avg_order_value"] == 1.0
    assert category.category_performance(cents).first()["revenue_per_order"] == 1.0
    assert customer.spend_per_customer_by_state(cents).first()["avg_spend_per_customer"] == 1.0
    assert payment.payment_mix(cents.payment_legs).first()["avg_order_value"] == 1.0
    assert payment.payment_mix_main_method(cents.payments).first()["avg_order_value"] == 1.0


def test_seller_risk_with_hot_seller(skew_session):  # noqa: F811
    d = _data()
    t = tables(skew_session, **d)
    df = seller.seller_risk(t, review_threshold=6, late_threshold=0.0, min_orders=1)
    got = {r["seller_id"]: (r["top_category"], r["items_sold"]) for r in df.collect()}
    names, english = {p[0]: p[1] for p in d["products"]}, dict(d["category"])
    sold = defaultdict(Counter)
    for it in d["items"]:
        sold[it[2]][english[names[it[1]]]] += 1
    assert got == {s: min(((c, n) for c, n in k.items()), key=lambda x: (-x[1], x[0])) for s, k in sold.items() if s in got}
    assert "shot" in got
    # Raw items are never shuffled by seller alone.
    physical = plan_text(seller.seller_risk(t), "simple").split("== Physical Plan ==")[-1].splitlines()
    for k, line in enumerate(physical):
        if "Exchange hashpartitioning(seller_id" in line and "product_id" not in line:
            nodes = [x.strip(" :+-*()0123456789") for x in physical[k + 1 :]]
            below = next(n for n in nodes if not n.startswith(("Filter", "Project", "Sort ")))
            # Counted rows, or the scan of the flagged sellers.
            assert below.startswith(("HashAggregate", "WindowGroupLimit", "FileScan")), below


def test_repeated_orders_count_once_for_a_seller(spark):
    t = tables(spark, orders=[order("A", delivered=5), order("A", delivered=12), order("B")], items=[item("A"), item("B")])
    r = seller.seller_metrics(t).first()
    assert (r["order_volume"], r["late_pct"]) == (2, 50.0)


def test_windowed_retention_with_hot_person(skew_session):  # noqa: F811
    d = _data()
    t = tables(skew_session, **d)
    df = customer.windowed_retention(t, days=20)
    assert plan_text(df, "simple").count("WindowGroupLimit") >= 2
    person = {c[0]: c[1] for c in d["customers"]}
    bought = defaultdict(list)
    for o in d["orders"]:
        bought[person[o[1]]].append(o[3])
    last = max(max(x) for x in bought.values())
    eligible = retained = 0
    for times in bought.values():
        first = min(times)
        if (last - first).days >= 20:
            eligible += 1
            retained += sum((x - first).total_seconds() <= 20 * 86400 for x in times) >= 2
    total = df.where("cohort_month = 'ALL'").first()
    assert (total["eligible_customers"], total["retained_customers"]) == (eligible, retained)


def test_category_filter_sits_below_the_item_join(spark):
    text = plan_text(category.bad_review_comments(clean(spark, SF_SMALL), "brand_1"), "formatted")
    assert "brand_1" in text
    physical = plan_text(category.bad_review_comments(clean(spark, SF_SMALL), "brand_1"), "simple").split("== Physical Plan ==")[-1].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    filters = [depth(x) for x in physical if "Filter" in x and "brand_1" in x]
    joins = [depth(x) for x in physical if "Join" in x and "product_id" in x]
    assert filters and joins and max(filters) > min(joins)


def _drop(files: dict[str, str]) -> str:
    base = tempfile.mkdtemp(prefix="agora-csv-rules-")
    for name, body in files.items():
        with open(os.path.join(base, name), "w", encoding="utf-8") as f:
            f.write(body)
    return base


def test_csv_columns_are_found_by_name(spark):
    base = _drop({"c.csv": "product_category_name_english,extra,product_category_name\nwatches,1,relogios\n"})
    schema = CSV_TABLES["product_category"]
    row = read_csv_table(spark, f"{base}/c.csv", schema, table="product_category").first()
    assert row.asDict() == {"product_category_name": "relogios", "product_category_name_english": "watches"}
    base = _drop({"c.csv": "product_category_name,english\nrelogios,watches\n"})
    with pytest.raises(CsvHeaderError):
        read_csv_table(spark, f"{base}/c.csv", schema, table="product_category")


PAYMENTS = """order_id,payment_sequential,payment_type,payment_installments,payment_value
a,1,card,1,5.00
b,1,card,1,R$5
c,1,card
d,1,card,1,7.25
"""


def test_unreadable_csv_rows_are_counted(spark):
    base = _drop({"payments.csv": PAYMENTS})
    schema = CSV_TABLES["payments"]
    header = ",".join(f.name for f in schema)
    assert header == PAYMENTS.split("\n", 1)[0]
    kept = read_csv_table(spark, f"{base}/payments.csv", schema, table="payments", keep_corrupt=True).collect()
    assert [r["order_id"] for r in kept if r["_corrupt_record"] is not None] == ["b", "c"]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv_table(spark, f"{base}/payments.csv", schema, table="payments", mode="FAILFAST").collect()
    for name, s in CSV_TABLES.items():
        if name != "payments":
            with open(os.path.join(base, f"{name}.csv"), "w", encoding="utf-8") as f:
                f.write(",".join(x.name for x in s) + "\n")
    counts = {r["table_name"]: (r["n_rows"], r["n_corrupt"]) for r in corrupt_rows(spark, base).collect()}
    assert counts.pop("payments") == (4, 2)
    assert set(counts.values()) == {(0, 0)}


def test_only_full_dates_are_dates(spark):
    texts = ["2018-01-02 03:04:05", "2018-01-02", "2018", "2018-01", "2018-01-02T03:04:05Z", "2018-01-02 03:04", "", "2018-13-01", None]
    df = spark.createDataFrame([(t,) for t in texts], "order_purchase_timestamp string")
    got = [None if r[0] is None else str(r[0]) for r in cleaning.coerce_order_dates(df).collect()]
    assert got == ["2018-01-02 03:04:05", "2018-01-02 00:00:00"] + [None] * 7


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


ORDERED = [
    "order_status_counts", "review_score_counts", "monthly_trend", "delivery_time_by_state", "category_performance",
    "top_categories_by_revenue", "high_value_categories", "top_sellers_by_revenue", "seller_scorecard", "seller_risk",
    "revenue_by_state", "spend_per_customer_by_state", "windowed_retention", "payment_mix", "payment_mix_main_method",
]


@pytest.mark.parametrize("key", ORDERED)
def test_rows_come_in_the_stated_order(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cur = con.execute(entry.oracle_sql()[key])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    flat = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    assert [[flat(v) for v in r] for r in df.collect()] == [[flat(r[k]) for k in at] for r in cur.fetchall()]
