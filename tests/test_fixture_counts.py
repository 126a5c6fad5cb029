"""The binding reproduces the counts FIXTURES.md records for sf0.001."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.catalog import clean, raw
from agora.functions.percentile import exact_percentile
from agora.operators import category, cleaning, customer, delivery, seller
from tests.conftest import SF_SMALL


def test_status_counts(spark):
    got = {r[0]: r[1] for r in raw(spark, SF_SMALL).orders.groupBy("order_status").count().collect()}
    assert got == {"canceled": 85, "delivered": 944, "invoiced": 132, "processing": 121, "shipped": 121, "unavailable": 97}


def test_invalid_delivered_and_missing_estimates(spark):
    o = raw(spark, SF_SMALL).orders
    assert cleaning.invalid_delivered(o).count() == 150
    assert o.filter(F.col("order_estimated_delivery_date").isNull()).count() == 8


def test_timeliness_buckets(spark):
    o = clean(spark, SF_SMALL).orders
    dated = o.filter((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull())
    got = {r[0]: r[1] for r in dated.groupBy(delivery.timeliness().alias("t")).count().collect()}
    assert got == {"On-time": 674, "Late": 116, None: 4}


def test_reviews(spark):
    r = raw(spark, SF_SMALL).reviews
    assert r.count() == 1416
    avg = category.order_reviews(r)
    assert avg.filter((F.col("review_score") > 3) & (F.col("review_score") < 4)).count() == 9


def test_products_cleaning(spark):
    p = raw(spark, SF_SMALL).products
    assert p.count() - cleaning.clean_products(p).count() == 5
    assert p.filter(F.col("product_category_name").isNull()).count() == 4


def test_seller_flags(spark):
    t = clean(spark, SF_SMALL)
    m = seller.seller_metrics(t).filter(F.col("order_volume") >= 100)
    flags = {r[0]: r[1] for r in m.groupBy(seller.seller_flag(3.5, 14.5).alias("f")).count().collect()}
    assert flags == {"Healthy": 5, "At Risk": 5}


def test_payment_legs(spark):
    legs = raw(spark, SF_SMALL).payments
    per_order = legs.groupBy("order_id").agg(F.count_distinct("payment_type").alias("k"))
    assert per_order.count() == 1473
    assert per_order.filter(F.col("k") > 1).count() == 1236


def test_orders_above_p75(spark):
    items = clean(spark, SF_SMALL).order_items
    totals = items.groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("v"))
    p75 = exact_percentile(totals, "v", 0.75)
    assert totals.filter(F.col("v").cast("double") > p75).count() == 368


def test_flat_rows(spark):
    t = clean(spark, SF_SMALL)
    flat = cleaning.flat_orders(t)
    assert flat.count() == 6249
    assert flat.select("order_id").distinct().count() == 1500


def test_segment_and_timeliness_reviews(spark):
    t = clean(spark, SF_SMALL)
    seg = {r["segment"]: r["late_pct"] for r in category.category_segment_check(cleaning.flat_orders(t), "brand_1").collect()}
    assert seg == {"brand_1": 12.6, "all_others": 14.5}
    q6 = {r[0]: r[1] for r in delivery.review_by_timeliness(t.orders, t.reviews).collect()}
    assert q6 == {"Late": 3.72, "On-time": 3.57, None: 4.0}


def test_retention_and_repeat(spark):
    t = clean(spark, SF_SMALL)
    total = customer.windowed_retention(t, 180).filter(F.col("cohort_month") == "ALL").first()
    assert (total["eligible_customers"], total["retained_customers"]) == (75, 57)
    everything = customer.repeat_customers(t).first()
    assert (everything["one_time_pct"], everything["total_unique_customers"]) == (0.0, 75)
    early = customer.repeat_customers(t, purchased_before="1995-05-01").first()
    assert (early["one_time_pct"], early["total_unique_customers"]) == (54.3, 46)
