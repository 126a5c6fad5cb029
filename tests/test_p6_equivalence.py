"""The (seller|category, order) pre-aggregate equals the literal form:
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.catalog import clean
from agora.functions.metrics import pct, round_half_up
from agora.operators import category, seller
from tests.conftest import SF_ORACLE


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_seller_metrics_equal_literal_distinct_form(spark):
    t = clean(spark, SF_ORACLE)
    o = t.orders.filter((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull())
    joined = t.order_items.join(o, "order_id").join(category.order_reviews(t.reviews), "order_id", "left")
    late_id = F.when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), F.col("order_id"))
    literal = joined.groupBy("seller_id").agg(
        F.count_distinct("order_id").alias("order_volume"),
        round_half_up(F.avg("review_score"), 2).alias("avg_review_score"),
        pct(F.count_distinct(late_id), F.count_distinct("order_id"), 1).alias("late_pct"),
    )
    cols = ["seller_id", "order_volume", "avg_review_score", "late_pct"]
    assert _rows(seller.seller_metrics(t), cols) == _rows(literal, cols)


def test_category_metrics_equal_literal_distinct_form(spark):
    t = clean(spark, SF_ORACLE)
    delivered = t.orders.filter(F.col("order_status") == "delivered").select("order_id")
    joined = (
        category.category_items(t, "price", "freight_value")
        .join(delivered, "order_id")
        .join(category.order_reviews(t.reviews), "order_id", "left")
    )
    literal = joined.groupBy("category").agg(
        F.count_distinct("order_id").alias("order_volume"),
        round_half_up(F.avg("review_score"), 2).alias("avg_review_score"),
        F.count_if(F.col("review_score").between(1, 3)).alias("low_reviews"),
        F.count_if(F.col("review_score").between(4, 5)).alias("high_reviews"),
    )
    cols = ["category", "order_volume", "avg_review_score", "low_reviews", "high_reviews"]
    ours = category.category_performance(t, min_orders=0, limit=1000)
    assert _rows(ours, cols) == _rows(literal, cols)
