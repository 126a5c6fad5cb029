"""Delivery performance: delivery time (Q4a, Q4b, Q17), on-time rate (Q5),
reviews by timeliness (Q6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions.metrics import days_between, pct, ratio, round_half_up
from agora.functions.percentile import exact_percentile

LATE, ON_TIME = "Late", "On-time"


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    )


def delivery_days() -> Column:
    return days_between("order_purchase_timestamp", "order_delivered_customer_date")


def timeliness() -> Column:
    """'Late' / 'On-time' against the estimate; NULL when there is no estimate."""
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return F.when(delivered > estimated, LATE).when(delivered <= estimated, ON_TIME)


def delivery_time_overall(orders: DataFrame) -> DataFrame:
    """Delivered orders with both dates: count, average days (2 dp) and
    the exact median (unrounded)."""
    base = _delivered(orders).filter(F.col("order_purchase_timestamp").isNotNull()).select(
        delivery_days().alias("days")
    )
    median = exact_percentile(base, "days", 0.5)
    return base.agg(
        F.count(F.lit(1)).alias("n_orders"),
        round_half_up(F.avg("days"), 2).alias("avg_delivery_days"),
    ).withColumn("median_delivery_days", F.lit(median).cast("double"))


def delivery_time_by_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Average delivery days per customer state for delivered orders not
    flagged invalid. Orders are summed per customer before the join, so a
    customer with very many orders adds one row to the join, not many."""
    per_customer = (
        orders.filter((F.col("order_status") == "delivered") & ~F.col("is_invalid_delivered"))
        .select("customer_id", delivery_days().alias("days"))
        .groupBy("customer_id")
        .agg(F.sum("days").alias("s"), F.count("days").alias("c"))
    )
    return (
        per_customer.join(customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(round_half_up(ratio(F.sum("s"), F.sum("c")), 2).alias("avg_delivery_days"))
        .orderBy(F.desc_nulls_first("avg_delivery_days"), "customer_state")
    )


def on_time_rate(orders: DataFrame) -> DataFrame:
    """Q5: late and on-time share (1 dp) of delivered, dated orders; orders
    without an estimate count in the denominator only."""
    t = timeliness()
    counts = _delivered(orders).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t == LATE).alias("late"),
        F.count_if(t == ON_TIME).alias("on_time"),
    )
    return counts.select(pct("late", "n", 1).alias("late_pct"), pct("on_time", "n", 1).alias("on_time_pct"))


def scores_by_timeliness(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review score sums per timeliness bucket over every review (an order
    with two reviews weighs twice). Reviews are summed per order first."""
    per_order = reviews.groupBy("order_id").agg(F.sum("review_score").alias("s"), F.count("review_score").alias("c"))
    return (
        _delivered(orders)
        .select("order_id", timeliness().alias("delivery_timeliness"))
        .join(per_order, "order_id")
        .groupBy("delivery_timeliness")
        .agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    )


def review_by_timeliness(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Q6: average review score (2 dp) per timeliness bucket; a NULL bucket
    holds orders without an estimate."""
    return scores_by_timeliness(orders, reviews).select(
        "delivery_timeliness", round_half_up(ratio("s", "c"), 2).alias("avg_review_score")
    )


def delivery_time_distribution(orders: DataFrame) -> DataFrame:
    """Q17: average (2 dp), exact median, min and max delivery days of
    delivered, dated orders (a missing purchase time drops out)."""
    base = _delivered(orders).select(delivery_days().alias("days"))
    median = exact_percentile(base, "days", 0.5)
    return base.agg(
        round_half_up(F.avg("days"), 2).alias("avg_delivery_days"),
        F.min("days").alias("min_days"),
        F.max("days").alias("max_days"),
    ).select(
        "avg_delivery_days",
        F.lit(median).cast("double").alias("median_delivery_days"),
        "min_days",
        "max_days",
    )
