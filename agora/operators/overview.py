"""Business overview: totals (Q1), status mix (Q2), monthly trend (Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.metrics import mean, money, month_label, pct, ts_literal

# Statuses counted as "in progress" by the status mix.
IN_PROGRESS_STATUSES = ["shipped", "invoiced", "created", "approved", "processing"]


def overview_totals(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Q1: total revenue, number of orders and average order value over
    orders that have a payment (inner join, all statuses)."""
    joined = orders.select("order_id").join(payments.select("order_id", "payment_value"), "order_id")
    return totals(joined.agg(F.sum("payment_value").alias("revenue"), F.count_distinct("order_id").alias("total_orders")))


def totals(sums: DataFrame) -> DataFrame:
    """Q1's report of (revenue, total_orders)."""
    return sums.select(
        money("revenue").alias("total_revenue"),
        "total_orders",
        mean("revenue", "total_orders").alias("avg_order_value"),
    )


def order_status_mix(orders: DataFrame) -> DataFrame:
    """Q2: share of delivered / canceled / in-progress / unavailable orders
    over distinct (order, status) pairs; other statuses stay in the total."""
    status = F.col("order_status")
    counts = (
        orders.select("order_id", "order_status")
        .distinct()
        .agg(
            F.count("order_id").alias("total"),
            F.count(F.when(status == "delivered", F.col("order_id"))).alias("delivered"),
            F.count_if(status == "canceled").alias("canceled"),
            F.count_if(status.isin(IN_PROGRESS_STATUSES)).alias("in_progress"),
            F.count_if(status == "unavailable").alias("unavailable"),
        )
    )
    return counts.select(
        *[pct(c, "total", 2).alias(f"{c}_orders_pct") for c in ("delivered", "canceled", "in_progress", "unavailable")]
    )


def monthly_trend(
    orders: DataFrame,
    payments: DataFrame,
    start: str = "2017-08-01",
    end: str = "2018-09-01",
) -> DataFrame:
    """Q3: orders and revenue per purchase month in the half-open window
    [start, end), months as 'yyyy-MM'."""
    ts = F.col("order_purchase_timestamp")
    in_window = orders.filter((ts >= ts_literal(start)) & (ts < ts_literal(end))).select(
        "order_id", month_label(ts).alias("month")
    )
    return trend(
        in_window.join(payments.select("order_id", "payment_value"), "order_id")
        .groupBy("month")
        .agg(F.count_distinct("order_id").alias("orders"), money(F.sum("payment_value")).alias("revenue"))
    )


def trend(months: DataFrame) -> DataFrame:
    """Q3's report of (month, orders, revenue)."""
    return months.orderBy("month")

