"""Payment analysis (Q14-15): method mix, average order value and revenue
share per payment type.

``payment_mix`` runs on payment legs (an order paid two ways counts under
both types); ``payment_mix_main_method`` runs on the collapsed table, where
each order has the type of its largest leg.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.metrics import mean, money, pct


def per_type(payments: DataFrame, *by: str) -> DataFrame:
    """Per payment type (and ``by``): orders, orders with a value, revenue.
    Values are summed per (order, type) first."""
    per_order = payments.groupBy(*by, "order_id", "payment_type").agg(F.sum("payment_value").alias("order_value"))
    return per_order.groupBy(*by, "payment_type").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count("order_value").alias("n_values"),
        F.sum("order_value").alias("revenue"),
    )


def mix(types: DataFrame) -> DataFrame:
    """The report over the rows of ``per_type``. The shares use a
    whole-result window over these rows (a handful), never over order rows."""
    everything = Window.partitionBy()
    return types.select(
        "payment_type",
        "n_orders",
        pct("n_orders", F.sum("n_orders").over(everything), 2).alias("pct_of_orders"),
        mean("revenue", "n_values").alias("avg_order_value"),
        money("revenue").alias("total_revenue"),
        pct("revenue", F.sum("revenue").over(everything), 2).alias("pct_of_revenue"),
    ).orderBy(F.desc("pct_of_orders"), "payment_type")


def payment_mix(payments: DataFrame) -> DataFrame:
    """Per payment type: orders, share of orders, average and total order
    value, share of revenue."""
    return mix(per_type(payments))


def payment_mix_main_method(collapsed_payments: DataFrame) -> DataFrame:
    """The same mix over one row per order (type of the largest leg)."""
    return payment_mix(collapsed_payments)
