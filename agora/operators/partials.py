"""Stored partial aggregates by purchase day (A2, A8, A12): overview (Q1),
trend (Q3), seller revenue (Q8) and payment mix (Q14-15) from states of the
days before and a batch with the new days.

A state holds mergeable sums and counts of one day: orders with a payment
and what was paid, revenue per seller, and per payment type what the mix
needs (of the legs, and of the collapsed payments, the sum and main type of
each order). Orders and their rows belong to the day of purchase; rows of
unknown orders, and orders without a date, to no day. States lie in a folder per month.
``add_days`` reads the batch and the states of its months, and replaces its
days, so adding a day twice changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.metrics import line_revenue, money
from agora.model import Tables
from agora.operators.overview import totals, trend
from agora.operators.payment import mix, per_type
from agora.operators.seller import ranked_sellers
from agora.session import written
from agora.sources import store

DAY, MONTH = "purchase_day", "purchase_month"


def _days(t: Tables) -> DataFrame:
    return t.orders.select("order_id", F.to_date("order_purchase_timestamp").alias(DAY))


def _legs_by_day(payments: DataFrame, days: DataFrame) -> DataFrame:
    return per_type(payments.join(days, "order_id", "left"), DAY)


#: Each state as a function of the tables of whole days.
STATES = {
    "paid": lambda t: t.payments.select("order_id", "payment_value")
    .join(_days(t), "order_id")
    .groupBy(DAY)
    .agg(F.sum("payment_value").alias("revenue"), F.count_distinct("order_id").alias("n_orders")),
    "sellers": lambda t: t.order_items.join(_days(t), "order_id", "left").groupBy(DAY, "seller_id").agg(F.sum(line_revenue()).alias("rev")),
    "legs": lambda t: _legs_by_day(t.payment_legs, _days(t)),
    "main_types": lambda t: _legs_by_day(t.payments, _days(t)),
}


def write_states(t: Tables, base: str, names: tuple[str, ...] = tuple(STATES)) -> None:
    """The states of all days of ``t`` as a new version of ``base``."""
    spark = t.orders.sparkSession
    version = store.new_version(spark, base)
    for name in names:
        _write(STATES[name](t), os.path.join(store.folder(base, version), name))
    store.publish(spark, base, version)


def add_days(batch: Tables, base: str, names: tuple[str, ...] = tuple(STATES)) -> None:
    """Replace the days of ``batch``, which holds all orders of its days and
    their items and payments; its source rows and the states of its months
    are all that is read. Rows without a day count as a day of their own."""
    spark = batch.orders.sparkSession
    ordered = {r[0] for r in _days(batch).select(DAY).distinct().collect()}
    for name in names:
        path = os.path.join(store.current(spark, base), name)
        new = written(STATES[name](batch), "state")
        days = ordered | {r[0] for r in new.select(DAY).distinct().collect()}
        months = {d and d.strftime("%Y-%m") for d in days}
        old = read_state(spark, base, name).where(_among(MONTH, months) & ~_among(DAY, days))
        _write(old.drop(MONTH).unionByName(new), path)


def _among(column: str, values: set) -> Column:
    """Whether a column is one of ``values`` (NULL among them or not)."""
    known = F.coalesce(F.col(column).isin(sorted(v for v in values if v is not None)), F.lit(False))
    return known | F.col(column).isNull() if None in values else known


def _write(state: DataFrame, path: str) -> None:
    # Months that come again are replaced, the others keep their files.
    by_month = state.withColumn(MONTH, F.date_format(DAY, "yyyy-MM")).repartition(MONTH)
    by_month.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_state(spark: SparkSession, base: str, name: str) -> DataFrame:
    path = os.path.join(store.current(spark, base), name)
    return spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))


def overview_totals(spark: SparkSession, base: str) -> DataFrame:
    """Q1 from the states."""
    paid = read_state(spark, base, "paid")
    return totals(paid.agg(F.sum("revenue").alias("revenue"), F.coalesce(F.sum("n_orders"), F.lit(0).cast("long")).alias("total_orders")))


def monthly_trend(spark: SparkSession, base: str, start: str, end: str) -> DataFrame:
    """Q3 from the states of the days in [start, end); only these are read."""
    paid = read_state(spark, base, "paid")
    # The months prune folders, the days cut them.
    paid = paid.where(F.col(MONTH).between(start[:7], end[:7]) & (F.col(DAY) >= F.lit(start).cast("date")) & (F.col(DAY) < F.lit(end).cast("date")))
    months = paid.groupBy(F.col(MONTH).alias("month"))
    return trend(months.agg(F.sum("n_orders").alias("orders"), money(F.sum("revenue")).alias("revenue")))


def top_sellers_by_revenue(spark: SparkSession, base: str, sellers: DataFrame, limit: int = 20) -> DataFrame:
    """Q8 from the states."""
    return ranked_sellers(read_state(spark, base, "sellers").groupBy("seller_id").agg(F.sum("rev").alias("rev")), sellers, limit)


def payment_mix(spark: SparkSession, base: str, main_method: bool = False) -> DataFrame:
    """Q14-15 from the states, by legs or by each order's main method."""
    days = read_state(spark, base, "main_types" if main_method else "legs")
    return mix(days.groupBy("payment_type").agg(*[F.sum(k).alias(k) for k in ("n_orders", "n_values", "revenue")]))
