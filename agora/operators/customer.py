"""Customer behaviour: revenue by state (Q11), one-time vs repeat customers
(Q12), spend per customer by state (Q13), windowed retention (G1).

Item revenue is summed per order, then per customer, before the customer
join: each step is a partial/final aggregate, so the join inputs shrink to
one row per order or customer and a customer (or state) holding a large
share of the rows never concentrates raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.metrics import line_revenue, mean, money, month_label, pct, ts_literal
from agora.functions.running import running_total
from agora.model import Tables
from agora.session import written


def revenue_per_customer(t: Tables) -> DataFrame:
    """(customer_id, rev): item revenue of each customer's orders."""
    per_order = t.order_items.groupBy("order_id").agg(F.sum(line_revenue()).alias("rev"))
    return (
        per_order.join(t.orders.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id")
        .agg(F.sum("rev").alias("rev"))
    )


def state_revenue(t: Tables) -> DataFrame:
    """(customer_state, total_revenue) unrounded, all statuses."""
    return (
        revenue_per_customer(t)
        .join(t.customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(F.sum("rev").alias("total_revenue"))
    )


def revenue_by_state(t: Tables) -> DataFrame:
    """Q11: revenue per state, its share of the total and the running share
    in descending order (states with equal revenue share one running value).

    The windows run over the per-state result (one row per state)."""
    rev = F.col("total_revenue")
    everything = Window.partitionBy()
    running = Window.orderBy(F.desc("total_revenue")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(rev).over(everything)
    return state_revenue(t).select(
        "customer_state",
        money(rev).alias("total_revenue"),
        pct(rev, total, 2).alias("pct_of_total"),
        pct(F.sum(rev).over(running), total, 2).alias("cumulative_pct"),
    ).orderBy(F.desc("total_revenue"), "customer_state")


def revenue_by_customer(t: Tables) -> DataFrame:
    """Q11 by customer instead of by state: customers may be any number, so
    no step puts all of them into one task."""
    revenue = written(revenue_per_customer(t).select("customer_id", F.col("rev").alias("total_revenue")), "revenue")
    return running_total(revenue, "total_revenue").select(
        "customer_id",
        money("total_revenue").alias("total_revenue"),
        pct("total_revenue", "total", 4).alias("pct_of_total"),
        pct("running", "total", 4).alias("cumulative_pct"),
    )


def _orders_in_window(orders: DataFrame, purchased_from: str | None, purchased_before: str | None) -> DataFrame:
    ts = F.col("order_purchase_timestamp")
    if purchased_from:
        orders = orders.filter(ts >= ts_literal(purchased_from))
    if purchased_before:
        orders = orders.filter(ts < ts_literal(purchased_before))
    return orders


def repeat_customers(
    t: Tables, purchased_from: str | None = None, purchased_before: str | None = None
) -> DataFrame:
    """Q12: share (1 dp) of unique customers with one order and with more,
    and their number; optionally only purchases in [from, before)."""
    per_customer = (
        _orders_in_window(t.orders, purchased_from, purchased_before)
        .groupBy("customer_id")
        .agg(F.count("order_id").alias("c"))
    )
    per_person = (
        per_customer.join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("c").alias("order_count"))
    )
    counts = per_person.agg(
        F.count_if(F.col("order_count") == 1).alias("one"),
        F.count_if(F.col("order_count") > 1).alias("more"),
        F.count(F.lit(1)).alias("total_unique_customers"),
    )
    return counts.select(
        pct("one", "total_unique_customers", 1).alias("one_time_pct"),
        pct("more", "total_unique_customers", 1).alias("repeat_pct"),
        "total_unique_customers",
    )


def spend_per_customer_by_state(t: Tables) -> DataFrame:
    """Q13: per state, unique customers and their average spend (2 dp); a
    person with orders under two states counts in both."""
    per_person = (
        revenue_per_customer(t)
        .join(t.customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id")
        .groupBy("customer_unique_id", "customer_state")
        .agg(F.sum("rev").alias("total_spend"))
    )
    return (
        per_person.groupBy("customer_state")
        .agg(
            F.count(F.lit(1)).alias("unique_customers"),
            F.sum("total_spend").alias("spend"),
            F.count("total_spend").alias("n_spend"),
        )
        .select("customer_state", "unique_customers", mean("spend", "n_spend").alias("avg_spend_per_customer"))
        .orderBy(F.desc_nulls_first("avg_spend_per_customer"), "customer_state")
    )


def windowed_retention(t: Tables, days: int = 180) -> DataFrame:
    """G1: per cohort month of a person's first order, and over all ('ALL'):

    eligible = the first order lies at least ``days`` days before the last
    purchase in the data; retained = an eligible person placed another order
    within ``days`` days of the first one; retention_pct = retained share.

    A person is retained if their second order lies within ``days`` of the
    first, so two orders of each person suffice: ``row_number() <= 2`` cuts a
    person's rows to two in every map task before the shuffle, and no task
    gets all rows of a person with very many orders. The last purchase is a
    plain maximum, computed apart."""
    purchases = (
        t.orders.filter(F.col("order_purchase_timestamp").isNotNull())
        .select("customer_id", F.col("order_purchase_timestamp").alias("ts"))
        .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .select("customer_unique_id", "ts")
    )
    last_ts = purchases.agg(F.max("ts")).scalar()  # scalar subquery, runs once
    span = F.make_dt_interval(days=F.lit(days))
    turn = F.row_number().over(Window.partitionBy("customer_unique_id").orderBy("ts"))
    flags = (
        purchases.withColumn("turn", turn)
        .filter(F.col("turn") <= 2)
        .groupBy("customer_unique_id")
        .agg(F.min("ts").alias("first_ts"), F.max(F.when(F.col("turn") == 2, F.col("ts"))).alias("second_ts"))
        .select(
            month_label("first_ts").alias("cohort_month"),
            (F.col("first_ts") + span <= last_ts).alias("eligible"),
            F.coalesce(F.col("second_ts") <= F.col("first_ts") + span, F.lit(False)).alias("repeat"),
        )
    )
    # One grouping-sets aggregate gives each cohort and the total ('ALL').
    return (
        flags.rollup("cohort_month")
        .agg(
            F.count_if("eligible").alias("eligible_customers"),
            F.count_if(F.col("eligible") & F.col("repeat")).alias("retained_customers"),
            F.grouping("cohort_month").alias("is_total"),
        )
        .select(
            F.when(F.col("is_total") == 1, F.lit("ALL")).otherwise(F.col("cohort_month")).alias("cohort_month"),
            "eligible_customers",
            "retained_customers",
            pct("retained_customers", "eligible_customers", 2).alias("retention_pct"),
        )
        .orderBy("cohort_month")
    )
