"""Findings the analysis states in prose, computed.

G2 risk spread across categories, G3 revenue share of the top N states,
G4 review gap between on-time and late orders, G5 dashboard extracts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.metrics import pct, ratio, round_half_up
from agora.model import Tables
from agora.operators.delivery import LATE, ON_TIME, scores_by_timeliness, on_time_rate
from agora.operators.category import top_categories_by_revenue
from agora.operators.customer import state_revenue
from agora.operators.overview import overview_totals
from agora.operators.seller import seller_scorecard
from agora.sources.sinks import write_parquet_concurrently


def risk_category_spread(seller_risk: DataFrame) -> DataFrame:
    """Per risk flag, flagged sellers and distinct top categories."""
    return seller_risk.groupBy("seller_flag").agg(
        F.count(F.lit(1)).alias("n_sellers"),
        F.count_distinct("top_category").alias("n_categories"),
    )


def revenue_top_n_share(t: Tables, n: int = 3) -> DataFrame:
    """The ``n`` states with most revenue (ties by name), listed in rank
    order, and their share of all revenue (2 dp). Ranking runs on the
    per-state rows."""
    states = state_revenue(t)
    rank = F.row_number().over(Window.orderBy(F.desc("total_revenue"), "customer_state"))
    ranked = states.withColumn("rank", rank)
    top = F.col("rank") <= n
    out = ranked.agg(
        F.sum(F.when(top, F.col("total_revenue"))).alias("top"),
        F.sum("total_revenue").alias("total"),
        F.sort_array(F.collect_list(F.when(top, F.struct("rank", "customer_state")))).alias("names"),
    )
    return out.select(
        F.lit(n).alias("top_n"),
        F.array_join(F.transform("names", lambda s: s["customer_state"]), ",").alias("top_states"),
        pct("top", "total", 2).alias("revenue_share_pct"),
    )


def timeliness_review_gap(t: Tables) -> DataFrame:
    """Average review of on-time and of late orders (every review counts)
    and the gap between them, taken from the unrounded averages."""
    by_bucket = scores_by_timeliness(t.orders, t.reviews)
    bucket = F.col("delivery_timeliness")
    sums = by_bucket.agg(
        ratio(F.sum(F.when(bucket == ON_TIME, F.col("s"))), F.sum(F.when(bucket == ON_TIME, F.col("c")))).alias("on"),
        ratio(F.sum(F.when(bucket == LATE, F.col("s"))), F.sum(F.when(bucket == LATE, F.col("c")))).alias("late"),
    )
    return sums.select(
        round_half_up("on", 2).alias("on_time_avg_review"),
        round_half_up("late", 2).alias("late_avg_review"),
        round_half_up(F.col("on") - F.col("late"), 2).alias("review_gap"),
    )


def dashboard_extracts(t: Tables, out_dir: str, min_orders: int = 100) -> DataFrame:
    """Write the dashboard's inputs (totals, on-time rate, top categories,
    seller scorecard) as parquet under ``out_dir`` and return their values
    as read back from the files."""
    extracts = {
        "overview_totals": overview_totals(t.orders, t.payments),
        "on_time_rate": on_time_rate(t.orders),
        "top_categories_by_revenue": top_categories_by_revenue(t),
        "seller_scorecard": seller_scorecard(t, min_orders),
    }
    spark = t.orders.sparkSession
    paths = {name: os.path.join(out_dir, name) for name in extracts}
    write_parquet_concurrently({paths[name]: df for name, df in extracts.items()})
    # Every value of every extract, as read back: extract, a row's key, field, value.
    keys = {"top_categories_by_revenue": "category", "seller_scorecard": "seller_id"}
    parts = []
    for name, path in paths.items():
        stored = spark.read.parquet(path)
        key = F.col(keys[name]).cast("string") if name in keys else F.lit("")
        fields = [c for c in stored.columns if c != keys.get(name)]
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in fields])
        parts.append(stored.select(F.lit(name).alias("extract_name"), key.alias("row_key"), F.inline(cells)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
