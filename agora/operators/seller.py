"""Seller performance: top sellers (Q8), scorecard (Q9), risk flags (Q10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.metrics import line_revenue, money, pct, ratio, round_half_up
from agora.model import Tables
from agora.operators.category import category_products, order_reviews
from agora.session import written

HIGH_RISK, AT_RISK, HEALTHY = "High Risk", "At Risk", "Healthy"


def top_sellers_by_revenue(t: Tables, limit: int = 20) -> DataFrame:
    """Q8: the ``limit`` sellers with most item revenue (all statuses).

    Items are summed per seller before meeting the sellers table; the sum
    after the join keeps SQL's result even if a seller row repeats."""
    return ranked_sellers(t.order_items.groupBy("seller_id").agg(F.sum(line_revenue()).alias("rev")), t.sellers, limit)


def ranked_sellers(per_seller: DataFrame, sellers: DataFrame, limit: int) -> DataFrame:
    """Q8's report of (seller_id, rev)."""
    return (
        per_seller.join(sellers.select("seller_id"), "seller_id")
        .groupBy("seller_id")
        .agg(money(F.sum("rev")).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "seller_id")
        .limit(limit)
    )


def seller_metrics(t: Tables) -> DataFrame:
    """Per seller over delivered, dated orders: distinct orders, the
    item-weighted average of the per-order review average (2 dp) and the
    share of late orders (1 dp).

    Rows are first reduced to one per (seller, order), so repeated orders
    count once, as distinct orders do. When the order joins
    are sort-merge joins (large inputs) their order_id partitioning already
    clusters those rows, so that step adds no shuffle (a plan test checks
    it); the per-seller step is a plain partial/final aggregate (no Expand,
    and a seller with a third of all items is one row per map task).
    """
    delivered = t.orders.filter(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    ).select(
        "order_id",
        (F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")).alias("late"),
    )
    per_order = (
        t.order_items.select("order_id", "seller_id")
        .join(delivered, "order_id")
        .join(order_reviews(t.reviews), "order_id", "left")
        .groupBy("seller_id", "order_id")
        .agg(
            # An order has one review average; a repeated order row is late
            # if any of its rows is.
            F.max("late").alias("late"),
            F.max("review_score").alias("review_score"),
            F.count(F.lit(1)).alias("n_items"),
        )
    )
    score, n = F.col("review_score"), F.col("n_items")
    per_seller = per_order.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("order_volume"),
        F.count_if(F.col("late")).alias("late_orders"),
        F.sum(F.when(score.isNotNull(), score * n)).alias("score_sum"),
        F.sum(F.when(score.isNotNull(), n)).alias("score_n"),
    )
    return per_seller.select(
        "seller_id",
        "order_volume",
        round_half_up(ratio("score_sum", "score_n"), 2).alias("avg_review_score"),
        pct("late_orders", "order_volume", 1).alias("late_pct"),
    )


def seller_scorecard(t: Tables, min_orders: int = 100) -> DataFrame:
    """Q9: sellers with at least ``min_orders`` orders, worst average first."""
    return (
        seller_metrics(t)
        .filter(F.col("order_volume") >= min_orders)
        .orderBy(F.asc_nulls_last("avg_review_score"), "seller_id")
    )


def seller_flag(review_threshold: float, late_threshold: float):
    """High Risk when both rounded metrics cross their threshold, At Risk when
    one does, else Healthy. SQL three-valued logic: a seller without reviews
    is At Risk only through lateness."""
    low_review = F.col("avg_review_score") < review_threshold
    late = F.col("late_pct") > late_threshold
    return F.when(low_review & late, HIGH_RISK).when(low_review | late, AT_RISK).otherwise(HEALTHY)


def seller_risk(
    t: Tables,
    review_threshold: float = 3.5,
    late_threshold: float = 14.5,
    min_orders: int = 100,
) -> DataFrame:
    """Q10: flagged sellers with at least ``min_orders`` orders, each with the
    category it sold most items in (items of every status).

    Items are counted per (seller, product) before anything is joined, so
    the shuffle carries one row per pair and map task: a seller holding a
    third of all items is spread over its products. The flagged sellers are
    written as parquet, so the planner knows their size: if they can be
    broadcast it moves the semi join below the counting and only their items
    are shuffled, else the counts meet them. The counts then meet one
    product-category relation and are summed per (seller, category)."""
    flagged = (
        seller_metrics(t)
        .withColumn("seller_flag", seller_flag(review_threshold, late_threshold))
        .filter((F.col("order_volume") >= min_orders) & F.col("seller_flag").isin(HIGH_RISK, AT_RISK))
    )
    flagged = written(flagged, "flagged_sellers")
    counts = (
        t.order_items.groupBy("seller_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(flagged.select("seller_id"), "seller_id", "left_semi")
        .join(category_products(t), "product_id")
        .groupBy("seller_id", "category")
        .agg(F.sum("n").alias("items_sold"))
    )
    # Ranking runs over the aggregated counts: at most one row per category
    # per seller. Equal counts go to the first category name.
    rank = F.row_number().over(Window.partitionBy("seller_id").orderBy(F.desc("items_sold"), "category"))
    top = counts.withColumn("rn", rank).filter(F.col("rn") == 1).select(
        "seller_id", F.col("category").alias("top_category"), "items_sold"
    )
    return (
        flagged.join(top, "seller_id", "left")
        .select(
            "seller_id",
            "order_volume",
            "avg_review_score",
            "late_pct",
            "seller_flag",
            "top_category",
            "items_sold",
        )
        .orderBy("seller_flag", F.desc_nulls_first("late_pct"), "seller_id")
    )
