"""Product and category analysis: category performance (Q7), segment check on
the flat table (Q7b), bad-review comments (Q7c), top categories by revenue
(Q7d), categories of high-value orders (Q16).

Per-category distinct-order counts are taken from a (category, order)
pre-aggregate rather than COUNT(DISTINCT): under sort-merge order joins the
pre-aggregate reuses their order_id partitioning, and the per-category step
is a plain partial/final aggregate - no Expand, and a category holding a
third of all items costs one row per map task. Items meet products on
product_id before the order joins; that join is a broadcast when AQE sees
the products side is small, otherwise a second shuffle of the item rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.metrics import days_between, line_revenue, mean, money, pct, round_half_up
from agora.functions.percentile import exact_percentile
from agora.model import Tables
from agora.operators.delivery import timeliness
from agora.session import written


def order_reviews(reviews: DataFrame) -> DataFrame:
    """Average review score per order (an order may have several reviews)."""
    return reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))


def category_products(t: Tables) -> DataFrame:
    """(product_id, category): products with the English name of their
    category. Products whose category has no translation fall out."""
    return (
        t.products.select("product_id", "product_category_name")
        .join(t.product_category, "product_category_name")
        .select("product_id", F.col("product_category_name_english").alias("category"))
    )


def category_items(t: Tables, *extra: str) -> DataFrame:
    """Items with the English name of their product's category as
    ``category``. The category is joined at product grain first, so item
    rows meet one dimension relation. Items whose product was dropped or
    whose category has no translation fall out."""
    if t.item_products is not None:
        found = t.item_products.where("translated")
        return found.select("order_id", F.col("product_category_name_english").alias("category"), *extra)
    items = t.order_items.select("order_id", "product_id", *extra)
    return items.join(category_products(t), "product_id").select("order_id", "category", *extra)


def _delivered_ids(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == "delivered").select("order_id")


def _category_orders(t: Tables, with_reviews: bool) -> DataFrame:
    """(category, order_id[, review_score]) -> revenue and item count for
    delivered orders."""
    items = category_items(t, "price", "freight_value").join(_delivered_ids(t.orders), "order_id")
    keys = ["category", "order_id"]
    if with_reviews:
        items = items.join(order_reviews(t.reviews), "order_id", "left")
        keys.append("review_score")
    return items.groupBy(*keys).agg(
        F.sum(line_revenue()).alias("rev"), F.count(F.lit(1)).alias("n_items")
    )


def category_performance(t: Tables, min_orders: int = 100, limit: int = 20) -> DataFrame:
    """Q7: revenue, order volume, revenue per order, item-weighted average of
    the per-order review average, low (1-3) and high (4-5) counts; categories
    with at least ``min_orders`` delivered orders, worst average first."""
    per = _category_orders(t, with_reviews=True)
    score, n = F.col("review_score"), F.col("n_items")
    cat = per.groupBy("category").agg(
        F.sum("rev").alias("rev"),
        F.count(F.lit(1)).alias("order_volume"),
        F.sum(F.when(score.isNotNull(), score * n)).alias("score_sum"),
        F.sum(F.when(score.isNotNull(), n)).alias("score_n"),
        F.coalesce(F.sum(F.when(score.between(1, 3), n)), F.lit(0)).alias("low_reviews"),
        F.coalesce(F.sum(F.when(score.between(4, 5), n)), F.lit(0)).alias("high_reviews"),
    )
    return (
        cat.select(
            "category",
            money("rev").alias("total_revenue"),
            "order_volume",
            mean("rev", "order_volume").alias("revenue_per_order"),
            mean("score_sum", "score_n").alias("avg_review_score"),
            F.col("low_reviews").cast("bigint").alias("low_reviews"),
            F.col("high_reviews").cast("bigint").alias("high_reviews"),
        )
        .filter(F.col("order_volume") >= min_orders)
        .orderBy(F.asc_nulls_last("avg_review_score"), "category")
        .limit(limit)
    )


def category_segment_check(flat: DataFrame, segment: str) -> DataFrame:
    """One category against all others on the flat table (joined-row
    grain): average review, average delivery days, late share."""
    seg = F.when(F.col("product_category_en") == segment, F.lit(segment)).otherwise(F.lit("all_others"))
    base = flat.filter(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    )
    return (
        base.groupBy(seg.alias("segment"))
        .agg(
            F.avg("review_score").alias("r"),
            F.avg(days_between("order_purchase_timestamp", "order_delivered_customer_date")).alias("d"),
            F.count_if(timeliness() == "Late").alias("late"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "segment",
            round_half_up("r", 2).alias("avg_review"),
            round_half_up("d", 2).alias("avg_days"),
            pct("late", "n", 1).alias("late_pct"),
        )
    )


def bad_review_comments(t: Tables, category: str, max_score: int = 3) -> DataFrame:
    """Distinct messages of reviews scored at most ``max_score`` on
    orders with an item in ``category`` (a semi join: no item fan-out)."""
    # The filter leaves one category's products before items are joined.
    products = category_products(t).filter(F.col("category") == category)
    in_category = t.order_items.select("order_id", "product_id").join(products, "product_id").select("order_id")
    return (
        t.reviews.filter(F.col("review_score") <= max_score)
        .join(in_category, "order_id", "left_semi")
        .select("review_comment_message")
        .distinct()
    )


def top_categories_by_revenue(t: Tables, limit: int = 10) -> DataFrame:
    """Q7d: the ``limit`` categories with most revenue from delivered orders."""
    per = _category_orders(t, with_reviews=False)
    return (
        per.groupBy("category")
        .agg(money(F.sum("rev")).alias("total_revenue"), F.count(F.lit(1)).alias("order_volume"))
        .orderBy(F.desc("total_revenue"), "category")
        .limit(limit)
    )


def high_value_categories(
    t: Tables, p: float = 0.75, min_orders: int = 30, limit: int = 10
) -> DataFrame:
    """Q16: categories of orders whose total is strictly above the P``p``
    order total. Shares are of all high-value orders (also those without a
    category); an order counts once in each of its categories.

    Order totals feed the percentile passes and the final query, so they are
    written once as parquet in the shared folder (the percentile reads the
    value column only). The threshold is a literal and the high-value count
    a scalar subquery: no cross join.
    """
    totals = t.order_items.groupBy("order_id").agg(F.sum(line_revenue()).alias("order_value"))
    stored = written(totals, "order_totals")
    threshold = exact_percentile(stored, "order_value", p)
    # Prepared items are in buckets by order: adding them up again needs no
    # shuffle, while the stored totals would have to be shuffled to meet them.
    totals = stored if t.item_products is None else totals
    high = totals.filter(F.col("order_value").cast("double") > F.lit(threshold)).select("order_id")
    n_high = high.agg(F.count(F.lit(1))).scalar()
    return (
        category_items(t)
        .join(high, "order_id", "left_semi")
        .distinct()
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("high_value_orders"))
        .filter(F.col("high_value_orders") >= min_orders)
        .select(
            F.col("category").alias("product_category_name_english"),
            "high_value_orders",
            pct("high_value_orders", n_high, 2).alias("pct_of_hv_orders"),
        )
        .orderBy(F.desc("high_value_orders"), "product_category_name_english")
        .limit(limit)
    )
