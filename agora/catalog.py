"""Every operator as a named query over a folder of driver tables.

Each entry takes ``(spark, sf_dir)``, binds the marketplace roles from the
parquet files in ``sf_dir``, cleans them as the analysis does and returns
the operator's DataFrame. Parameters that depend on the data (the trend
window, the category examined) are set for the driver's tables here; the
operators themselves keep the analysis' defaults.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.metrics import month_label, timestamp_text, ts_literal
from agora.model import Tables
from agora.operators import category, cleaning, customer, delivery, findings, overview, partials, payment, quality, seller
from agora.session import new_folder, run_folder, written
from agora.sources import sinks
from agora.sources.binding import bind_tables
from agora.sources.readers import register_views

# Parameters for the driver's tables (purchases run 1995-2001, categories
# are brand names): a 13-month trend window and the examined category.
TREND_WINDOW = ("1996-01-01", "1997-02-01")
SEGMENT = "brand_1"
# Over all years nearly every customer comes back; before this day some do.
REPEAT_BEFORE = "1995-05-01"

Query = Callable[[SparkSession, str], DataFrame]


def raw(spark: SparkSession, sf_dir: str) -> Tables:
    return bind_tables(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> Tables:
    """Cleaned tables as lazy plans over the source files: a query reads and
    cleans what it needs, nothing is copied. Who runs many queries over one
    load prepares the tables once with ``sinks.load_tables`` and opens them
    with ``sinks.read_tables`` in any later session."""
    return cleaning.clean_tables(raw(spark, sf_dir))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat order table, built from the cleaned tables."""
    return cleaning.flat_orders(clean(spark, sf_dir))


def _stored_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table through its sink and back: rows per purchase month."""
    path = os.path.join(_out_dir(spark), "flat_orders")
    sinks.write_flat_table(flat(spark, sf_dir), path)
    stored = sinks.read_flat_table(spark, path)
    return stored.groupBy(F.col(sinks.MONTH_COLUMN).cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("order_id").alias("n_orders")
    )


def _updated_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored flat table that lacks the last year's orders and has another
    status for those of one month, brought up to date: rows per month. The
    older table, the digests and the rewritten months all read the new flat
    rows, so these are joined once and kept until the update is done."""
    path = os.path.join(_out_dir(spark), "flat_orders")
    bought = F.col("order_purchase_timestamp")
    with run_folder(spark):
        wanted = written(flat(spark, sf_dir), "flat")
        older = wanted.where(bought < ts_literal("1998-01-01")).withColumn(
            "order_status", F.when(month_label(bought) == "1995-03", F.lit("created")).otherwise(F.col("order_status"))
        )
        sinks.write_flat_table(older, path)
        sinks.update_flat_table(wanted, path)
    return sinks.read_flat_table(spark, path).groupBy(F.col(sinks.MONTH_COLUMN).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("order_id").alias("n_orders"),
        F.count_if(F.col("order_status") == "delivered").alias("n_delivered"),
    )


def _batches(spark: SparkSession, sf_dir: str) -> tuple[Tables, Tables]:
    """The cleaned tables as two batches of whole days: the last year's
    orders with their rows, and everything else."""
    t = clean(spark, sf_dir)
    late = t.orders.where(F.col("order_purchase_timestamp") >= ts_literal("1998-01-01"))
    ids = late.select("order_id")

    def part(how: str) -> dict[str, DataFrame]:
        return {k: getattr(t, k).join(ids, "order_id", how) for k in ("orders", "order_items", "payments", "payment_legs")}

    return t.with_(**part("left_anti")), t.with_(**part("left_semi"))


def _from_states(names: tuple[str, ...], report: Callable[[SparkSession, str, Tables], DataFrame]) -> Query:
    """A report over stored daily states and a new batch."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = _out_dir(spark)
        old, new = _batches(spark, sf_dir)
        partials.write_states(old, base, names)
        partials.add_days(new, base, names)
        return report(spark, base, old)

    return query


def _stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised tables through their sink and back, queried by name
    through SQL views: rows per table."""
    loaded = sinks.load_tables(clean(spark, sf_dir), os.path.join(_out_dir(spark), "tables"))
    prefix = f"stored_{uuid.uuid4().hex[:8]}_"
    names = register_views(loaded, prefix)
    return spark.sql(
        " UNION ALL ".join(f"SELECT '{n.removeprefix(prefix)}' AS table_name, count(*) AS n_rows FROM {n}" for n in names)
    )


def _out_dir(spark: SparkSession) -> str:
    """A new folder for written results, under the shared folder."""
    return new_folder(spark, "out")


def _dates_as_text(orders: DataFrame) -> DataFrame:
    """The order timestamps rendered as text the way a CSV carries them:
    date only at midnight, empty when missing."""
    from agora.sources.schema import ORDER_DATE_COLUMNS

    return orders.select(
        "order_id", *[F.coalesce(timestamp_text(c), F.lit("")).alias(c) for c in ORDER_DATE_COLUMNS]
    )


def _key_checks(t: Tables) -> DataFrame:
    checks = [
        ("payments", ["order_id"], t.payments),
        ("orders", ["order_id"], t.orders),
        ("products", ["product_id"], t.products),
        ("customers", ["customer_id"], t.customers),
        ("sellers", ["seller_id"], t.sellers),
        ("product_category", ["product_category_name"], t.product_category),
    ]
    out = None
    for name, keys, df in checks:
        part = quality.key_check(df, keys).select(
            F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "*"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dashboard_extracts(clean(spark, sf_dir), os.path.join(_out_dir(spark), "dashboard_extracts"))


QUERIES: dict[str, Query] = {
    # profiling, quality and cleaning
    "table_profile": lambda s, d: quality.table_profile(raw(s, d).named()),
    "coerce_order_dates": lambda s, d: cleaning.coerce_order_dates(_dates_as_text(raw(s, d).orders)),
    "null_audit_orders": lambda s, d: quality.null_audit(raw(s, d).orders),
    "null_audit_reviews": lambda s, d: quality.null_audit(raw(s, d).reviews),
    "null_audit_products": lambda s, d: quality.null_audit(raw(s, d).products),
    "order_status_counts": lambda s, d: quality.value_counts(raw(s, d).orders, "order_status", "n_orders"),
    "review_score_counts": lambda s, d: quality.value_counts(raw(s, d).reviews, "review_score", "n_reviews"),
    "invalid_delivered": lambda s, d: cleaning.invalid_delivered(raw(s, d).orders),
    "flag_invalid_delivered": lambda s, d: cleaning.flag_invalid_delivered(raw(s, d).orders),
    "flag_has_comment": lambda s, d: cleaning.flag_has_comment(raw(s, d).reviews),
    "review_mean_by_comment": lambda s, d: quality.review_mean_by_comment(clean(s, d).reviews),
    "review_dist_by_comment": lambda s, d: quality.review_dist_by_comment(clean(s, d).reviews),
    "fill_review_text": lambda s, d: clean(s, d).reviews,
    "clean_products": lambda s, d: clean(s, d).products,
    "extend_category_dim": lambda s, d: clean(s, d).product_category,
    "order_payments": lambda s, d: clean(s, d).payments,
    "assert_unique_key": lambda s, d: _key_checks(clean(s, d)),
    "flat_orders": flat,
    "stored_flat_by_month": _stored_flat,
    "updated_flat_by_month": _updated_flat,
    "stored_tables": _stored_tables,
    "flat_row_check": lambda s, d: quality.flat_row_check(clean(s, d).orders, flat(s, d)),
    # business overview
    "overview_totals": lambda s, d: (lambda t: overview.overview_totals(t.orders, t.payments))(clean(s, d)),
    "order_status_mix": lambda s, d: overview.order_status_mix(clean(s, d).orders),
    "monthly_trend": lambda s, d: (
        lambda t: overview.monthly_trend(t.orders, t.payments, *TREND_WINDOW)
    )(clean(s, d)),
    # delivery
    "delivery_time_overall": lambda s, d: delivery.delivery_time_overall(clean(s, d).orders),
    "delivery_time_by_state": lambda s, d: (
        lambda t: delivery.delivery_time_by_state(t.orders, t.customers)
    )(clean(s, d)),
    "on_time_rate": lambda s, d: delivery.on_time_rate(clean(s, d).orders),
    "review_by_timeliness": lambda s, d: (lambda t: delivery.review_by_timeliness(t.orders, t.reviews))(clean(s, d)),
    "delivery_time_distribution": lambda s, d: delivery.delivery_time_distribution(clean(s, d).orders),
    # products and categories
    "category_performance": lambda s, d: category.category_performance(clean(s, d)),
    "category_segment_check": lambda s, d: category.category_segment_check(flat(s, d), SEGMENT),
    "bad_review_comments": lambda s, d: category.bad_review_comments(clean(s, d), SEGMENT),
    "top_categories_by_revenue": lambda s, d: category.top_categories_by_revenue(clean(s, d)),
    "high_value_categories": lambda s, d: category.high_value_categories(clean(s, d)),
    # sellers
    "top_sellers_by_revenue": lambda s, d: seller.top_sellers_by_revenue(clean(s, d)),
    "seller_scorecard": lambda s, d: seller.seller_scorecard(clean(s, d)),
    "seller_risk": lambda s, d: seller.seller_risk(clean(s, d)),
    # customers
    "revenue_by_state": lambda s, d: customer.revenue_by_state(clean(s, d)),
    "revenue_by_customer": lambda s, d: customer.revenue_by_customer(clean(s, d)),
    "repeat_customers": lambda s, d: customer.repeat_customers(clean(s, d)),
    "repeat_customers_early": lambda s, d: customer.repeat_customers(clean(s, d), purchased_before=REPEAT_BEFORE),
    "spend_per_customer_by_state": lambda s, d: customer.spend_per_customer_by_state(clean(s, d)),
    "windowed_retention": lambda s, d: customer.windowed_retention(clean(s, d)),
    # payments
    "payment_mix": lambda s, d: payment.payment_mix(clean(s, d).payment_legs),
    "payment_mix_main_method": lambda s, d: payment.payment_mix_main_method(clean(s, d).payments),
    # the same from stored daily states and a new batch
    "overview_totals_from_states": _from_states(("paid",), lambda s, base, t: partials.overview_totals(s, base)),
    "monthly_trend_from_states": _from_states(("paid",), lambda s, base, t: partials.monthly_trend(s, base, *TREND_WINDOW)),
    "top_sellers_from_states": _from_states(("sellers",), lambda s, base, t: partials.top_sellers_by_revenue(s, base, t.sellers)),
    "payment_mix_from_states": _from_states(("legs",), lambda s, base, t: partials.payment_mix(s, base)),
    "payment_mix_main_method_from_states": _from_states(("main_types",), lambda s, base, t: partials.payment_mix(s, base, main_method=True)),
    # findings stated in prose
    "risk_category_spread": lambda s, d: findings.risk_category_spread(seller.seller_risk(clean(s, d))),
    "revenue_top_n_share": lambda s, d: findings.revenue_top_n_share(clean(s, d)),
    "timeliness_review_gap": lambda s, d: findings.timeliness_review_gap(clean(s, d)),
    "dashboard_extracts": _extracts,
}

FLAGSHIP = "seller_risk"
