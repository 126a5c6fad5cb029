"""Profiling and data-quality operators.

Every per-column statistic is taken for all columns of a table in one
aggregation pass, then turned into rows; no per-column jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.functions.metrics import pct, round_half_up


def _column_rows(df: DataFrame, stat) -> DataFrame:
    """One pass: ``n_rows`` and ``stat(column)`` for every column, returned
    as rows (ordinal, column_name, data_type, value, n_rows)."""
    cols = df.columns
    agg = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[stat(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(cols)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.col(f"_c{i}").cast("bigint").alias("value"),
        )
        for i, c in enumerate(cols)
    ]
    return agg.select("n_rows", F.inline(F.array(*entries)))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column: declared type, row count, non-null count."""
    parts = [
        _column_rows(df, F.count).select(
            F.lit(name).alias("table_name"),
            "column_name",
            "data_type",
            "n_rows",
            F.col("value").alias("non_null"),
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row for a stored parquet table: its rows (``n_rows``) and its
    non-null values by column. The columnar reader answers these counts from
    the files' footers and reads no page; its settings hold in a session of
    its own, not in the caller's."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(f"{k}_{c}") for k, c in enumerate(df.columns)])


def stored_profile(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """C1 and C3 for stored parquet tables (name to path), from their footers:
    per table and column: declared type, rows, non-null count, NULL count and
    share. One row per table comes to the driver."""
    rows = []
    for name, path in paths.items():
        found = footer_counts(spark, path).first()
        for k, field in enumerate(spark.read.parquet(path).schema):
            rows.append((name, field.name, field.dataType.simpleString(), found.n_rows, found[f"{k}_{field.name}"]))
    counted = spark.createDataFrame(rows, "table_name string, column_name string, data_type string, n_rows long, non_null long")
    nulls = F.col("n_rows") - F.col("non_null")
    return counted.select("*", nulls.alias("null_count"), pct(nulls, "n_rows", 2).alias("null_percentage"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """C1 head: the first ``n`` rows, for display."""
    return df.limit(n)


def null_audit(df: DataFrame) -> DataFrame:
    """Columns with NULLs, with their count and share (% of rows, 2 dp)."""
    rows = _column_rows(df, lambda c: F.count_if(c.isNull()))
    return rows.filter(F.col("value") > 0).select(
        "column_name",
        F.col("value").alias("null_count"),
        pct(F.col("value"), F.col("n_rows"), 2).alias("null_percentage"),
    )


def value_counts(df: DataFrame, column: str, count_name: str = "n") -> DataFrame:
    """Rows per non-NULL value, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.desc(count_name), F.asc(column))
    )


def review_mean_by_comment(reviews: DataFrame) -> DataFrame:
    """Mean review score of reviews with and without a comment."""
    return reviews.groupBy("has_comment").agg(F.avg("review_score").alias("mean_review_score"))


def review_dist_by_comment(reviews: DataFrame) -> DataFrame:
    """Share of each score within each has_comment group (a fraction).

    The window runs over the grouped counts (at most 2 x scores rows)."""
    counts = (
        reviews.filter(F.col("review_score").isNotNull())
        .groupBy("has_comment", "review_score")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("has_comment"))
    return counts.select("has_comment", "review_score", (F.col("n") / total).alias("share"))


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """C15 as a report: one row (n_rows, n_keys, n_dup_keys)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("c") > 1).alias("n_dup_keys"),
    )


class DuplicateKeyError(AssertionError):
    pass


def assert_unique_key(df: DataFrame, keys: list[str], sample: int = 5) -> None:
    """Raise if any key value repeats, naming a few of the repeats."""
    dups = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).limit(sample).collect()
    )
    if dups:
        shown = ", ".join(str(tuple(r[k] for k in keys)) for r in dups)
        raise DuplicateKeyError(f"duplicate {keys}: {shown}")


def flat_row_check(orders: DataFrame, flat: DataFrame) -> DataFrame:
    """C17: orders rows vs flat rows, distinct orders in the flat table, fan-out.

    Both inputs go through one aggregation over a tagged union."""
    key_type = flat.schema["order_id"].dataType
    tagged = orders.select(F.lit(True).alias("is_order"), F.lit(None).cast(key_type).alias("order_id")).unionByName(
        flat.select(F.lit(False).alias("is_order"), "order_id")
    )
    counts = tagged.agg(
        F.count_if(F.col("is_order")).alias("orders_rows"),
        F.count_if(~F.col("is_order")).alias("flat_rows"),
        F.count_distinct("order_id").alias("flat_orders"),
    )
    return counts.select(
        "orders_rows",
        "flat_rows",
        "flat_orders",
        round_half_up(F.col("flat_rows") / F.nullif(F.col("orders_rows"), F.lit(0)), 4).alias("fan_out"),
    )
