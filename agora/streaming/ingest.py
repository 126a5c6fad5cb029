"""Incremental loading: CSV files landing in a folder become cleaned parquet.

The batch load reads a whole CSV drop; this is the same load as a
Structured Streaming query, so new files are picked up without re-reading
old ones. Only the row-wise cleaning steps run here (date coercion and the
invalid-delivery flag for orders, the comment flag and text fill for
reviews, the category fill and weight filter for products); aggregating
steps such as collapsing payments stay batch jobs over the loaded table.
Progress lives beside the target, so a query restarted in any session
resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from agora.operators import cleaning
from agora.sources.readers import csv_options, header_schema, null_tokens_out, string_columns
from agora.sources.schema import CSV_TABLES

ROW_CLEANING = {
    "orders": lambda df: cleaning.flag_invalid_delivered(cleaning.coerce_order_dates(df)),
    "reviews": lambda df: cleaning.fill_review_text(cleaning.flag_has_comment(df)),
    "products": cleaning.clean_products,
}


def csv_stream(spark: SparkSession, table: str, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over CSV files of one table: the batch reader's
    options and missing-value tokens. The header of the first file gives the
    columns' order; a file with another one is an error."""
    schema = CSV_TABLES[table]
    reader = spark.readStream.schema(header_schema(spark, source_dir, schema)).options(**csv_options(table))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.csv(source_dir).select(*[f.name for f in schema])
    return null_tokens_out(df, string_columns(schema))


def ingest_table(
    spark: SparkSession,
    table: str,
    source_dir: str,
    target_dir: str,
    checkpoint_location: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start loading ``table`` from ``source_dir`` into parquet at
    ``target_dir``. With ``available_now`` the query processes the files
    present and stops; otherwise it keeps watching the folder. Progress is
    kept beside the target (``<target_dir>_progress``) unless a location is
    given, so any later session goes on where this one stopped."""
    stream = csv_stream(spark, table, source_dir)
    cleaned = ROW_CLEANING.get(table, lambda df: df)(stream)
    location = checkpoint_location or target_dir.rstrip("/") + "_progress"
    writer = (
        cleaned.writeStream.format("parquet")
        .option("path", target_dir)
        .option("checkpointLocation", location)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
