"""Records of CSV files whose quoted fields hold line breaks, read in parallel.

Spark's ``multiLine`` reader takes a whole file in one task. Here a file's
blocks are read as lines by as many tasks as it has blocks. Whether a line
begins inside a quoted field depends on the number of quotes before it: the
quotes of each block are counted first, summed up over the blocks before it
(one row per block), and added to the count inside the block. Lines are then
put together inside their block; only the pieces of records that a block's
end cuts (at most two per block) meet their other parts.

Quotes must be those of quoted fields, doubled inside them (RFC 4180): a lone
quote inside an unquoted field would turn the rest of its file inside out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        F.regexp_count("value", F.lit('"')).alias("quotes"),
    )


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, is_header, record) of the CSV files under ``path``, without
    blank lines; a record keeps the line breaks inside its quotes."""
    lines = _lines(spark, path)
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")
    blocks = lines.groupBy(*BLOCK).agg(F.sum("quotes").alias("total")).select(*BLOCK, "total", before.alias("before"))
    inside = Window.partitionBy(*BLOCK).orderBy("line")
    earlier = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ((F.col("before") + earlier) % 2 == 0).cast("int")
    pieces = (
        lines.join(blocks, BLOCK)
        .withColumn("starts", starts)
        # 0: the rest of a record that an earlier block begins.
        .withColumn("piece", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*BLOCK, "piece")
        .agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"), F.first((F.col("before") + F.col("total")) % 2 == 1).alias("cut"))
        .withColumn("last", F.col("piece") == F.max("piece").over(Window.partitionBy(*BLOCK)))
        .withColumn("text", F.array_join(F.col("parts.value"), "\n"))
    )
    open_ = (F.col("piece") == 0) | (F.col("cut") & F.col("last"))
    whole = pieces.where(~open_).select("file", ((F.col("block") == 0) & (F.col("piece") == 1)).alias("is_header"), "text")
    along = Window.partitionBy("file").orderBy("block", "piece")
    joined = (
        pieces.where(open_)
        .withColumn("record", F.sum((F.col("piece") > 0).cast("int")).over(along))
        .groupBy("file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))).alias("parts"))
        .select("file", ((F.col("parts")[0]["block"] == 0) & (F.col("parts")[0]["piece"] == 1)).alias("is_header"), F.array_join("parts.text", "\n").alias("text"))
    )
    # Line ends are \n, as the multiLine reader makes them.
    record = F.rtrim(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"))
    return whole.unionAll(joined).select("file", "is_header", record.alias("record")).where("record <> ''")


def parse_records(records: DataFrame, schema: StructType, options: dict[str, str]) -> DataFrame:
    """The data records as columns of ``schema``; every file's header must
    name its columns in the order of the schema, else the query fails."""
    corrupt = options.get("columnNameOfCorruptRecord")
    names = [f.name for f in schema if f.name != corrupt]
    headers = ", ".join(f"_{k} string" for k in range(len(names) + 1))
    named = F.from_csv(F.regexp_replace("record", "^﻿", ""), headers, {k: options[k] for k in ("quote", "escape")})
    same = F.array(*[named[f"_{k}"] for k in range(len(names))]).eqNullSafe(F.array(*map(F.lit, names)))
    wrong = F.concat(F.lit("CSV header does not conform to the schema in "), F.col("file"), F.lit(": "), F.col("record"))
    kept = F.when(F.col("is_header"), F.when(same, F.lit(False)).otherwise(F.raise_error(wrong).cast("boolean"))).otherwise(F.lit(True))
    parse = {k: v for k, v in options.items() if k not in ("header", "multiLine", "enforceSchema")}
    return records.where(kept).select(F.from_csv("record", schema.toDDL(), parse).alias("r")).select("r.*")
