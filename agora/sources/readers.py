"""Readers: declared-schema CSV drops (S1) and parquet tables."""

from __future__ import annotations

import csv
import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from agora.model import Tables
from agora.sources import store
from agora.sources.records import parse_records, quoted_records
from agora.sources.schema import CSV_TABLES

# The tokens pandas' read_csv treats as missing by default
# (its documented na_values), which the original load relied on. Spark's CSV
# reader keeps them as text, so they are mapped to NULL per column on request.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def string_columns(schema) -> list[str]:
    """Names of the string columns of a schema (where tokens can appear)."""
    return [f.name for f in schema.fields if f.dataType.simpleString() == "string"]


# Only reviews carry free text with line breaks; the other files can be split.
MULTI_LINE_TABLES = frozenset(["reviews"])

CORRUPT_COLUMN = "_corrupt_record"
UNREADABLE = "unreadable"


class CsvHeaderError(ValueError):
    """A CSV file lacks declared columns."""


def csv_options(table: str, mode: str = "PERMISSIVE") -> dict[str, str]:
    """Reader options of a CSV table, for batch and stream alike: header row,
    quoted fields, doubled quotes as escapes, no inference. Every file's
    header must agree with the schema (``enforceSchema`` off)."""
    return {
        "header": "true",
        "multiLine": str(table in MULTI_LINE_TABLES).lower(),
        "quote": '"',
        "escape": '"',
        "mode": mode,
        "enforceSchema": "false",
        "columnNameOfCorruptRecord": CORRUPT_COLUMN,
    }


def header_schema(spark: SparkSession, path: str, schema: StructType) -> StructType:
    """The declared schema in the order of the file's header; further columns
    are read as text (and dropped by the caller). Raises if one is missing."""
    first = spark.read.text(path).first()
    names = next(csv.reader([first[0].lstrip("\ufeff")])) if first else [f.name for f in schema]
    declared = {f.name: f for f in schema}
    missing = [n for n in declared if n not in names]
    if missing:
        raise CsvHeaderError(f"{path}: missing columns {missing}, found {names}")
    return StructType([declared.get(n, StructField(n, StringType())) for n in names])


def null_tokens_out(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The missing-value tokens of the original load as NULL in ``columns``."""
    for name in columns or []:
        df = df.withColumn(name, F.when(~F.col(name).isin(NULL_TOKENS), F.col(name)))
    return df


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: StructType,
    null_token_columns: list[str] | None = None,
    table: str = "reviews",
    mode: str = "PERMISSIVE",
    keep_corrupt: bool = False,
) -> DataFrame:
    """One CSV table with a declared schema, its columns found by name.

    Files with line breaks in quoted fields are read in parallel too
    (``records``). ``mode`` PERMISSIVE turns what can't be read into NULL
    (``keep_corrupt`` adds the raw line of such rows; ``corrupt_rows`` counts
    them), FAILFAST raises instead."""
    found = header_schema(spark, path, schema)
    if keep_corrupt:
        found = StructType([*found.fields, StructField(CORRUPT_COLUMN, StringType())])
    if table in MULTI_LINE_TABLES:
        df = parse_records(quoted_records(spark, path), found, csv_options(table, mode))
    else:
        df = spark.read.schema(found).options(**csv_options(table, mode)).csv(path)
    kept = [f.name for f in schema] + [CORRUPT_COLUMN] * keep_corrupt
    return null_tokens_out(df.select(*kept), null_token_columns)


def read_csv_tables(
    spark: SparkSession,
    base_path: str,
    file_names: dict[str, str] | None = None,
    null_token_columns: dict[str, list[str]] | None = None,
    include_geolocation: bool = True,
    mode: str = "PERMISSIVE",
) -> Tables:
    """The nine tables of a raw CSV drop (``<table>.csv`` unless renamed).
    Geolocation is only loaded and stored by the analysis; a drop without it
    is read with ``include_geolocation=False``."""
    nulls = null_token_columns or {}
    dfs = {
        table: read_csv_table(spark, path, CSV_TABLES[table], nulls.get(table), table, mode)
        for table, path in _csv_paths(base_path, file_names, include_geolocation).items()
    }
    return Tables(**dfs)


def _csv_paths(base_path: str, file_names: dict[str, str] | None, include_geolocation: bool) -> dict[str, str]:
    names = file_names or {}
    return {
        t: os.path.join(base_path, names.get(t, f"{t}.csv")) for t in CSV_TABLES if include_geolocation or t != "geolocation"
    }


def unreadable(schema: StructType) -> Column:
    """Whether a row read with ``keep_corrupt`` holds something that can't be
    read: a wrong number of fields, or text where a number belongs. Missing-
    value tokens are no such thing; only rows the reader complained about are
    looked at again, as text."""
    text = StructType([*[StructField(f.name, StringType()) for f in schema], StructField(CORRUPT_COLUMN, StringType())])
    again = F.from_csv(CORRUPT_COLUMN, text.toDDL(), {k: v for k, v in csv_options("reviews").items() if k in ("quote", "escape", "mode", "columnNameOfCorruptRecord")})
    lost = [
        F.col(f.name).isNull() & again[f.name].isNotNull() & ~again[f.name].isin(NULL_TOKENS)
        for f in schema
        if f.dataType.simpleString() != "string"
    ]
    bad = again[CORRUPT_COLUMN].isNotNull()
    for x in lost:
        bad = bad | x
    return F.when(F.col(CORRUPT_COLUMN).isNull(), F.lit(False)).otherwise(F.coalesce(bad, F.lit(True)))


def land_csv_tables(
    spark: SparkSession,
    base_path: str,
    target: str,
    file_names: dict[str, str] | None = None,
    null_tokens: bool = True,
    include_geolocation: bool = True,
) -> None:
    """Parse every file of a CSV drop once: its tables, typed, with the flag
    ``unreadable``, become a new version of ``target`` (all or none).
    ``null_tokens``: missing-value tokens in text columns become NULL."""
    version = store.new_version(spark, target)

    def land(item: tuple[str, str]) -> None:
        table, path = item
        schema = CSV_TABLES[table]
        order = header_schema(spark, path, schema)
        df = read_csv_table(spark, path, order, string_columns(schema) if null_tokens else None, table, keep_corrupt=True)
        df = df.withColumn(UNREADABLE, unreadable(order)).select(*[f.name for f in schema], UNREADABLE)
        df.write.parquet(f"{store.folder(target, version)}/{table}.parquet")

    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(land, _csv_paths(base_path, file_names, include_geolocation).items()))
    store.publish(spark, target, version, keep=0)


def read_landed(spark: SparkSession, target: str, include_geolocation: bool = True) -> Tables:
    """The raw tables of ``land_csv_tables``."""
    folder = store.current(spark, target)
    names = [t for t in CSV_TABLES if include_geolocation or t != "geolocation"]
    return Tables(**{t: read_parquet_table(spark, folder, t).drop(UNREADABLE) for t in names})


def landed_corrupt_rows(spark: SparkSession, target: str, include_geolocation: bool = True) -> DataFrame:
    """Per landed table: rows, and rows that could not be read in full."""
    folder = store.current(spark, target)
    parts = [
        read_parquet_table(spark, folder, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(UNREADABLE).alias("n_corrupt"))
        for t in CSV_TABLES
        if include_geolocation or t != "geolocation"
    ]
    return reduce(DataFrame.unionByName, parts)


def corrupt_rows(
    spark: SparkSession, base_path: str, file_names: dict[str, str] | None = None, include_geolocation: bool = True
) -> DataFrame:
    """Per table of a CSV drop: rows, and rows of which some value could not
    be read (wrong number of fields, text where a number belongs; a missing-
    value token is none of these). The checksum makes the reader parse every
    column."""
    out = None
    for table, path in _csv_paths(base_path, file_names, include_geolocation).items():
        schema = header_schema(spark, path, CSV_TABLES[table])
        df = read_csv_table(spark, path, schema, table=table, keep_corrupt=True)
        part = df.agg(
            F.lit(table).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(unreadable(schema)).alias("n_corrupt"),
            F.bit_xor(F.xxhash64(*[f.name for f in schema])).alias("checksum"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def read_parquet_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """A parquet table stored as ``<base_dir>/<name>.parquet`` (file or folder)."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def register_views(tables: Tables, prefix: str = "") -> list[str]:
    """Expose every table to ``spark.sql`` under its name."""
    registered = []
    for name, df in tables.named().items():
        df.createOrReplaceTempView(prefix + name)
        registered.append(prefix + name)
    return registered
