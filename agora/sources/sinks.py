"""Sinks: the flat table (S3), the normalised tables (S4), a JDBC target.

Tables are replaced all or nothing: a write goes to a new version folder
(``store``), readers see it once it is complete, and a failed write leaves
the version before it in place.

The order-keyed tables are bucketed and sorted by order_id, so their joins
and per-order aggregates need no shuffle, whatever the sizes. Bucketing lives
in the session's catalog, not in the files; the layout is kept beside them
and ``read_tables`` registers the tables with it in any session.
"""

from __future__ import annotations

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agora.functions.metrics import month_label
from agora.model import Tables
from agora.sources import store

MONTH_COLUMN = "purchase_month"

#: Joins by other keys than order_id, made once at the load.
DERIVED = ("item_products", "order_customers")

#: Tables that are bucketed by order_id.
ORDER_TABLES = ("orders", "order_items", "payments", "payment_legs", "reviews", *DERIVED)
LAYOUT = "layout.json"


def _by_month(flat: DataFrame) -> DataFrame:
    return flat.withColumn(MONTH_COLUMN, month_label("order_purchase_timestamp"))


def _clustered(rows: DataFrame) -> DataFrame:
    """Rows as the flat table's files hold them. The REBALANCE hint shuffles
    rows by month and lets AQE split a month holding a large share of the
    rows and merge small months, so files come out near the advisory
    partition size: no task writes a file per month it happens to hold, and
    no single task writes a hot month. Inside a month rows are in order of
    category, then time, so a filter on a category skips the row groups of
    the others by their footers, as one on the time skips other months."""
    return rows.hint("rebalance", MONTH_COLUMN).sortWithinPartitions(MONTH_COLUMN, "product_category_en", "order_purchase_timestamp")


def write_flat_table(flat: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """S3: the flat order table as parquet partitioned by purchase month,
    replacing the one before."""
    spark = flat.sparkSession
    version = store.new_version(spark, path)
    (
        _clustered(_by_month(flat))
        .write.option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(MONTH_COLUMN)
        .parquet(store.folder(path, version))
    )
    store.publish(spark, path, version)
    for old in store.children(spark, path):
        if old.startswith("_digests-") and old != f"_digests-{version:012d}":
            store.remove(spark, f"{path}/{old}")


def read_flat_table(spark: SparkSession, path: str) -> DataFrame:
    """The flat table back; a filter on ``purchase_month`` prunes partitions."""
    # Months are text even where all of them look like numbers.
    return spark.read.parquet(store.current(spark, path)).withColumn(MONTH_COLUMN, F.col(MONTH_COLUMN).cast("string"))


def order_digests(flat: DataFrame) -> DataFrame:
    """(order_id, purchase_month, n, digest): what the flat table holds of
    each order, in two sums over its rows (exact, in any order). The hashes'
    halves are summed as longs and joined per order: a decimal sum per row
    takes far longer."""
    row = F.xxhash64(*[F.col(c) for c in flat.columns])
    halves = _by_month(flat).select("order_id", MONTH_COLUMN, F.shiftright(row, 32).alias("high"), row.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))
    sums = halves.groupBy("order_id", MONTH_COLUMN).agg(F.count(F.lit(1)).alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    digest = (F.col("high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low").cast("decimal(20,0)")).cast("decimal(38,0)")
    return sums.select("order_id", MONTH_COLUMN, "n", digest.alias("digest"))


def changed_months(before: DataFrame, after: DataFrame) -> list[str | None]:
    """Months in which some order's rows differ between two tables of
    ``order_digests`` (come, go, or change); at most as many as partitions."""
    both = before.unionByName(after.withColumns({"n": -F.col("n"), "digest": -F.col("digest")}))
    left = both.groupBy("order_id", MONTH_COLUMN).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))
    months = left.where("n <> 0 or digest <> 0").select(MONTH_COLUMN).distinct().collect()
    return sorted((r[0] for r in months), key=lambda m: (m is not None, m))


def update_flat_table(flat: DataFrame, path: str) -> list[str | None]:
    """S3 kept up to date: brings the stored flat table to ``flat`` by
    rewriting the months of changed orders only; returns these months.
    ``flat`` is read twice: if it is joins, write it first and pass the copy.

    Changes are found from per-order digests of the flat rows; those of the
    stored table are kept beside it, so it is not read. The months are
    replaced by a dynamic partition overwrite, which stages its files and
    moves them when all are written; the other months keep theirs. The
    digests follow last: an update that fails in between is found again by
    the next one. Months that no order is left in are removed."""
    spark = flat.sparkSession
    version = store.current_version(spark, path)
    folder, digests = store.folder(path, version), f"{path}/_digests-{version:012d}"
    try:
        before = spark.read.parquet(store.current(spark, digests))
    except store.NothingPublished:
        before = order_digests(read_flat_table(spark, path).select(*flat.columns))
    number = store.new_version(spark, digests)
    order_digests(flat).write.parquet(store.folder(digests, number))
    after = spark.read.parquet(store.folder(digests, number))
    months = changed_months(before, after)
    if months:
        named = [m for m in months if m is not None]
        chosen = F.col(MONTH_COLUMN).isin(named) | (F.col(MONTH_COLUMN).isNull() if None in months else F.lit(False))
        (
            _clustered(_by_month(flat).where(chosen))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(MONTH_COLUMN)
            .parquet(folder)
        )
        left = {r[0] for r in after.where(chosen).select(MONTH_COLUMN).distinct().collect()}
        for month in set(months) - left:
            store.remove(spark, f"{folder}/{MONTH_COLUMN}={month or '__HIVE_DEFAULT_PARTITION__'}")
    store.publish(spark, digests, number, keep=0)
    return months


def write_parquet_concurrently(outputs: dict[str, DataFrame], max_jobs: int = 4) -> None:
    """Replace each ``path -> DataFrame`` as parquet, submitting the
    independent write jobs from several driver threads so the scheduler
    can run their stages side by side."""

    def write(item: tuple[str, DataFrame]) -> None:
        path, df = item
        df.write.mode("overwrite").parquet(path)

    with ThreadPoolExecutor(max_workers=max_jobs) as pool:
        list(pool.map(write, outputs.items()))


def write_tables(tables: Tables, base_path: str, buckets: int | None = None) -> list[str]:
    """Every table as ``<name>.parquet`` in a new version of ``base_path``
    (the collapsed payments under ``payments``, the legs under
    ``payment_legs``); readers see all of them or none.

    Order-keyed tables are cut into ``buckets`` by order_id, one sorted file
    each (default: the session's shuffle partitions; choose it so that a
    bucket of the largest table is near 128 MB). REBALANCE lets AQE cut the
    other tables' files near the advisory partition size. The joins of items
    with products and of orders with customers are stored too (``DERIVED``)."""
    from agora.operators.cleaning import item_products, order_customers

    spark = tables.orders.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = store.new_version(spark, base_path)
    folder = store.folder(base_path, version)
    named = tables.named()
    if tables.payment_legs is not None:
        named["payment_legs"] = tables.payment_legs
    named["item_products"] = item_products(tables)
    named["order_customers"] = order_customers(tables)
    layout = {n: {"schema": df.schema.jsonValue(), "buckets": buckets if n in ORDER_TABLES else 0} for n, df in named.items()}

    def write(item: tuple[str, DataFrame]) -> None:
        name, df = item
        path = _table_path(folder, name)
        if not layout[name]["buckets"]:
            df.hint("rebalance").write.parquet(path)
            return
        # Shuffled the way buckets are cut: each task writes the one file of its bucket.
        table = _table_name(path)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        df.repartition(buckets, "order_id").write.bucketBy(buckets, "order_id").sortBy("order_id").option("path", path).saveAsTable(table, format="parquet")

    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(write, named.items()))
    store.write_text(spark, f"{folder}/{LAYOUT}", json.dumps(layout))
    store.publish(spark, base_path, version)
    return [_table_path(folder, name) for name in named]


def _table_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def _table_name(path: str) -> str:
    """The catalog's name of a table: the same in every session."""
    return f"agora_{hashlib.md5(path.encode()).hexdigest()}"


REQUIRED_TABLES = ["orders", "customers", "order_items", "payments", "reviews", "products", "sellers", "product_category"]


def _read_stored(spark: SparkSession, folder: str, name: str, layout: dict) -> DataFrame:
    """A stored table, through the catalog if it is bucketed."""
    path, schema = _table_path(folder, name), StructType.fromJson(layout["schema"])
    if not layout["buckets"]:
        return spark.read.schema(schema).parquet(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table_name(path)} ({columns}) USING parquet "
        f"CLUSTERED BY (order_id) SORTED BY (order_id) INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_table_name(path))


def read_tables(spark: SparkSession, base_path: str, optional: tuple[str, ...] = ()) -> Tables:
    """The current version of the tables written by ``write_tables``;
    ``optional`` names further tables to read (``geolocation``,
    ``payment_legs``)."""
    folder = store.current(spark, base_path)
    layout = json.loads(store.read_text(spark, f"{folder}/{LAYOUT}"))
    return Tables(**{n: _read_stored(spark, folder, n, layout[n]) for n in [*REQUIRED_TABLES, *DERIVED, *optional]})


def load_tables(tables: Tables, base_path: str, verify_keys: bool = True) -> Tables:
    """Write cleaned tables once and continue from the written copies.

    Every later query scans compact parquet (filters reach its statistics),
    the cleaning work (payment collapse, category extension) is not redone
    per query, and lineage is cut: a lost executor re-reads files instead of
    replaying the cleaning. ``base_path`` belongs in the shared folder.
    With ``verify_keys`` the written orders and collapsed payments are
    checked for unique order ids (C15), which the per-order metrics rely on.
    """
    from agora.operators.quality import assert_unique_key

    write_tables(tables, base_path)
    optional = tuple(n for n in ("geolocation", "payment_legs") if getattr(tables, n) is not None)
    loaded = read_tables(tables.orders.sparkSession, base_path, optional)
    if verify_keys:
        assert_unique_key(loaded.orders, ["order_id"])
        assert_unique_key(loaded.payments, ["order_id"])
    return loaded


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Replace ``table`` in a JDBC database (driver jar and credentials
    come from the caller; nothing is embedded here)."""
    df.write.jdbc(url=url, table=table, mode="overwrite", properties=properties or {})
