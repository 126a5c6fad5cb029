"""CSV drop reading (S1), parquet sinks (S3, S4) and the streaming loader."""

from __future__ import annotations

import os
import re
import tempfile

import pytest

from pyspark.sql import functions as F

from agora.catalog import clean
from agora.functions.metrics import month_label
from agora.operators import cleaning
from agora.plans.inspect import plan_text
from agora.sources import readers, sinks, store
from agora.sources.schema import CSV_TABLES
from agora.streaming.ingest import ingest_table
from tests.conftest import SF_SMALL
from tests.golden import item, order, tables

ORDERS_CSV = (
    "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    'a1,c1,delivered,2018-01-02 03:04:05,,,2018-01-05 10:00:00,2018-01-10 00:00:00\n'
    'a2,c2,delivered,2018-01-03,NA,,,2018-01-11\n'
    'a3,c3,shipped,x,,,,\n'
)
REVIEWS_CSV = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,a1,5,,"arrived fine,\nthank you ""really""",2018-01-06,2018-01-07\n'
    "r2,a2,1,NA,,2018-01-12,2018-01-13\n"
)
CUSTOMERS_CSV = (
    "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
    "c1,u1,01040,sao paulo,SP\n"
)


def _drop(tmp, name, text):
    os.makedirs(tmp, exist_ok=True)
    with open(os.path.join(tmp, f"{name}.csv"), "w") as f:
        f.write(text)


def test_csv_reader_quotes_newlines_and_tokens(spark):
    tmp = tempfile.mkdtemp(prefix="agora-csv-")
    _drop(tmp, "reviews", REVIEWS_CSV)
    _drop(tmp, "customers", CUSTOMERS_CSV)
    reviews = readers.read_csv_table(
        spark, os.path.join(tmp, "reviews.csv"), CSV_TABLES["reviews"], ["review_comment_title"]
    )
    got = {r["review_id"]: r for r in reviews.collect()}
    assert len(got) == 2
    assert got["r1"]["review_comment_message"] == 'arrived fine,\nthank you "really"'
    assert got["r1"]["review_score"] == 5
    assert got["r2"]["review_comment_title"] is None  # NA mapped to NULL on request
    assert got["r2"]["review_comment_message"] is None  # empty cell
    cust = readers.read_csv_table(spark, os.path.join(tmp, "customers.csv"), CSV_TABLES["customers"]).first()
    assert cust["customer_zip_code_prefix"] == "01040"  # code stays text


def test_csv_orders_are_coerced_and_flagged(spark):
    tmp = tempfile.mkdtemp(prefix="agora-csv-")
    _drop(tmp, "orders", ORDERS_CSV)
    raw = readers.read_csv_table(spark, os.path.join(tmp, "orders.csv"), CSV_TABLES["orders"])
    clean = cleaning.flag_invalid_delivered(cleaning.coerce_order_dates(raw))
    got = {r["order_id"]: r for r in clean.collect()}
    assert str(got["a1"]["order_purchase_timestamp"]) == "2018-01-02 03:04:05"
    assert str(got["a2"]["order_purchase_timestamp"]) == "2018-01-03 00:00:00"
    assert got["a2"]["order_approved_at"] is None  # "NA" is not a date
    assert got["a3"]["order_purchase_timestamp"] is None  # "x" is not a date
    assert [got[k]["is_invalid_delivered"] for k in ("a1", "a2", "a3")] == [False, True, False]


def test_normalised_tables_round_trip(spark, scratch):
    t = tables(spark, orders=[order("A"), order("B")], items=[item("A"), item("B", price="2.50")])
    base = os.path.join(scratch, "normalised")
    sinks.write_tables(t, base)
    sinks.write_tables(t, base)  # replacing is idempotent
    back = sinks.read_tables(spark, base, ("payment_legs",))
    assert back.orders.count() == 2
    assert back.order_items.schema["price"].dataType.simpleString() == "decimal(18,2)"
    assert back.orders.schema["order_purchase_timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert sorted(r[0] for r in back.product_category.collect()) == ["cat_a", "unknown"]


def test_flat_table_sink_partitions_by_month(spark, scratch):
    t = tables(spark, orders=[order("A", purchase=0), order("B", purchase=40)], items=[item("A"), item("B")])
    path = os.path.join(scratch, "flat")
    sinks.write_flat_table(cleaning.flat_orders(t), path)
    flat = sinks.read_flat_table(spark, path)
    parts = sorted(d for d in os.listdir(store.current(spark, path)) if d.startswith("purchase_month="))
    assert parts == ["purchase_month=2018-01", "purchase_month=2018-02"]
    feb = flat.filter(F.col("purchase_month") == "2018-02")
    assert [r["order_id"] for r in feb.collect()] == ["B"]
    assert "PartitionFilters: [isnotnull(purchase_month" in plan_text(feb, "simple")


def test_streaming_ingest_matches_batch(spark, scratch):
    src = tempfile.mkdtemp(prefix="agora-stream-src-")
    _drop(src, "orders", ORDERS_CSV)
    target = os.path.join(scratch, "stream_orders")
    ckpt = os.path.join(scratch, "stream_orders_ckpt")
    q = ingest_table(spark, "orders", src, target, ckpt)
    q.awaitTermination(120)
    streamed = spark.read.parquet(target)
    batch = cleaning.flag_invalid_delivered(
        cleaning.coerce_order_dates(readers.read_csv_table(spark, os.path.join(src, "orders.csv"), CSV_TABLES["orders"]))
    )
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    # A second file is picked up incrementally; the first is not re-read.
    with open(os.path.join(src, "orders_2.csv"), "w") as f:
        f.write(ORDERS_CSV.splitlines()[0] + "\nb1,c9,canceled,2018-02-01,,,,\n")
    q = ingest_table(spark, "orders", src, target, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 4


def test_views_serve_the_sql_api(spark):
    # Tables registered as views answer SQL; Q1 written as SQL equals
    # the DataFrame operator.
    from agora.catalog import clean
    from agora.operators import overview
    from agora.sources.readers import register_views
    from tests.conftest import SF_SMALL

    t = clean(spark, SF_SMALL)
    names = register_views(t, prefix="v_")
    assert "v_orders" in names and "v_payments" in names
    sql = spark.sql(
        """SELECT CAST(ROUND(SUM(p.payment_value), 2) AS DOUBLE) AS total_revenue,
                  COUNT(DISTINCT o.order_id) AS total_orders
           FROM v_orders o JOIN v_payments p USING (order_id)"""
    ).first()
    df = overview.overview_totals(t.orders, t.payments).first()
    assert (sql["total_revenue"], sql["total_orders"]) == (df["total_revenue"], df["total_orders"])


def test_load_refuses_repeated_order_ids(spark, scratch):
    import pytest

    from agora.operators.quality import DuplicateKeyError

    t = tables(spark, orders=[order("A"), order("A", status="canceled")], items=[item("A")])
    with pytest.raises(DuplicateKeyError):
        sinks.load_tables(t, os.path.join(scratch, "dup_orders"))


def test_streaming_ingest_of_reviews_flags_before_filling(spark, scratch):
    src = tempfile.mkdtemp(prefix="agora-stream-rev-")
    _drop(src, "reviews", REVIEWS_CSV)
    target = os.path.join(scratch, "stream_reviews")
    q = ingest_table(spark, "reviews", src, target, os.path.join(scratch, "stream_reviews_ckpt"))
    q.awaitTermination(120)
    got = {r["review_id"]: r for r in spark.read.parquet(target).collect()}
    assert got["r1"]["has_comment"] is True
    assert got["r1"]["review_comment_message"].startswith("arrived fine,\n")
    assert got["r2"]["has_comment"] is False
    assert (got["r2"]["review_comment_message"], got["r2"]["review_comment_title"]) == ("", "")


def test_a_failed_write_leaves_the_tables_as_they_were(spark, tmp_path):
    from pyspark.errors import PySparkException

    base = str(tmp_path / "tables")
    t = clean(spark, SF_SMALL)
    sinks.write_tables(t, base)
    before = {n: df.count() for n, df in sinks.read_tables(spark, base).named().items()}
    # The last rows of one table break the write after others are written.
    broken = t.reviews.withColumn("review_score", F.when(F.col("order_id").isNotNull(), F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(PySparkException, match="lost"):
        sinks.write_tables(t.with_(reviews=broken, orders=t.orders.limit(5)), base)
    assert {n: df.count() for n, df in sinks.read_tables(spark, base).named().items()} == before
    with pytest.raises(PySparkException, match="lost"):
        sinks.write_flat_table(cleaning.flat_orders(t).withColumn("price", F.raise_error(F.lit("lost")).cast("int")), str(tmp_path / "flat"))
    with pytest.raises(store.NothingPublished):
        sinks.read_flat_table(spark, str(tmp_path / "flat"))


def test_old_versions_go_and_open_readers_keep_theirs(spark, tmp_path):
    base = str(tmp_path / "tables")
    t = clean(spark, SF_SMALL)
    sinks.write_tables(t.with_(orders=t.orders.limit(3)), base)
    opened = sinks.read_tables(spark, base)
    # The remains of a write that was killed.
    store.write_text(spark, store.folder(base, store.new_version(spark, base)) + "/half", "")
    sinks.write_tables(t.with_(orders=t.orders.limit(4)), base)
    assert opened.orders.count() == 3
    sinks.write_tables(t.with_(orders=t.orders.limit(5)), base)
    assert sinks.read_tables(spark, base).orders.count() == 5
    assert sorted(p.name for p in (tmp_path / "tables").iterdir()) == ["_published", "v-000000000003", "v-000000000004"]
    assert store.current_version(spark, base) == 4


def test_bucketed_tables_open_in_another_catalog(spark, tmp_path):
    """The layout is beside the data: a session that has never seen the
    tables reads them in buckets."""
    base = str(tmp_path / "tables")
    paths = sinks.write_tables(clean(spark, SF_SMALL), base, buckets=3)
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {sinks._table_name(path)}")
    t = sinks.read_tables(spark, base)
    assert t.orders.groupBy("order_id").count().count() == clean(spark, SF_SMALL).orders.count()
    assert len(t.orders.inputFiles()) == 3


def _files(spark, path):
    """Data files of each month."""
    base = store.current(spark, path)
    return {d: sorted(f for f in os.listdir(os.path.join(base, d)) if f.endswith(".parquet")) for d in os.listdir(base) if d.startswith("purchase_month=")}


def test_flat_table_is_brought_up_to_date_month_by_month(spark, tmp_path):
    path, full = str(tmp_path / "flat"), str(tmp_path / "full")
    old = cleaning.flat_orders(clean(spark, SF_SMALL)).where("order_purchase_timestamp < timestamp_ntz'1997-06-01'")
    sinks.write_flat_table(old, path)
    before = _files(spark, path)
    bought, month = F.col("order_purchase_timestamp"), F.date_format("order_purchase_timestamp", "yyyy-MM")
    # An order of a month changes, one month's orders move to another, one month goes, one comes.
    new = cleaning.flat_orders(clean(spark, SF_SMALL)).where("order_purchase_timestamp < timestamp_ntz'1997-07-01'")
    lost = new.where(month == "1996-02").agg(F.min("order_id")).first()[0]
    new = new.withColumn("order_status", F.when(F.col("order_id") == lost, "lost").otherwise(F.col("order_status")))
    new = new.withColumn("order_purchase_timestamp", F.when(month == "1996-05", F.lit("1996-06-15").cast("timestamp_ntz")).otherwise(bought))
    new = new.where(month != "1995-11")
    months = sinks.update_flat_table(new, path)
    assert months == ["1995-11", "1996-02", "1996-05", "1996-06", "1997-06"]
    sinks.write_flat_table(new, full)
    got, wanted = sinks.read_flat_table(spark, path), sinks.read_flat_table(spark, full)
    assert got.exceptAll(wanted).count() == 0 == wanted.exceptAll(got).count()
    after = _files(spark, path)
    touched = {f"purchase_month={m}" for m in months}
    assert {d: f for d, f in after.items() if d not in touched} == {d: f for d, f in before.items() if d not in touched}
    assert not {"purchase_month=1995-11", "purchase_month=1996-05"} & set(after)
    # Nothing changed: nothing is written, and the stored digests are enough to see it.
    assert sinks.update_flat_table(new, path) == []
    assert _files(spark, path) == after


def test_an_update_without_months_and_with_repeated_rows(spark, tmp_path):
    t = tables(spark, orders=[order("A", purchase=0), order("B", purchase=None)], items=[item("A"), item("A"), item("B")])
    path = str(tmp_path / "flat")
    flat = cleaning.flat_orders(t)
    sinks.write_flat_table(flat, path)
    assert sinks.update_flat_table(flat.where("order_id = 'B'").unionAll(flat.where("order_id = 'B'")), path) == [None, "2018-01"]
    assert [r.order_id for r in sinks.read_flat_table(spark, path).collect()] == ["B", "B"]
    assert sinks.update_flat_table(flat.where("order_id = 'A'"), path) == [None, "2018-01"]
    assert {r.order_id for r in sinks.read_flat_table(spark, path).collect()} == {"A"}


def test_the_update_query_joins_the_flat_rows_once(spark, monkeypatch):
    from agora import catalog

    orders = [order("A", purchase=0), order("B", purchase=None), order("C", purchase=-8333)]
    seen, rows = [], tables(spark, orders=orders, items=[item("A"), item("A"), item("B")])
    monkeypatch.setattr(catalog, "flat", lambda s, d: cleaning.flat_orders(rows))
    for name in ("write_flat_table", "update_flat_table"):
        monkeypatch.setattr(sinks, name, lambda df, path, run=getattr(sinks, name): (seen.append(plan_text(df)), run(df, path))[1])
    # C is of the month with another status, A of a month that is missing, B of none.
    got = {tuple(r) for r in catalog.QUERIES["updated_flat_by_month"](spark, "").collect()}
    assert got == {("1995-03", 1, 1, 1), ("2018-01", 2, 1, 2), (None, 1, 1, 1)}
    assert len(seen) == 2 and not [p for p in seen if "Join" in p or "Aggregate" in p]


def test_order_digests_add_up_longs_to_the_sum_of_the_row_hashes(spark):
    t = tables(spark, orders=[order("A", purchase=0), order("B", purchase=None)], items=[item("A"), item("A"), item("B")])
    flat = cleaning.flat_orders(t)
    flat = flat.unionAll(flat.withColumn("order_status", F.lit(None).cast("string")))
    digests = sinks.order_digests(flat)
    hashes = flat.select("order_id", F.xxhash64(*flat.columns).alias("h")).collect()
    assert min(r.h for r in hashes) < 0 < max(r.h for r in hashes)
    assert {(r.order_id, r.purchase_month, r.n, int(r.digest)) for r in digests.collect()} == {
        (k, m, sum(r.order_id == k for r in hashes), sum(r.h for r in hashes if r.order_id == k)) for k, m in (("A", "2018-01"), ("B", None))
    }
    assert digests.schema["digest"].dataType.simpleString() == "decimal(38,0)"
    assert {"partial_sum(high", "partial_sum(low"} <= set(re.findall(r"partial_sum\(\w+", plan_text(digests)))


def test_month_labels_are_the_start_of_the_text_of_the_time(spark):
    times = ["0001-01-01 00:00:00", "0999-12-31 23:59:59", "1000-01-01 00:00:00", "1582-10-10 12:00:00", "2018-03-25 02:30:00", "9999-12-31 23:59:59.999999", "+10000-02-01 00:00:00", None]
    df = spark.createDataFrame([(x,) for x in times], "x string").select(F.col("x").cast("timestamp_ntz").alias("t"))
    got = df.select(month_label("t").alias("m"), F.substring(F.col("t").cast("string"), 1, 7).alias("text")).collect()
    assert [r.m for r in got] == [r.text for r in got] and got[-1].m is None and got[4].m == "2018-03"


def _reviews_file(rng, records, newline="\n"):
    """A reviews file with quoted line breaks, doubled quotes and blank lines."""
    lines = [",".join(f.name for f in CSV_TABLES["reviews"])]
    for k in range(records):
        message = rng.choice(["", "fine", '"a, b"', '"two' + newline + 'lines"', '"' + newline * 2 + '""quoted""' + newline + '"', '"""x"""', '"' + ("long " * 20 + newline) * rng.randint(1, 6) + '"', "é"])
        lines.append(f"r{k},o{k % 97},{rng.choice([1, 5, 'NA', '', 'x'])},{rng.choice(['', 't', 'NA'])},{message},2018-01-0{k % 9 + 1},")
        if k % 50 == 7:
            lines.append("")
    return newline.join(lines) + (newline if records % 2 else "")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, newline):
    import random

    rng = random.Random(5)
    for name, n in (("a", 700), ("b", 33), ("c", 0)):
        (tmp_path / f"{name}.csv").write_bytes(_reviews_file(rng, n, newline).encode())
    path, schema = str(tmp_path), CSV_TABLES["reviews"]
    wanted = spark.read.schema(schema).options(**readers.csv_options("reviews")).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "5000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.read_csv_table(spark, path, schema, table="reviews").collect()
            blocks = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted(map(str, got)) == sorted(map(str, wanted.collect()))
        assert blocks > 50 or size != "700"


def test_a_record_longer_than_blocks(spark, tmp_path):
    header = ",".join(f.name for f in CSV_TABLES["reviews"])
    body = "word " * 30 + "\n"
    (tmp_path / "r.csv").write_text(f'{header}\nr1,o1,5,,"{body * 40}",,\nr2,o2,4,,"",,\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = {r.review_id: r.review_comment_message for r in readers.read_csv_table(spark, str(tmp_path), CSV_TABLES["reviews"], table="reviews").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["r1"] == body * 40 and set(got) == {"r1", "r2"}


def test_missing_tokens_are_not_unreadable(spark, tmp_path):
    header = ",".join(f.name for f in CSV_TABLES["products"])
    (tmp_path / "products.csv").write_text(f"{header}\np1,cat,NA,1,2,3,4,5,6\np2,cat,x,1,2,3,4,5,6\np3,cat,1,2\np4,NA,1,2,3,,nan,5,6\n")
    for name, schema in CSV_TABLES.items():
        if name not in ("products", "geolocation"):
            (tmp_path / f"{name}.csv").write_text(",".join(f.name for f in schema) + "\n")
    found = readers.corrupt_rows(spark, str(tmp_path), include_geolocation=False).where("table_name = 'products'").first()
    assert (found.n_rows, found.n_corrupt) == (4, 2)
    landed = str(tmp_path / "landed")
    readers.land_csv_tables(spark, str(tmp_path), landed, include_geolocation=False)
    found = readers.landed_corrupt_rows(spark, landed, include_geolocation=False).where("table_name = 'products'").first()
    assert (found.n_rows, found.n_corrupt) == (4, 2)
    products = {r.product_id: r for r in readers.read_landed(spark, landed, False).products.collect()}
    assert products["p1"].product_name_lenght is None and products["p1"].product_weight_g == 3
    assert products["p4"].product_category_name is None


def test_a_restarted_load_goes_on_where_it_stopped(spark, tmp_path):
    """Progress is beside the target, not in the session's own folder."""
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    _drop(src, "orders_1", ORDERS_CSV)
    sc, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    try:
        for number in (1, 2):
            sc.setCheckpointDir(str(tmp_path / f"session_{number}"))
            ingest_table(spark, "orders", src, target).awaitTermination(120)
            assert spark.read.parquet(target).count() == 3
    finally:
        sc.setCheckpointDir(before)
    assert (tmp_path / "out_progress").is_dir()


def test_a_run_removes_its_intermediate_tables_only(spark):
    from agora.session import run_folder, written

    kept = written(spark.range(3), "kept")
    with run_folder(spark):
        outer = written(spark.range(4), "outer")
        with run_folder(spark):
            inner = written(spark.range(5), "inner")
            assert (kept.count(), outer.count(), inner.count()) == (3, 4, 5)
            places = [df.inputFiles()[0].removeprefix("file:") for df in (inner, outer, kept)]
        assert [os.path.exists(p) for p in places] == [False, True, True]
        assert outer.count() == 4
    assert [os.path.exists(p) for p in places] == [False, False, True]


def test_a_category_skips_most_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "flat")
    sinks.write_flat_table(cleaning.flat_orders(clean(spark, SF_SMALL)), path, max_records_per_file=20)
    wanted, kept, groups, months = "brand_1", 0, 0, 0
    for folder, _, files in os.walk(store.current(spark, path)):
        for name in (f for f in files if f.endswith(".parquet")):
            meta = pq.ParquetFile(os.path.join(folder, name)).metadata
            for k in range(meta.num_row_groups):
                stats = {meta.row_group(k).column(c).path_in_schema: meta.row_group(k).column(c).statistics for c in range(meta.num_columns)}
                category = stats["product_category_en"]
                groups += 1
                months += folder.endswith("1996-03")
                kept += category.has_min_max and category.min <= wanted <= category.max
    assert groups > 100 and kept < groups / 2 and months < groups / 20


def test_profile_of_stored_tables_comes_from_footers(spark, tmp_path):
    from agora.operators import quality

    base = str(tmp_path / "tables")
    t = clean(spark, SF_SMALL)
    paths = {os.path.basename(p).removesuffix(".parquet"): p for p in sinks.write_tables(t, base)}
    paths = {n: p for n, p in paths.items() if n in t.named()}
    assert "PushedAggregation: [COUNT(*), COUNT(order_id)" in plan_text(quality.footer_counts(spark, paths["orders"]), "simple")
    got = quality.stored_profile(spark, paths)
    key = lambda r: (r.table_name, r.column_name)
    columns = ["table_name", "column_name", "data_type", "n_rows", "non_null"]
    assert sorted(got.select(*columns).collect(), key=key) == sorted(quality.table_profile(t.named()).select(*columns).collect(), key=key)
    audit = got.where("table_name = 'orders' and null_count > 0").select("column_name", "null_count", "null_percentage")
    assert sorted(audit.collect()) == sorted(quality.null_audit(t.orders).collect())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
