"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, a straight line
from a start to an end weight. Its integral is the source's share of the
demand; water-filling caps a target at ``max_passes`` times the source's
words and gives the excess to the others by weight. A source's documents are
taken in a fixed pseudo-random order, pass after pass, until its target is
met to the nearest document. A copy that starts at a fraction u of the
source's demand is trained on at the time t at which the integrated schedule
reaches u, and the training order is a range sort by t.

Cumulative sums need no window over a whole source: documents fall into
buckets by their order key, bucket sums give each bucket's offset, and only
the rows of one bucket are summed in order. All steps are DataFrame
operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.llm.common import WORD, materialize


@dataclass(frozen=True)
class Curriculum:
    """``ramps``: start and end weight of the schedules, dealt to the sources
    in code-point order (null last) again and again; the mean of a ramp is
    the source's weight. ``budget``: words of the mix per word of input.
    ``bucket_rows``: rows of the largest source in a bucket."""

    ramps: tuple[tuple[float, float], ...] = ((2.0, 4.0), (1.0, 1.0), (3.0, 1.0))
    budget: float = 1.5
    max_passes: int = 2
    bucket_rows: int = 500


KEY_RANGE = 1 << 60


def order_key(doc_id: Column) -> Column:
    """A fixed pseudo-random position of a document in its source: the first
    15 hex digits of the MD5 of its id (null: of the empty text)."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, plan: Curriculum) -> DataFrame:
    """Targets of (source, source_size): adds the ramp and ``target``, the
    water level times the weight, at most ``max_passes`` times the size. The
    windows run over one row per source."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(plan.ramps)
    ramp = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in plan.ramps]), turn.cast("int") + 1)
    cap = plan.max_passes * F.col("source_size")
    ranked = sources.withColumn("ramp", ramp).withColumn("weight", (F.col("ramp")[0] + F.col("ramp")[1]) / 2)
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    words = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumns({"capped": capped, "open_weight": open_weight, "words": words})
    level = F.max((F.lit(plan.budget) * F.col("words") - F.col("capped")) / F.col("open_weight")).over(Window.partitionBy())
    return ranked.select(
        "source", "source_size", "ramp", "weight",
        F.least(cap.cast("double"), level * F.col("weight")).alias("target"),
    )


def measured(docs: DataFrame, payload: bool) -> DataFrame:
    """(doc_id, source, size, key, tie[, doc]): ``doc`` holds all columns."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order_key(docs["doc_id"]).alias("key"),
        F.xxhash64(docs["text"]).alias("tie"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if payload else []),
    )


def schedule(docs: DataFrame, plan: Curriculum = Curriculum(), payload: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size (its
    words), source, source_size, target, copies, taken = copies * size, and
    positions, the training times of its copies. ``payload`` adds ``doc``, a
    struct of all input columns.

    Null texts have size 0; null sources are one source, the last; a null
    doc_id is an id of its own; rows that agree in source, id and text are
    interchangeable; a source without words has target 0 and one without
    text is never taken; other columns are ignored; empty in, empty out.
    """
    slim = materialize(measured(docs, False), "sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    buckets = sources.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-buckets // plan.bucket_rows))
    width = -(-KEY_RANGE // buckets)
    bucket = F.expr(f"key div {width}").alias("bucket")
    sums = slim.groupBy("source", bucket).agg(F.sum("size").alias("size"))
    offset = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")
    offsets = materialize(
        sums.select("source", "bucket", offset.alias("offset")).join(
            targets(sources.select("source", "source_size"), plan).withColumnRenamed("source", "s"),
            F.col("source").eqNullSafe(F.col("s")),
        ).drop("s"),
        "offsets",
    ).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "ramp", "weight", "target")
    rows = (measured(docs, True) if payload else slim).withColumn("bucket", bucket)
    joined = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie")
    before = F.col("offset") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("full") * F.col("source_size")
    extra = (F.col("full") < plan.max_passes) & (2 * F.col("before") + F.col("size") <= 2 * rest)
    # Time at which the integrated schedule reaches the fraction u: the root
    # of w0 t + (w1 - w0) t^2 / 2 = u (w0 + w1) / 2, in its stable form.
    w0, w1 = F.col("ramp")[0], F.col("ramp")[1]

    def at(copy: Column) -> Column:
        words = copy * F.col("source_size") + F.col("before") + F.col("size") / 2
        u = F.least(F.lit(1.0), words / F.col("target"))
        need = u * F.col("weight")
        return 2 * need / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * (w1 - w0) * need)))

    taken = F.when(F.col("target") > 0, F.col("full") + extra.cast("long")).otherwise(0)
    return (
        joined.withColumn("before", before)
        .withColumn("full", full)
        .withColumn("copies", taken.cast("long"))
        .select(
            "doc_id", "size", "source", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            F.array_compact(
                F.array(*[F.when(F.col("copies") > k, at(F.lit(k))) for k in range(plan.max_passes)])
            ).alias("positions"),
            *(["doc"] if payload else []),
        )
    )


def mix(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per copy taken, range
    sorted by training time (ties by id)."""
    found = schedule(docs, plan, payload=True)
    names = docs.columns
    return (
        found.select("doc", F.explode("positions").alias("position"), "doc_id")
        .orderBy("position", "doc_id")
        .select(*[F.col("doc").getField(c).alias(c) for c in names])
    )


#: The query's result in SQL: doc_id, size, source_size, target, taken.
SCHEDULE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS w
  FROM sized GROUP BY source
), level AS (
  SELECT max((1.5::DOUBLE * (SELECT sum(s) FROM src)::DOUBLE - below) / above) AS y
  FROM (SELECT coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
               sum(w) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
        FROM src)
), goal AS (
  SELECT source, s, least((2 * s)::DOUBLE, y * w) AS target FROM src, level
), placed AS (
  SELECT d.doc_id, d.size, g.s AS source_size, g.target,
         CASE WHEN g.s > 0 THEN floor(g.target / g.s)::BIGINT ELSE 0 END AS passes,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS before
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN target > 0 THEN size * (passes + CASE WHEN passes < 2 AND 2 * before + size <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END)
            ELSE 0 END::BIGINT AS taken
FROM placed
"""
