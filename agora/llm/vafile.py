"""Exact top-k inner-product search with a vector-approximation file.

Every component is quantised to a cell of its dimension (one byte); the
cells bound a query's score of a vector from below and above. The search
scans the approximations only, in blocks of queries against blocks of
vectors, and keeps the vectors whose upper bound reaches the block's k-th
best lower bound; the k-th best lower bound over all blocks prunes again.
Exact vectors are then read in order of their upper bound (the least
possible distance): first as many as could settle the query, then exactly
those whose bound still reaches the k-th exact score, after which the result
is certain.

Equal vectors are searched once, with the smallest k + 1 ids of each (no
others can appear in a result), so a vector that a third of the rows share
is one vector. Cell limits are quantiles of a bounded sample; the outermost
cells of a block end at the block's own extremes, so every vector is
indexed and every bound holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.llm.common import map_arrow, materialize


@dataclass(frozen=True)
class Search:
    """``k``: results of a query; ``cells`` of a dimension (at most 256);
    ``sample``: vectors the cell limits are fitted on; block sizes, which
    decide how often approximations and queries are copied (once per block of
    the other side), and ``step``, the queries that a task works off at a
    time, which decides its memory;
    ``salts``: shares into which the ids of equal vectors are dealt before
    the smallest are found."""

    k: int = 10
    cells: int = 256
    sample: int = 4096
    vector_block: int = 16384
    query_block: int = 16384
    step: int = 128
    salts: int = 16


def scaled(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components times ``scale``, rounded down to integers.
    Vectors that are null or have a null, NaN or infinite component, and rows
    without an id, are left out; empty vectors score 0 with everything."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id is not null and embedding is not null")
        .where(good)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    )


def distinct_vectors(vectors: DataFrame, is_query: Column, plan: Search) -> DataFrame:
    """(vid, v, ids, asked): each distinct vector, its smallest id, its
    smallest k + 1 ids in order, and whether a query has it. Ids are dealt
    into salts and cut to k + 1 before and after the shuffle, so no task gets
    all rows of one vector."""
    salted = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(plan.salts)).alias("salt"), is_query.alias("asked"))
    turn = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    asked = salted.groupBy("v").agg(F.max("asked").alias("asked"))
    few = salted.dropDuplicates(["v", "salt", "vec_id"]).withColumn("turn", turn).where(F.col("turn") <= plan.k + 1)
    ids = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, plan.k + 1).alias("ids"))
    return ids.join(asked, "v").select(F.col("ids")[0].alias("vid"), "v", "ids", "asked")


def cell_limits(distinct: DataFrame, plan: Search) -> np.ndarray:
    """Inner cell limits of each dimension, (dimensions, cells - 1): quantiles
    of at most ``sample`` vectors, those with the smallest hash."""
    # Ids are ranked alone; vectors are read for the chosen ones.
    chosen = distinct.select("vid").orderBy(F.xxhash64("vid"), "vid").limit(plan.sample)
    rows = distinct.select("vid", "v").join(F.broadcast(chosen), "vid", "left_semi").orderBy("vid").collect()
    width = distinct.agg(F.max(F.size("v"))).first()[0] or 0
    sample = np.zeros((max(1, len(rows)), width))
    for k, r in enumerate(rows):
        sample[k, : len(r.v)] = r.v
    steps = np.linspace(0, 1, plan.cells + 1)[1:-1]
    return np.ascontiguousarray(np.quantile(sample, steps, axis=0, method="inverted_cdf").T)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list array as a matrix, short ones filled with 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = values
    return out


def approximations(distinct: DataFrame, limits: np.ndarray) -> DataFrame:
    """The approximation file: (vid, code, low, high), a byte per dimension
    and the extremes of the batch it was made in."""
    width = len(limits)
    out = pa.schema([("vid", pa.int64()), ("code", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            v = _matrix(part.column("v"), width)
            codes = np.empty(v.shape, np.uint8)
            for d in range(width):
                codes[:, d] = np.searchsorted(limits[d], v[:, d], side="right")
            low, high = v.min(axis=0).astype("<i8").tobytes(), v.max(axis=0).astype("<i8").tobytes()
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("vid"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([low] * n, pa.binary()), pa.array([high] * n, pa.binary())],
                schema=out,
            )

    return map_arrow(distinct.select("vid", "v"), run, "vid long, code binary, low binary, high binary")


def bounds(queries: np.ndarray, codes: np.ndarray, limits: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries (rows) against vectors
    (columns) known by their cells and by the extremes of each dimension."""
    dims = np.arange(limits.shape[0])
    bottom = np.concatenate([np.full((len(dims), 1), -np.inf), limits], axis=1)
    top = np.concatenate([limits - 1, np.full((len(dims), 1), np.inf)], axis=1)
    lo = np.maximum(bottom[dims, codes], low)
    hi = np.maximum(lo, np.minimum(top[dims, codes], high))
    middle, radius = (lo + hi) / 2, (hi - lo) / 2
    at, slack = queries @ middle.T, np.abs(queries) @ radius.T
    # Rounding of the floating-point sums, far above its possible size.
    slack += 1e-12 * (np.abs(queries) @ (np.abs(middle) + radius).T)
    return at - slack, at + slack


def filtered(queries: DataFrame, codes: DataFrame, limits: np.ndarray, plan: Search) -> DataFrame:
    """(qid, vid, lower, upper): for every query (qid, v) the vectors that may
    be among its best k + 1, from the approximations alone.

    Blocks of queries meet blocks of vectors in an equi-join on the query
    block and a share of the vector blocks; a task holds one block of each."""
    width, keep = len(limits), plan.k + 1
    n_vectors, n_queries = codes.count(), queries.count()
    vector_blocks, query_blocks = (max(1, -(-n // size)) for n, size in ((n_vectors, plan.vector_block), (n_queries, plan.query_block)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = codes.groupBy(block("vid", vector_blocks).alias("vb")).agg(
        F.collect_list(F.struct("vid", "code")).alias("vectors"),
        F.collect_set("low").alias("lows"),
        F.collect_set("high").alias("highs"),
    )
    right = queries.groupBy(block("qid", query_blocks).alias("qb")).agg(F.collect_list(F.struct("qid", "v")).alias("queries"))
    left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = right.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))))
    pairs = left.join(right, ["vb", "qb"]).select("vectors", "lows", "highs", "queries")
    out = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                vectors, lows, highs, asked = (batch.column(c)[k].values for c in ("vectors", "lows", "highs", "queries"))
                low = np.min([np.frombuffer(x.as_py(), "<i8") for x in lows], axis=0)
                high = np.max([np.frombuffer(x.as_py(), "<i8") for x in highs], axis=0)
                vid = vectors.field("vid").to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(vectors.field("code").to_pylist()), np.uint8).reshape(len(vid), width)
                qid = asked.field("qid").to_numpy(zero_copy_only=False)
                q = _matrix(asked.field("v"), width).astype(np.float64)
                for at in range(0, len(qid), plan.step):
                    lower, upper = bounds(q[at : at + plan.step], code, limits, low, high)
                    if len(vid) > keep:
                        best = np.partition(lower, len(vid) - keep, axis=1)[:, len(vid) - keep]
                        row, col = np.nonzero(upper >= best[:, None])
                    else:
                        row, col = np.nonzero(np.ones(lower.shape, bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qid[at + row]), pa.array(vid[col]), pa.array(lower[row, col]), pa.array(upper[row, col])], schema=out
                    )

    found = materialize(map_arrow(pairs, run, "qid long, vid long, lower double, upper double"), "filtered")
    return _reaching(found, "lower", keep)


def _reaching(found: DataFrame, score: str, keep: int) -> DataFrame:
    """Rows whose upper bound reaches their query's keep-th best ``score``."""
    turn = F.row_number().over(Window.partitionBy("qid").orderBy(F.col(score).desc()))
    least = found.select("qid", score).withColumn("turn", turn).where(F.col("turn") <= keep)
    least = least.groupBy("qid").agg(F.min(score).alias("least"), F.count("*").alias("n"))
    return found.join(least, "qid").where((F.col("n") < keep) | (F.col("upper") >= F.col("least"))).drop("least", "n")


def _exact(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(qid, vid, upper, score) with the exact score from the vectors."""
    product = F.aggregate(
        F.zip_with("v", "q", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x
    )
    asked = distinct.where("asked").select(F.col("vid").alias("qid"), F.col("v").alias("q"))
    return pairs.join(distinct.select("vid", "v"), "vid").join(asked, "qid").select("qid", "vid", "upper", product.alias("score"))


def top_k(rows: DataFrame, is_query: Column, scale: int = 1024, plan: Search = Search()) -> DataFrame:
    """The ``plan.k`` best rows for every query row: (query_id, rank, vec_id,
    score), score being the inner product of the scaled integer vectors, ties
    to the smaller vec_id; all others, if fewer.

    ``rows``: vec_id, embedding; ``is_query``: a condition on vec_id. Rows
    left out by ``scaled`` take no part. Repeated rows count once; a row
    with the query's own id is never its result; of vectors of different
    lengths the common components count; other columns are ignored; an empty
    table or no queries give an empty result.
    """
    keep = plan.k + 1
    vectors = materialize(scaled(rows, scale), "vectors")
    distinct = materialize(distinct_vectors(vectors, is_query, plan), "distinct")
    limits = cell_limits(distinct, plan)
    codes = materialize(approximations(distinct, limits), "approximations")
    asked = distinct.where("asked").select(F.col("vid").alias("qid"), "v")
    near = materialize(filtered(asked, codes, limits, plan), "near")
    # Exact vectors in order of their bounds: the first settle most queries,
    # the second read gets all that can still reach the k-th exact score.
    turn = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("upper").desc(), "vid"))
    first = materialize(_exact(near.withColumn("turn", turn).where(F.col("turn") <= 2 * keep).drop("turn"), distinct), "first")
    kth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vid"))
    least = first.withColumn("turn", kth).where(F.col("turn") == keep).select("qid", F.col("score").alias("least"))
    rest = near.join(first.select("qid", "vid"), ["qid", "vid"], "left_anti").join(least, "qid").where("upper >= least").drop("least")
    best = (
        first.unionByName(_exact(rest, distinct))
        .withColumn("turn", kth)
        .where(F.col("turn") <= keep)
        .select("qid", "vid", "score")
        .join(distinct.select("vid", "ids"), "vid")
    )
    best = materialize(best.select("qid", "score", "ids"), "best")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    owners = materialize(queries.join(distinct.select(F.col("vid").alias("qid"), "v"), "v").select("query_id", "qid"), "owners")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        owners.join(best, "qid")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .distinct()
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= plan.k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: The query's result in SQL, by brute force.
TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])), 0)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
