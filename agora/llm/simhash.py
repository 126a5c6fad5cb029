"""Near-duplicates by SimHash, linked through a segment-popcount embedding.

A document's fingerprint has a bit set where more than half of its word
shingles' XXH64 values have it set. Fingerprints are cut into segments of
two bits and mapped to the bit count of each segment. The Manhattan distance
of two such vectors never exceeds the Hamming distance of the fingerprints,
so every link lies among the pairs within ``max_distance`` in Manhattan
distance. They are found by a grid join: the segments form
``(max_distance + 2) // 2`` parts, and a pair within the distance is within
one step in at least one part. Every fingerprint is put into the cell of its
counts in each part and also probes the cells one step up, so that a pair
meets in a cell; the full Manhattan bound and then the exact bit distance
decide.

Counts are kept in unary (0: 00, 1: 01, 2: 11), which is the fingerprint with
the bits of each segment sorted; Manhattan distance is then a bit distance.

Only distinct fingerprints enter the grid. Crowded cells are dealt out in
blocks over many tasks, every pair of blocks meeting once; a task reports the
links it verified as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from agora.llm.common import bounded_slices, map_arrow, materialize
from agora.llm.components import components

SEED = 42
BITS = 64
LOW = 0x5555555555555555

FINGERPRINTS = "doc_id long, fp long"


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of lower-cased (A-Z) word shingles, as a signed 64-bit integer;
    the whole sequence is one shingle if there are fewer words, no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashed = xxhash.xxh64_digest
    values = np.frombuffer(b"".join([hashed(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">i8")[0])


def _prints(texts: pa.Array, shingle: int) -> pa.Array:
    return pa.array([fingerprint(t, shingle) for t in texts.cast(pa.binary()).fill_null(b"").to_pylist()], pa.int64())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text); null text: no words."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _prints(part.column("text"), shingle)], schema=out)

    return map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, FINGERPRINTS)


def embedding(fp: Column) -> Column:
    """The counts of all two-bit segments, in unary."""
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW).cast("long")
    return high.bitwiseOR(fp).bitwiseAND(low).bitwiseOR(F.shiftleft(high.bitwiseAND(fp).bitwiseAND(low), 1))


def _cells(distinct: DataFrame, max_distance: int) -> DataFrame:
    """(part, cell, probe, fp): each fingerprint in its own cells (probe
    false) and in the cells one step up in a segment (probe true)."""
    parts = (max_distance + 2) // 2
    segments = BITS // 2
    u = F.col("u")
    cells = []
    for part in range(parts):
        mine = range(part * segments // parts, (part + 1) * segments // parts)
        mask = sum(3 << (2 * s) for s in mine)
        own = u.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long"))
        cells.append(F.struct(F.lit(part).alias("part"), own.alias("cell"), F.lit(False).alias("probe")))
        for s in mine:
            bits = [1 << (2 * s), 2 << (2 * s)]
            low, high = (F.lit(b - (1 << BITS) if b >> (BITS - 1) else b).cast("long") for b in bits)
            up = F.when(u.bitwiseAND(low) == 0, own.bitwiseOR(low)).when(u.bitwiseAND(high) == 0, own.bitwiseOR(high))
            cells.append(F.when(up.isNotNull(), F.struct(F.lit(part).alias("part"), up.alias("cell"), F.lit(True).alias("probe"))))
    return (
        distinct.select("fp", embedding(F.col("fp")).alias("u"))
        .select("fp", F.explode(F.array(*cells)).alias("c"))
        .where("c is not null")
        .select("c.part", "c.cell", "c.probe", "fp")
    )


def _unary(fp: np.ndarray) -> np.ndarray:
    high, low = fp >> np.uint64(1), np.uint64(LOW)
    return ((high | fp) & low) | ((high & fp & low) << np.uint64(1))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reached) of the graph of edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links_in_cells(group: np.ndarray, probe: np.ndarray, fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by group: bit distance at most ``max_distance``
    and not both probes; as a spanning forest. ``group``: number of each row's cell."""
    bits = fp.view(np.uint64)
    unary = _unary(bits)
    left, right = [], []
    at = np.arange(len(fp) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        near = np.bitwise_count(unary[at] ^ unary[at + step]) <= max_distance
        near &= ~(probe[at] & probe[at + step])
        close = at[near]
        close = close[np.bitwise_count(bits[close] ^ bits[close + step]) <= max_distance]
        left.append(fp[close])
        right.append(fp[close + step])
        if sum(map(len, left)) > 1 << 20:
            left, right = ([x] for x in _forest(np.concatenate(left), np.concatenate(right)))
        step += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(left), np.concatenate(right))


def links(distinct: DataFrame, max_distance: int = 3, block: int = 1000) -> DataFrame:
    """Edges (a, b) that connect the same distinct fingerprints (column fp)
    as all pairs within ``max_distance`` bits. A cell of more than ``block``
    rows is dealt out: its rows fall into blocks by hash, and each pair of
    blocks is one group of at most about two blocks of rows."""
    cells = materialize(_cells(distinct, max_distance), "cells")
    # A cell gives links if it holds two rows, one of them in its own cell.
    shared = materialize(
        cells.groupBy("part", "cell")
        .agg(F.count("*").alias("n"), F.min("probe").alias("only_probes"))
        .where("n > 1 and not only_probes")
        .select("part", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "shared",
    )
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    dealt = (
        cells.join(shared, ["part", "cell"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "probe", "fp")
    )
    keys = ["part", "cell", "i", "j"]
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for last, batch in _with_last(batches):
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            key = [rows.column(k).to_numpy() for k in keys]
            change = np.zeros(rows.num_rows, bool)
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            cut = rows.num_rows if last else int(np.flatnonzero(change)[-1]) if change.any() else 0
            held = rows.slice(cut)
            if not cut:
                continue
            a, b = links_in_cells(
                np.cumsum(change)[:cut],
                rows.column("probe").to_numpy()[:cut],
                rows.column("fp").to_numpy()[:cut],
                max_distance,
            )
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

    return map_arrow(dealt.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Each batch that has rows, and whether it is the last one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield False, held
        held = batch
    if held is not None:
        yield True, held


def classes(distinct: DataFrame, max_distance: int = 3) -> DataFrame:
    """Components of distinct fingerprints (fp, first): fp, root (a
    fingerprint that names the component) and least, the smallest ``first``
    of the component (nulls aside)."""
    found = components(links(distinct.select("fp"), max_distance))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    linked = member.join(least, "root").select("fp", "root", "least")
    return distinct.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"),
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp (signed 64-bit)
    and component_id, the smallest doc_id among all documents reachable over
    links of at most ``max_distance`` differing bits, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other; a
    null doc_id is never the smallest (component_id is null if a component
    has no other); repeated rows each give a row; other columns are ignored;
    empty in, empty out.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    # Written first: both sides are then plain scans, and a fingerprint that
    # a third of all rows share is split by the skew join.
    found = materialize(classes(distinct, max_distance).select("fp", F.col("least").alias("component_id")), "classes")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, that of the
    smallest doc_id (nulls last; among equal ids any one); all columns stay."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].cast("string").alias("text"))
    schema = StructType([rows.schema["doc"], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc"), _prints(part.column("text"), shingle)], names=["doc", "fp"])

    # The row numbers are fixed by writing them.
    rows = materialize(map_arrow(rows, run, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    doc_id = F.col("doc.doc_id").cast("long")
    first = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("row"))
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    kept = materialize(classes(distinct, max_distance).select("least.row").distinct(), "kept")
    return rows.join(kept, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
