"""Similarity join of documents on their sets of word shingles, by
token-combination prefixes.

Two different sets of sizes m and n link when 100 * |intersection| >=
percent * |union|, that is when their symmetric difference d keeps
(100 + percent) * d <= (100 - percent) * (m + n). A set of n shingles then
lacks at most ``spare = n * (100 - percent) // 100`` of its shingles in any
partner.

1. Equal sets are one class; only classes are searched.
2. Pruning. Of a fixed share of all shingle values (the same for every
   document) those that a single class holds are counted; a class with more
   than ``spare`` of them has no partner. Nothing else is dropped.
3. Prefixes. The shingles of the classes that remain are put in one order,
   rare ones first. Shingles of a single class are dead. A rare shingle (at
   most ``rare`` classes) counts one, a frequent one belongs to one of a few
   groups, and a group of c frequent shingles counts c - 1. The prefix is
   extended until the counts, dead ones included, exceed ``spare``. Then at
   least one rare shingle, or two frequent ones of one group, is shared by
   both prefixes of a linked pair: rare shingles are indexed alone, frequent
   ones as pairs within their group. The number of groups follows the band of
   sizes (powers of two); a set whose partners may lie in the next band is
   indexed there too.
4. Candidates that share an index key must also pass the bound on sizes and
   on the Manhattan distance of 64 counts by shingle value, which never
   exceeds the symmetric difference. A key's rows report a spanning forest
   of what is left, never all pairs.
5. Verification. Every cluster of candidates holds each of its sets once;
   exact intersections inside a cluster give the links, again as a forest.

Keys and clusters of many rows are dealt out in blocks, every pair of blocks
meeting once. Shingles are 64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.llm.common import bounded_slices, map_arrow, materialize, split_words
from agora.llm.components import components
from agora.llm.simhash import _forest, _with_last

#: Counts of shingles by value that bound the symmetric difference.
CELLS = 64
_U = np.uint64


def _mix(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The next state of a 64-bit hash over words, from their hashes."""
    with np.errstate(over="ignore"):
        z = (state ^ word) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit values: text k's
    are ``values[bounds[k]:bounds[k + 1]]``. Words are lower-cased in A-Z; a
    text of fewer words gives its whole sequence, without words none."""
    split, at = split_words(pc.ascii_lower(texts.fill_null("")))
    coded = split.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), _U, len(coded.dictionary))
    hashed = known[coded.indices.to_numpy(zero_copy_only=False)] if len(split) else np.empty(0, _U)
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(counts)), counts)
    found, owners = [], []
    for length in range(1, words + 1):
        if length == words:
            first = np.flatnonzero(np.arange(len(owner)) + length <= at[1:][owner]) if len(owner) else np.empty(0, np.int64)
        else:
            first = at[:-1][counts == length]
        state = np.full(len(first), length, _U)
        for k in range(length):
            state = _mix(state, hashed[first + k])
        found.append(state)
        owners.append(owner[first])
    value, of = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(counts) + 1))


def _set_keys(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit name of each set, as two signed integers."""
    raw = value.tobytes()
    digests = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def _sets(docs: DataFrame, words: int, sets: bool) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, code, n, k1, k2) per row: code
    names the text, k1 and k2 the set of n shingles; with ``sets`` also those."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("code"), "text")
    fields = [("doc_id", pa.int64()), ("code", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]
    out = pa.schema([*fields, *([("shingles", pa.list_(pa.int64()))] if sets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            value, bounds = shingle_sets(part.column("text"), words)
            key = _set_keys(value, bounds)
            columns = [part.column("doc_id"), part.column("code"), pa.array(np.diff(bounds)), pa.array(key[:, 0]), pa.array(key[:, 1])]
            if sets:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    schema = "doc_id long, code long, n long, k1 long, k2 long" + (", shingles array<long>" if sets else "")
    return map_arrow(rows, run, schema)


def _probes(docs: DataFrame, words: int, least: int, share: float) -> DataFrame:
    """(token, k1): the shingles below a fixed value of sets of ``least`` or more."""
    out = pa.schema([("token", pa.int64()), ("k1", pa.int64())])
    limit = _U(int(share * (1 << 64))) if share < 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            value, bounds = shingle_sets(part.column("text"), words)
            key, size = _set_keys(value, bounds)[:, 0], np.diff(bounds)
            owner = np.repeat(np.arange(len(size)), size)
            taken = size[owner] >= least
            if limit is not None:
                taken &= value < limit
            yield pa.RecordBatch.from_arrays([pa.array(value[taken].view(np.int64)), pa.array(key[owner[taken]])], schema=out)

    return map_arrow(docs.select(docs["text"].cast("string").alias("text")), run, "token long, k1 long")


def _spare(percent: int) -> Column:
    return F.floor(F.col("n") * (100 - percent) / F.lit(100))


def _candidates(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(sid, n, shingles) of every class that step 2 leaves."""
    least = -(-percent // (100 - percent))
    held = _probes(docs, words, least, min(1.0, 2 * (100 - percent) / 100)).groupBy("token").agg(F.min("k1").alias("k1"), F.max("k1").alias("other"))
    alone = held.where("k1 = other").groupBy("k1").agg(F.count("*").alias("alone"))
    # Two sets of one k1 (a chance of 2**-64 a pair) would count each other's shingles as their own.
    twins = F.count("*").over(Window.partitionBy("k1")) > 1
    left = (
        classes.where(F.col("n") >= least)
        .withColumn("twins", twins)
        .join(alone, "k1", "left")
        .where(F.col("twins") | F.col("alone").isNull() | (F.col("alone") <= _spare(percent)))
        .select("code")
    )
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # Never a broadcast: what step 2 leaves grows with the input.
    chosen = texts.withColumn("code", F.xxhash64("text")).join(materialize(left.distinct(), "chosen").hint("merge"), "code", "left_semi")
    found = _sets(chosen, words, sets=True).groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    return materialize(found.withColumn("sid", F.monotonically_increasing_id()), "candidates")


def _live(found: DataFrame, percent: int) -> DataFrame:
    """(sid, n, live): the shingles that other candidates share, with their
    numbers of candidates, for candidates with at most ``spare`` dead ones."""
    tokens = found.select("sid", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = tokens.join(shared, "token").groupBy("sid").agg(F.collect_list(F.struct("df", "token")).alias("live"))
    kept = found.select("sid", "n").join(lists, "sid").where(F.col("n") - F.size("live") <= _spare(percent))
    return materialize(kept.select("sid", "n", F.array_sort("live").alias("live")), "live")


def prefix_keys(n: int, df: np.ndarray, token: np.ndarray, percent: int, rare: int) -> list[int]:
    """Index keys of a set of ``n`` shingles whose live ones are ``token``,
    in the order of ``df``."""
    spare = n * (100 - percent) // 100
    band = n.bit_length() - 1
    bands = [band, band + 1] if n * 100 // percent >= 2 << band else [band]
    keys: list[int] = []
    for band in bands:
        groups = max(1, (1 << band) * (100 - percent) // 400)
        count, held = n - len(token), {}
        for f, t in zip(df.tolist(), token.tolist(), strict=True):
            if count > spare:
                break
            if f <= rare:
                count += 1
                keys.append(xxhash.xxh64_intdigest(b"%d %d" % (band, t)))
            else:
                others = held.setdefault((t * 0x9E3779B97F4A7C15 >> 32) % groups, [])
                count += bool(others)
                keys += [xxhash.xxh64_intdigest(b"%d %d %d" % (band, o, t)) for o in others]
                others.append(t)
    return keys


def _index(live: DataFrame, percent: int, rare: int) -> DataFrame:
    """(key, sid, n, dead, counts) for every index key of every candidate."""
    out = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("dead", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("live")
            at = lists.offsets.to_numpy()
            entries = lists.values
            df, token = (entries.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k, (sid, n) in enumerate(zip(batch.column("sid").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                mine = slice(at[k], at[k + 1])
                keys = np.array(prefix_keys(n, df[mine], token[mine], percent, rare), _U)
                if not len(keys):
                    continue
                cells = np.bincount((token[mine].view(_U) >> _U(58)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                same = lambda x, kind: pa.array([x] * len(keys), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), same(sid, pa.int64()), same(n, pa.int64()), same(n - (at[k + 1] - at[k]), pa.int64()), same(cells.tobytes(), pa.binary())],
                    schema=out,
                )

    return map_arrow(live, run, "key long, sid long, n long, dead long, counts binary")


def _dealt(rows: DataFrame, key: str, crowded: DataFrame) -> DataFrame:
    """``rows`` with i and j: a key listed in ``crowded`` (key, blocks) falls
    into blocks by the hash of sid, and each pair of blocks is one group."""
    own = F.pmod(F.xxhash64("sid"), F.coalesce("blocks", F.lit(1))).cast("int")
    return (
        rows.join(crowded, key, "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("blocks", "other")
    )


def _by_group(rows: DataFrame, keys: list[str], order: list[str], run) -> DataFrame:
    """Edges (a, b) that ``run`` finds in whole groups of rows."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for last, batch in _with_last(batches):
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            change = np.zeros(rows.num_rows, bool)
            for k in keys:
                x = rows.column(k).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(change)
            cut = rows.num_rows if last else int(starts[-1]) if len(starts) else 0
            held = rows.slice(cut)
            if cut:
                a, b = run(rows.slice(0, cut), np.cumsum(change)[:cut])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys, *order), task, "a long, b long")


def _pairs_in_groups(rows: pa.Table, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Step 4 over rows sorted by group and n."""
    n, dead, sid = (rows.column(k).to_numpy() for k in ("n", "dead", "sid"))
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32).reshape(-1, CELLS).astype(np.int32)
    own = rows.column("own").to_numpy()
    split = rows.column("i").to_numpy() != rows.column("j").to_numpy()
    left, right = [], []
    at, step = np.arange(len(n)), 0
    while len(at):
        step += 1
        at = at[at + step < len(n)]
        at = at[(group[at] == group[at + step]) & (100 * n[at] >= percent * n[at + step])]
        for some in np.array_split(at, len(at) // 65536 + 1):
            # Inside one block the pair meets in that block's own group.
            some = some[~split[some] | (own[some] != own[some + step])]
            far = np.abs(counts[some] - counts[some + step]).sum(axis=1) + dead[some] + dead[some + step]
            near = some[(100 + percent) * far <= (100 - percent) * (n[some] + n[some + step])]
            left.append(sid[near])
            right.append(sid[near + step])
        if sum(map(len, left)) > 1 << 20:
            left, right = ([x] for x in _forest(np.concatenate(left), np.concatenate(right)))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(left), np.concatenate(right))


def intersections(value: np.ndarray, owner: np.ndarray, sets: int, width: int = 4096) -> np.ndarray:
    """The sizes of all intersections of ``sets`` sets."""
    seen, at, often = np.unique(value, return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    kept = often[at] > 1
    at, owner = column[at[kept]], owner[kept]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    total = np.zeros((sets, sets))
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, [start, start + width])
        block = np.zeros((sets, width), np.float32)
        block[owner[lo:hi], at[lo:hi] - start] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _links_in_clusters(rows: pa.Table, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Step 5 over rows sorted by group."""
    n, sid = (rows.column(k).to_numpy() for k in ("n", "sid"))
    lists = rows.column("tokens").combine_chunks()
    at, token = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    left, right = [], []
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(n)], strict=True):
        size = n[a:b]
        common = intersections(token[at[a] : at[b]], np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), b - a)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        x, y = np.nonzero(np.triu(linked, 1))
        if len(x):
            x, y = _forest(sid[a:b][x], sid[a:b][y])
            left.append(x)
            right.append(y)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(docs: DataFrame, classes: DataFrame, words: int = 5, percent: int = 80, rare: int = 16, block: int = 500) -> tuple[DataFrame, DataFrame]:
    """Candidates (sid, k1, k2) and edges (a, b) between them that connect the
    same sets as all links between different sets of ``classes``."""
    found = _candidates(docs, classes, words, percent)
    live = _live(found, percent)
    index = materialize(_index(live, percent, rare), "index")
    sizes = index.groupBy("key").agg(F.count("*").alias("rows"))
    # A key of a single row gives no candidate.
    index = index.join(materialize(sizes.where("rows > 1").select("key"), "keys"), "key", "left_semi")
    crowded = materialize(sizes.where(F.col("rows") > block).select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "crowded")
    near = _by_group(_dealt(index, "key", crowded), ["key", "i", "j"], ["n"], lambda rows, group: _pairs_in_groups(rows, group, percent))
    clusters = materialize(components(near), "clusters")
    member = clusters.join(live, clusters["node"] == live["sid"]).select(
        F.col("root").alias("cluster"), "sid", "n", F.col("live.token").alias("tokens")
    )
    member = materialize(member, "members")
    # A block holds about ``block`` sets or a million shingles.
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.size("tokens")) / F.lit(1 << 20))).cast("int")
    crowded = materialize(member.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1"), "crowded")
    edges = _by_group(_dealt(member, "cluster", crowded), ["cluster", "i", "j"], [], lambda rows, group: _links_in_clusters(rows, group, percent))
    return found.select("sid", "k1", "k2"), edges


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles (the
    size of its set of distinct shingles of ``words`` words) and component_id,
    the smallest doc_id among all documents that it reaches over links, itself
    included. Two documents link when their sets' Jaccard similarity is at
    least ``percent`` (80 to 100) in a hundred.

    Null and empty texts, and texts without words, have an empty set and are
    linked with nothing: each is its own component. A null doc_id is never
    the smallest (null if a component has no other id); repeated rows each
    give a row; other columns are ignored; empty in, empty out.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    rows = materialize(_sets(docs, words, sets=False), "sets")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min("code").alias("code"), F.min("n").alias("n"))
    classes = materialize(classes, "classes")
    if percent < 100:
        found, edges = links(docs, classes, words, percent)
        # A cluster's links may arrive from several pairs of blocks.
        root = components(edges)
        linked = root.join(found, root["node"] == found["sid"]).select("root", "k1", "k2")
        linked = materialize(linked.join(classes, ["k1", "k2"]).select("root", "k1", "k2", "least"), "linked")
        lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
        classes = classes.select("k1", "k2", "least").join(linked.join(lowest, "root").select("k1", "k2", "lowest"), ["k1", "k2"], "left")
        classes = materialize(classes.select("k1", "k2", F.coalesce("lowest", "least").alias("least")), "roots")
    full = rows.where("n > 0").join(classes.select("k1", "k2", "least"), ["k1", "k2"])
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id")).unionAll(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )
