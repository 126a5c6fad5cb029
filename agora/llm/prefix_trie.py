"""The prefix trie of rebuilt conversations, with totals of every subtree.

A node is a distinct sequence of first turns and is named by its depth and
its smallest member conversation, so no sequence is ever held whole. Turns
are sorted by conversation over the cluster; a running polynomial of their
128-bit digests names each prefix, and since it is a sum, a conversation that
lies in several partitions, or takes its first turns from another one, is put
together from parts.

Subtree totals are passed up by time-forward processing. Nodes that a single
conversation passes through form chains whose totals are known. The others
fall into shards: a node with more than ``heavy`` members belongs to the top,
every subtree that hangs from the top is in one shard. Inside a shard nodes
are sorted externally by reverse level order; each takes the messages of its
children from a spilling priority queue and sends its totals to its parent.
Then the shard roots' totals, added up by parent, go through the top in the
same way. ``heavy`` follows the number of turns, so the top has at most
``TOP`` nodes besides the root.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from agora.llm.common import map_arrow, materialize
from agora.llm.simhash import _with_last

#: Multipliers of the two 64-bit polynomials (odd, so that they have inverses).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1

#: Nodes of the top at most, besides the root.
TOP = 50_000
#: Members that make a node heavy at least.
HEAVY = 1000
#: A conversation takes fewer than this many turns from its block's first one.
HEADS = 6
BLOCK = 100
#: Conversation ids in a piece of an end list.
PIECE = 8192


def _power(base: int, exponent: int) -> np.uint64:
    return np.uint64(pow(base, exponent, 1 << 64))


def _digests(roles: pa.Array, texts: pa.Array) -> np.ndarray:
    """128-bit digests of (role, text), as two columns."""
    pairs = zip(roles.cast(pa.binary()).to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)
    raw = b"".join([xxhash.xxh3_128_digest(b"%d:%b%b" % (len(r), r, t)) for r, t in pairs])
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def _turns(conversations: DataFrame) -> DataFrame:
    """(part, conv_id, i, a, b, a0, b0, chars) for every turn, in files
    sorted by conversation: within the partition, the turn's number in its
    conversation and the polynomials up to it (a, b) and before it (a0, b0);
    its code points."""
    text = lambda k: F.coalesce(conversations[k].cast("string"), F.lit("")).alias(k)
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), text("role"), text("text"))
    # Bounds need no whole texts: only turns that tie beyond 64 characters must share a partition.
    rows = (
        rows.where("conv_id is not null")
        .repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64))
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        .select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")
    )
    names = ["part", "conv_id", "i", "a", "b", "a0", "b0", "chars"]
    out = pa.schema([(k, pa.int32() if k == "part" else pa.int64()) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, count, sums = None, 0, [np.uint64(0)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            if open_conv is None or conv[0] != open_conv:
                count, sums = 0, [np.uint64(0)] * 2
            first = np.flatnonzero(new)
            segment = np.cumsum(new) - 1
            local = np.arange(len(conv)) - first[segment]
            i = local + np.where(segment == 0, count, 0)
            digest = _digests(batch.column("role"), batch.column("text"))
            chars = pc.utf8_length(batch.column("text")).to_numpy().astype(np.int64)
            columns = []
            with np.errstate(over="ignore"):
                for k, base in enumerate(BASES):
                    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(local.max()), base, np.uint64))])
                    term = digest[:, k] * powers[local]
                    term[segment == 0] *= _power(base, count)
                    total = np.cumsum(term, dtype=np.uint64)
                    before = total - term
                    carried = np.where(segment == 0, sums[k], np.uint64(0))
                    start = before[first][segment]
                    columns += [total - start + carried, before - start + carried]
                    sums[k] = columns[-2][-1]
            open_conv, count = conv[-1], int(i[-1]) + 1
            a, a0, b, b0 = (pa.array(x.view(np.int64)) for x in columns)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), pa.array(i), a, b, a0, b0, pa.array(chars)], schema=out)

    return materialize(map_arrow(rows, run, ", ".join(f"{k} {'int' if k == 'part' else 'long'}" for k in names)), "turns")


def _carried(turns: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """What to carry into each (conversation, partition) that continues a
    conversation of an earlier partition: turns and polynomials before it.
    Sorted partitions share at most one conversation with the next one, so
    these are fewer than twice the partitions."""
    ends = turns.groupBy("conv_id", "part").agg(F.max(F.struct("i", "a", "b")).alias("end"))
    ends = materialize(ends, "ends")
    several = ends.groupBy("conv_id").count().where("count > 1").select("conv_id")
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    state: dict[int, tuple[int, int, int]] = {}
    for r in sorted(ends.join(several, "conv_id", "left_semi").collect(), key=lambda r: (r.conv_id, r.part)):
        n, a, b = state.get(r.conv_id, (0, 0, 0))
        found[r.conv_id, r.part] = (n, a, b)
        a = (a + pow(BASES[0], n, 1 << 64) * r.end.a) & MASK
        b = (b + pow(BASES[1], n, 1 << 64) * r.end.b) & MASK
        state[r.conv_id] = (n + r.end.i + 1, a, b)
    return found


def _placed(turns: DataFrame) -> DataFrame:
    """(conv_id, p, a, b, a0, b0, chars): turns numbered and summed over the
    whole conversation."""
    carried = _carried(turns)
    names = ["conv_id", "p", "a", "b", "a0", "b0", "chars"]
    out = pa.schema([(k, pa.int64()) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, p = (batch.column(k).to_numpy().copy() for k in ("part", "conv_id", "i"))
            sums = {k: batch.column(k).to_numpy().copy().view(np.uint64) for k in ("a", "b", "a0", "b0")}
            edge = np.flatnonzero((np.diff(conv, prepend=conv[:1] - 1) != 0) | (np.diff(part, prepend=part[:1] - 1) != 0)) if len(conv) else []
            for low, high in zip(edge, [*edge[1:], len(conv)], strict=True) if len(conv) else ():
                n, *before = carried.get((int(conv[low]), int(part[low])), (0, 0, 0))
                if n:
                    p[low:high] += n
                    with np.errstate(over="ignore"):
                        for k, base, so_far in zip("ab", BASES, before, strict=True):
                            for name in (k, k + "0"):
                                sums[name][low:high] = sums[name][low:high] * _power(base, n) + np.uint64(so_far)
            yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(p), *[pa.array(sums[k].view(np.int64)) for k in ("a", "b", "a0", "b0")], batch.column("chars")], schema=out)

    return map_arrow(turns, run, ", ".join(f"{k} long" for k in names))


def _rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, a0, b0, chars, last): every prefix of every
    rebuilt conversation, from depth 0; a, b name it and a0, b0 its parent."""
    placed = _placed(turns)
    heads = placed.where(F.col("p") < HEADS - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "a", "b", "a0", "b0", "chars"))).alias("head"))
    length = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    own = materialize(heads.join(length, "conv_id"), "heads")
    base = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("lead"))
    first = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(base, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.expr("cast(array() as array<struct<p:bigint,a:bigint,b:bigint,a0:bigint,b0:bigint,chars:bigint>>)")
    first = (
        first.withColumn("h", h)
        .withColumn("lead", F.slice(F.coalesce("lead", none), F.lit(1), F.col("h")))
        .withColumn("k", F.size("lead"))
        .withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("turns") - F.col("h")))
    )
    zero = F.lit(0).cast("long")
    at = lambda array, n, k: F.when(n > 0, F.try_element_at(array, n)[k]).otherwise(zero)
    # What the own turns after the first h are shifted by.
    shift = [at("lead", F.col("k"), k).alias("to_" + k) for k in "ab"] + [at("head", F.col("h"), k).alias("from_" + k) for k in "ab"]
    first = materialize(first.select("conv_id", "h", "k", "length", "lead", *shift), "conversations")
    root = F.struct(*[F.lit(-1 if k == "p" else 0).cast("long").alias(k) for k in ("p", "a", "b", "a0", "b0", "chars")])
    led = first.select("conv_id", "length", F.explode(F.concat(F.array(root), "lead")).alias("t"))
    led = led.select("conv_id", (F.col("t.p") + 1).alias("depth"), "t.a", "t.b", "t.a0", "t.b0", "t.chars", (F.col("t.p") + 1 == F.col("length")).alias("last"))
    rest = placed.join(first.drop("lead"), "conv_id").where("p >= h")
    names = ["conv_id", "depth", "a", "b", "a0", "b0", "chars"]
    out = pa.schema([*[(k, pa.int64()) for k in names], ("last", pa.bool_())])
    inverse = [[_power(pow(base, -1, 1 << 64), n) for n in range(HEADS)] for base in BASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda k: batch.column(k).to_numpy()  # noqa: E731, B023
            gap = (get("h") - get("k")).astype(np.int64)
            depth = get("p") - gap + 1
            sums = []
            with np.errstate(over="ignore"):
                for name, back in zip("ab", inverse, strict=True):
                    for k in (name, name + "0"):
                        moved = (get(k).view(np.uint64) - get("from_" + name).view(np.uint64)) * np.array(back)[gap]
                        sums.append(pa.array((moved + get("to_" + name).view(np.uint64)).view(np.int64)))
            a, a0, b, b0 = sums
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth), a, b, a0, b0, batch.column("chars"), pa.array(depth == get("length"))], schema=out)

    own_rows = map_arrow(rest, run, ", ".join(f"{k} long" for k in names) + ", last boolean")
    return materialize(led.select(*names, "last").unionAll(own_rows), "prefixes")


class SpillingQueue:
    """Messages (level, node, children, leaves, saved) in ascending order of
    (level, node). Beyond ``limit`` messages in memory they are sorted and
    written as a run to a temporary file of this task."""

    WIDTH = 5

    def __init__(self, limit: int = 1 << 20, block: int = 1 << 14) -> None:
        self.limit, self.block = limit, block
        self.fresh: list[np.ndarray] = []
        self.held, self.sorted = 0, True
        self.runs: list[list] = []

    def push(self, messages: np.ndarray) -> None:
        self.fresh.append(messages)
        self.held += len(messages)
        self.sorted = False
        if self.held > self.limit:
            self._sort()
            store = tempfile.TemporaryFile()  # noqa: SIM115
            store.write(np.ascontiguousarray(self.fresh[0], np.int64).tobytes())
            store.seek(0)
            self.runs.append([store, np.empty((0, self.WIDTH), np.int64)])
            self.fresh, self.held, self.sorted = [], 0, True

    def _sort(self) -> None:
        if not self.sorted:
            rows = np.concatenate(self.fresh)
            self.fresh, self.sorted = [rows[np.lexsort((rows[:, 1], rows[:, 0]))]], True

    @staticmethod
    def _cut(rows: np.ndarray, level: int, node: int) -> int:
        low, high = np.searchsorted(rows[:, 0], level, "left"), np.searchsorted(rows[:, 0], level, "right")
        return int(low + np.searchsorted(rows[low:high, 1], node, "right"))

    def pop(self, level: int, node: int) -> np.ndarray:
        """All messages up to (level, node)."""
        found = []
        self._sort()
        if self.fresh:
            cut = self._cut(self.fresh[0], level, node)
            found.append(self.fresh[0][:cut])
            self.fresh[0] = self.fresh[0][cut:]
            self.held -= cut
        for run in self.runs:
            while True:
                if not len(run[1]):
                    raw = run[0].read(8 * self.WIDTH * self.block)
                    if not raw:
                        run[0].close()
                        run[0] = None
                        break
                    run[1] = np.frombuffer(raw, np.int64).reshape(-1, self.WIDTH)
                cut = self._cut(run[1], level, node)
                found.append(run[1][:cut])
                run[1] = run[1][cut:]
                if len(run[1]):
                    break
        self.runs = [run for run in self.runs if run[0] is not None]
        return np.concatenate(found) if found else np.empty((0, self.WIDTH), np.int64)


NODE = ["depth", "conv_id", "parent_conv_id", "top", "gain", "children", "leaves", "saved"]


def pass_up(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that arrive deepest first, by conversation within a
    depth. ``children``, ``leaves`` and ``saved`` are what a node has from
    outside, ``gain`` its own saving; it sends its totals to its parent
    unless it is the ``top`` of its shard."""
    queue = SpillingQueue(limit)
    out = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("top", pa.bool_()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, conv = (batch.column(k).to_numpy() for k in ("depth", "conv_id"))
        parent = batch.column("parent_conv_id").fill_null(-1).to_numpy()
        top = batch.column("top").to_numpy(zero_copy_only=False)
        children, leaves, saved = (batch.column(k).to_numpy().copy() for k in ("children", "leaves", "saved"))
        saved += batch.column("gain").to_numpy()
        edges = np.flatnonzero(np.diff(depth, prepend=depth[0] + 1))
        for low, high in zip(edges, [*edges[1:], len(depth)], strict=True):
            level = -int(depth[low])
            got = queue.pop(level, int(conv[high - 1]))
            at = low + np.searchsorted(conv[low:high], got[:, 1])
            for total, k in ((children, 2), (leaves, 3), (saved, 4)):
                np.add.at(total, at, got[:, k])
            leaves[low:high][children[low:high] == 0] = 1
            sent = low + np.flatnonzero(~top[low:high])
            if len(sent):
                queue.push(np.stack([np.full(len(sent), level + 1), parent[sent], np.ones(len(sent), np.int64), leaves[sent], saved[sent]], axis=1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("depth"), batch.column("conv_id"), batch.column("parent_conv_id"), batch.column("top"), pa.array(children), pa.array(leaves), pa.array(saved)], schema=out
        )


TOTALS = "depth long, conv_id long, parent_conv_id long, top boolean, children long, leaves long, saved long"


def _totals(prefixes: DataFrame, shared: DataFrame, heavy: int) -> DataFrame:
    """(depth, conv_id, children, leaves, saved) of the nodes with two or more
    members; ``shared`` has NODE's columns besides top, and a, b, n_convs,
    parent_n."""
    zero = F.lit(0).cast("long")
    in_top = (F.col("n_convs") > heavy) | (F.col("depth") == 0)
    # At most TOP nodes and the root, by the choice of ``heavy``.
    top = materialize(shared.where(in_top), "top")
    below = prefixes.where("depth > 0").join(F.broadcast(top.select("depth", "a", "b")), ["depth", "a", "b"], "left_semi")
    start = below.groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    light = shared.where(~in_top)
    # The shard of a conversation's light nodes: the first node below the top.
    owners = light.select("conv_id").distinct()
    first = prefixes.join(owners, "conv_id", "left_semi").join(start, "conv_id", "left").where(F.col("depth") == F.coalesce("deepest", zero) + 1)
    shard = materialize(first.select("conv_id", F.col("a").alias("shard")), "shards")
    above = (F.col("parent_n") > heavy) | (F.col("depth") == 1)
    light = light.withColumn("top", above).join(shard, "conv_id")
    light = light.repartition("shard").sortWithinPartitions(F.desc("depth"), "conv_id").select(*NODE)
    done = materialize(map_arrow(light, pass_up, TOTALS), "light")
    sent = (
        done.where("top")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))
        .agg(F.count("*").alias("sent"), F.sum("leaves").alias("sent_leaves"), F.sum("saved").alias("sent_saved"))
    )
    add = lambda k, more: (F.col(k) + F.coalesce(more, zero)).alias(k)
    top = top.join(sent, ["depth", "conv_id"], "left").select(
        "depth", "conv_id", "parent_conv_id", (F.col("depth") == 0).alias("top"), "gain", add("children", "sent"), add("leaves", "sent_leaves"), add("saved", "sent_saved")
    )
    top = map_arrow(top.repartition(1).sortWithinPartitions(F.desc("depth"), "conv_id"), pass_up, TOTALS)
    columns = ["depth", "conv_id", "children", "leaves", "saved"]
    return done.select(*columns).unionAll(top.select(*columns))


def _end_lists(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, digest): SHA-256 of each node's member list, from
    ``ends`` (depth, conv_id, member). Members are sorted over the cluster and
    joined in pieces; a node's pieces then pass through one digest."""
    keys = ["depth", "conv_id"]
    pieces = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(k).to_numpy() for k in keys]
            change = np.ones(batch.num_rows, bool)
            change[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
            change[::PIECE] = True
            at = np.flatnonzero(change)
            members = batch.column("member").cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, batch.num_rows), pa.int32()), members)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in (*keys, "member")], pc.binary_join(lists, ",")], schema=pieces)

    out = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("digest", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for last, batch in _with_last(batches):
            done = []
            for depth, conv, piece in zip(*(batch.column(k).to_pylist() for k in (*keys, "piece")), strict=True):
                if node == (depth, conv):
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, conv), hashlib.sha256()
                state.update(piece.encode())
            if last:
                done.append((*node, state.hexdigest()))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], schema=out)

    rows = map_arrow(ends.repartitionByRange(*keys, "member").sortWithinPartitions(*keys, "member"), cut, "depth long, conv_id long, first long, piece string")
    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys, "first"), digest, "depth long, conv_id long, digest string")


def trie(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The nodes of the prefix trie over the rebuilt conversations of
    ``conversations`` (conv_id, turn, role, text).

    Turns are ordered by turn (null first), then by role and text; null role
    or text is empty; repeated rows are turns of their own; rows without
    conv_id take no part; other columns are ignored. Conversation c takes the
    first h = crc32(c in decimal) % 6 turns of conversation c - c % 100 (for
    negative c the remainder is negative too), then its own turns after its
    first h. Node (depth, conv_id): conv_id is the smallest member;
    parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 as the column names say. No conversation: no
    rows, not even the root.
    """
    prefixes = _rebuilt(_turns(conversations))
    grouped = prefixes.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"),
        F.max("a0").alias("a0"),
        F.max("b0").alias("b0"),
        F.count_if("last").alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end"),
    )
    nodes = materialize(grouped, "nodes")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    nodes = materialize(nodes.join(parent, ["depth", "a0", "b0"], "left"), "linked")
    zero = F.lit(0).cast("long")
    private = nodes.where("n_convs = 1")
    single = private.select("depth", "conv_id", (1 - F.col("n_ends")).alias("children"), F.lit(1).cast("long").alias("leaves"), zero.alias("saved"))
    # A chain of nodes of one conversation is one child and one leaf of the node above it.
    chains = private.where("parent_n > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("chains"))
    shared = nodes.where("n_convs > 1 or depth = 0").join(chains, ["depth", "conv_id"], "left")
    count = F.coalesce("chains", zero)
    # A lone root's only child is private too.
    count = F.when((F.col("depth") == 0) & (F.col("n_convs") == 1), 1 - F.col("n_ends")).otherwise(count)
    shared = shared.select(
        "depth", "a", "b", "conv_id", "parent_conv_id", "n_convs", "parent_n", ((F.col("n_convs") - 1) * F.col("chars")).alias("gain"), count.alias("children"), count.alias("leaves"), zero.alias("saved")
    )
    shared = materialize(shared, "shared")
    turns = prefixes.count()
    totals = _totals(prefixes, shared, max(heavy, -(-turns // TOP))).unionAll(single.where("depth > 0"))
    many = nodes.where("n_ends > 1").select("depth", "a", "b", "conv_id")
    ends = prefixes.where("last").select("depth", "a", "b", F.col("conv_id").alias("member")).join(many, ["depth", "a", "b"])
    lists = _end_lists(materialize(ends.select("depth", "conv_id", "member"), "ends"))
    listed = F.coalesce("digest", F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256))
    return (
        nodes.join(totals, ["depth", "conv_id"])
        .join(lists, ["depth", "conv_id"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            listed.alias("ends_sha256"),
        )
    )


#: The trie in DuckDB; the first part is a bit-by-bit CRC-32.
TRIE_SQL = """
WITH RECURSIVE crc(conv_id, rest, bits, v) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id,
    CASE WHEN bits = 0 THEN rest[2:] ELSE rest END,
    CASE WHEN bits = 0 THEN 8 ELSE bits - 1 END,
    CASE WHEN bits = 0 THEN xor(v, ascii(rest[1])::BIGINT)
      WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END
  FROM crc WHERE bits > 0 OR rest <> ''
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE bits = 0 AND rest = ''
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), sized AS (
  SELECT c.*, least(c.h, (SELECT count(*) FROM turns t WHERE t.conv_id = c.base)) AS k FROM convs c
), rebuilt AS (
  SELECT c.conv_id, t.p + 1 AS d, t.role, t.text FROM sized c JOIN turns t ON t.conv_id = c.base AND t.p < c.h
  UNION ALL
  SELECT c.conv_id, c.k + t.p - c.h + 1, t.role, t.text FROM sized c JOIN turns t ON t.conv_id = c.conv_id AND t.p >= c.h
), paths AS (
  SELECT conv_id, 0 AS d, '' AS prefix, 0 AS chars FROM convs
  UNION ALL
  SELECT conv_id, d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d), length(text)
  FROM rebuilt
), nodes AS (
  SELECT d, prefix, min(conv_id) AS owner, count(*) AS n, max(chars) AS chars FROM paths GROUP BY d, prefix
), path AS (
  SELECT p.conv_id, p.d, n.owner, p.d = max(p.d) OVER (PARTITION BY p.conv_id) AS last
  FROM paths p JOIN nodes n ON n.d = p.d AND n.prefix = p.prefix
), linked AS (
  SELECT n.d, n.owner, n.n, n.chars, p.owner AS parent FROM nodes n LEFT JOIN path p ON p.conv_id = n.owner AND p.d = n.d - 1
), children AS (
  SELECT d - 1 AS d, parent AS owner, count(*) AS children FROM linked WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT l.*, coalesce(c.children, 0) AS children FROM linked l LEFT JOIN children c ON c.d = l.d AND c.owner = l.owner
), totals AS (
  SELECT p.d, p.owner, count(*) FILTER (WHERE f.children = 0) AS leaves, sum((f.n - 1) * f.chars) AS saved
  FROM full_nodes f JOIN path p ON p.conv_id = f.owner AND p.d <= f.d GROUP BY p.d, p.owner
), ends AS (
  SELECT d, owner, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members FROM path WHERE last GROUP BY d, owner
)
SELECT f.owner AS conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.children AS n_children,
  t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
FROM full_nodes f JOIN totals t ON t.d = f.d AND t.owner = f.owner LEFT JOIN ends e ON e.d = f.d AND e.owner = f.owner
"""
