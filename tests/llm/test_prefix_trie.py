from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from agora.llm import prefix_trie
from agora.llm.prefix_trie import SpillingQueue, _placed, _turns, trie


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
            if d:
                children[full[: d - 1]].add(full[:d])
        ends[full].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        out.append(
            (
                convs[0],
                len(node),
                members[node[:-1]][0] if node else None,
                len(convs),
                len(children[node]),
                sum(not children[x] for x in below),
                sum((len(members[x]) - 1) * len(x[-1][1].decode()) for x in below if x),
                hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
            )
        )
    return out


def corpus(seed: int, blocks: int = 4, per_block: int = 25, long: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["a", "é" * 3, "", None, "日本", "b\n", "x" * 70 + "1", "x" * 70 + "2"]
    rows = []
    for block in range(-1, blocks - 1):
        for c in rng.sample(range(100), per_block) + [0] * (block % 2):
            for turn in range(rng.choice([1, 2, 3, 6, 8])):
                rows.append((block * 100 + c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None]) if turn % 3 == 2 else "user", rng.choice(texts[: 2 + turn])))
    for c in (5, 7, 305):
        rows += [(c, t, "user", "same") for t in range(long)]
    return [*rows, *rows[:9], (None, 1, "user", "lost")]


def key(row):
    return (row[1], row[0])


@pytest.mark.parametrize(("seed", "heavy", "long"), [(1, 1000, 0), (2, 2, 60)])
def test_equals_brute_force(spark, seed, heavy, long):
    rows = corpus(seed, long=long)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, a int")
    got = [tuple(r) for r in trie(docs.repartition(3), heavy).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_conversations_cut_by_partitions(spark):
    """Sums of a conversation that lies in many partitions are those of one."""
    rows = [(c, t, "user", f"{t % 7}") for c in (1, 2) for t in range(400)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = _turns(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert turns.groupBy("conv_id").agg({"part": "max"}).where("`max(part)` > 1").count() == 2
    got = defaultdict(list)
    for r in _placed(turns).collect():
        got[r.conv_id].append((r.p, r.a, r.b, r.a0, r.b0))
    assert sorted(got[1]) == sorted(got[2])
    chain = sorted(got[1])
    assert [x[0] for x in chain] == list(range(400))
    assert all(y[3:] == x[1:3] for x, y in zip(chain, chain[1:], strict=False))
    assert len({x[1:3] for x in chain}) == 400


@pytest.mark.parametrize("rows", [[], [(3, None, None, None)], [(100, 1, "user", "a"), (100, 2, "user", "b")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie(docs).collect()), key=key) == sorted(brute(rows), key=key)


def test_spilling_queue():
    rng = np.random.default_rng(5)
    rows = np.stack([rng.integers(-5, 0, 5000), rng.integers(0, 100, 5000), *rng.integers(0, 9, (3, 5000))], axis=1)
    for limit in (1 << 20, 300):
        queue, got = SpillingQueue(limit, block=64), []
        for part in np.array_split(rows[:3000], 11):
            queue.push(part)
        got.append(queue.pop(-4, 50))
        for part in np.array_split(rows[3000:], 7):
            queue.push(part[(part[:, 0] > -4) | ((part[:, 0] == -4) & (part[:, 1] > 50))])
        for level, node in [(-4, 99), (-3, 10), (-3, 11), (-1, 0), (0, 0)]:
            got.append(queue.pop(level, node))
            keys = [tuple(x) for x in got[-1][:, :2].tolist()]
            assert all(k <= (level, node) for k in keys)
        late = rows[3000:]
        kept = np.concatenate([rows[:3000], late[(late[:, 0] > -4) | ((late[:, 0] == -4) & (late[:, 1] > 50))]])
        assert sorted(map(tuple, np.concatenate(got).tolist())) == sorted(map(tuple, kept.tolist()))
        assert not queue.runs and not queue.held


def test_spilled_totals(spark, monkeypatch):
    rows = corpus(3, blocks=6, per_block=60)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = sorted(map(tuple, trie(docs).collect()), key=key)
    through = prefix_trie.pass_up
    monkeypatch.setattr(prefix_trie, "pass_up", lambda batches: through(batches, 5))
    assert sorted(map(tuple, trie(docs).collect()), key=key) == plain
