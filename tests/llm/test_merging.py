from __future__ import annotations

import random

import numpy as np

from agora.llm.merging import PairMerges, packed


def brute(ids: list[int], ranks: dict, merged: list[int]) -> list[int]:
    ids = list(ids)
    while True:
        found = [(ranks[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        if not found:
            return ids
        rank, k = min(found)
        ids[k : k + 2] = [merged[rank]]


def test_equals_one_by_one():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([4, 30, 300])
        pairs = list({(rng.randrange(size), rng.randrange(size)) for _ in range(rng.choice([1, 10, 400]))})
        merged = [rng.randrange(size) for _ in pairs]
        rounds = PairMerges(pairs, merged, size)
        ranks = {p: k for k, p in enumerate(pairs)}
        words = [[rng.randrange(size) for _ in range(rng.choice([1, 1, 2, 3, 9, 40]))] for _ in range(rng.choice([0, 1, 50]))]
        ids, counts = rounds.merge(np.array(sum(words, []), np.int64), np.array([len(w) for w in words], np.int64))
        parts = packed(ids, counts, np.dtype("<u4"))
        assert [np.frombuffer(p, "<u4").tolist() for p in parts] == [brute(w, ranks, merged) for w in words]


def test_rank_of_every_pair():
    pairs = [(a, b) for a in range(60) for b in range(60) if (a * 7 + b) % 3]
    rounds = PairMerges(pairs, [0] * len(pairs), 60)
    left, right = (np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60))
    ranks = {p: k for k, p in enumerate(pairs)}
    got = rounds.rank(left, right)
    assert [ranks.get((a, b), 1 << 30) for a, b in zip(left.tolist(), right.tolist(), strict=True)] == got.tolist()
