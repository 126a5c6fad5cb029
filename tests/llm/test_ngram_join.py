from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from agora.llm.common import table
from agora.llm.ngram_join import intersections, join, links, prefix_keys, shingle_sets
from agora.llm.queries import op11_ngram_jaccard_join

SF = "/root/testdata/sf0.01"


def brute_set(text: str | None, words: int) -> frozenset[str]:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows: list[tuple], words: int, percent: int) -> list[tuple]:
    sets = [brute_set(r[1], words) for r in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if 100 * len(x) < percent * len(y):
                break
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common) and top(x) is not top(y):
                root[top(x)] = top(y)
    least: dict = {}
    for (doc_id, *_), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            least[top(s)] = min(least.get(top(s), doc_id), doc_id)
    return [(r[0], len(s), least.get(top(s)) if s else r[0]) for r, s in zip(rows, sets, strict=True)]


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.randint(0, 1)] = [rng.choice("abcdefgh") * rng.randint(1, 3)] * rng.randint(0, 1)
    return out


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    shared = [str(rng.randrange(10**6)) for _ in range(60)]
    texts: list[str | None] = [None, "", " \n", "One", "one", "one two", "One TWO", "one two three", "a b a b a b a b"]
    for base in range(12):
        size = rng.choice([4, 9, 11, 12, 30, 70, 200, 600])
        words = [str(rng.randrange(10**6)) for _ in range(size)] if base % 3 else shared + [rng.choice("xyz") for _ in range(size)]
        for _ in range(rng.choice([2, 12, 40])):
            texts.append(rng.choice([" ", "\n", " \t "]).join(edited(rng, words, rng.choice([0, 0, 1, 1, 2, size // 40, size // 20, size // 8]))).upper())
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    return [*rows, *rows[-20:], (None, rows[-1][1]), (None, None), (None, "alone " * 40), (None, "alone " * 40)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80), (4, 3, 100)])
def test_equals_brute_force(spark, seed, words, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, component_id string, n int")
    got = [tuple(r) for r in join(docs.repartition(5), words, percent).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, words, percent), key=key)


def test_blocks_and_frequent_pairs(spark):
    """Every key is crowded and every shared shingle frequent."""
    rng = random.Random(6)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.randint(0, 5)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from agora.llm import ngram_join
    from pyspark.sql import functions as F

    sets = ngram_join._sets(docs, 3, sets=False)
    classes = sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min("code").alias("code"), F.min("n").alias("n"))
    found, edges = links(docs, classes, 3, 90, rare=1, block=20)
    name = {r.sid: r.least for r in found.join(classes, ["k1", "k2"]).collect()}
    root = {k: k for k in name.values()}
    for a, b in sorted({tuple(sorted((name[r.a], name[r.b]))) for r in edges.collect()}) * len(root):
        low = min(root[a], root[b])
        root[a] = root[b] = low
    expected = {r[0]: r[2] for r in brute(rows, 3, 90)}
    assert {k: root[k] for k in root} == {k: expected[k] for k in root}


def test_linked_sets_share_a_key():
    rng = random.Random(7)
    df = {t: rng.choice([2, 3, 50, 500]) for t in range(4000)}
    for _ in range(300):
        percent = rng.choice([80, 90, 95])
        x = set(rng.sample(range(4000), rng.randint(5, 400)))
        y = set(x)
        while True:
            z = set(y)
            z.symmetric_difference_update([rng.randrange(4000)])
            if 100 * len(x & z) < percent * len(x | z):
                break
            y = z
        if x == y:
            continue
        keys = []
        for s in (x, y):
            order = sorted(s, key=lambda t: (df[t], t))
            keys.append(set(prefix_keys(len(s), np.array([df[t] for t in order]), np.array(order), percent, 16)))
        assert keys[0] & keys[1]


def test_intersections():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 300, 120)).astype(np.int64) for _ in range(20)]
    got = intersections(np.concatenate(sets), np.repeat(np.arange(20), [len(s) for s in sets]), 20, width=16)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert got[i, j] == len(np.intersect1d(x, y)) or i == j


def test_shingle_sets():
    texts = ["A b a B a b", None, "", "x", "x Y", "y x", "É é \x1c\x85 z"]
    value, bounds = shingle_sets(pa.array(texts), 3)
    assert np.diff(bounds).tolist() == [len(brute_set(t, 3)) for t in texts]
    assert len({tuple(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)}) == 6


def test_empty_table_and_bad_threshold(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert join(docs).collect() == []
    with pytest.raises(ValueError):
        join(docs, percent=50)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op11_ngram_jaccard_join(spark, SF).collect()]
    expected = brute(rows, 3, 90)
    assert sorted(got) == sorted(expected)
    assert any(r[0] != r[2] for r in expected)
