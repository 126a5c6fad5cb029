from __future__ import annotations

import math
import random

import numpy as np
from agora.llm.vafile import Search, bounds, scaled, top_k
from pyspark.sql import functions as F

FAST = Search(k=3, cells=8, sample=50, vector_block=16, query_block=4, step=3, salts=2)


def brute(rows: list[tuple], step: int, k: int) -> set[tuple]:
    good = {}
    for vec_id, x in rows:
        if vec_id is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            good[vec_id] = tuple(math.floor(1024 * float(np.float32(c))) for c in x)
    out = set()
    for q, a in good.items():
        if q % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, rank int")


def search(spark, rows, step, plan):
    got = top_k(frame(spark, rows), F.col("vec_id") % step == 0, plan=plan).collect()
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in got}
    assert len(found) == len(got)
    return found


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(6)]) for k in range(150)]
    same = [0.5, -0.5, 0.25, 0.0, 0.1, 0.9]
    rows += [(1000 + k, same) for k in range(60)]
    rows += [(2000, None), (2005, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (2010, [math.nan] * 6), (2015, [math.inf] * 6), (None, same)]
    rows += [(2020, [0.0] * 6), (2025, [0.1, 0.2]), (2030, []), (2035, [900.0] * 6)]
    rng.shuffle(rows)
    assert search(spark, rows, 5, FAST) == brute(rows, 5, 3)


def test_ties_and_small_tables(spark):
    rows = [(k, [0.5, 0.5]) for k in range(12)] + [(12, [0.5, 0.5])] * 2
    assert search(spark, rows, 4, FAST) == brute(rows, 4, 3)
    assert search(spark, [(0, [1.0])], 1, FAST) == set()
    assert search(spark, [(0, [1.0]), (2, [1.0, 3.0])], 2, FAST) == {(0, 1, 2, 1 << 20), (2, 1, 0, 1 << 20)}
    assert top_k(frame(spark, [(0, [1.0])]).limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, q = rng.integers(-500, 500, (200, 5)), rng.integers(-500, 500, (20, 5)).astype(float)
    limits = np.quantile(v[:40], np.linspace(0, 1, 9)[1:-1], axis=0, method="inverted_cdf").T
    codes = np.stack([np.searchsorted(limits[d], v[:, d], side="right") for d in range(5)], axis=1).astype(np.uint8)
    lower, upper = bounds(q, codes, limits, v.min(axis=0), v.max(axis=0))
    exact = q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_scaling_rounds_down(spark):
    got = scaled(frame(spark, [(1, [-0.0001, 0.25, 2.0])])).first().v
    assert list(got) == [-1, 256, 2048]
