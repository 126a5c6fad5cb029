from __future__ import annotations

import math

import pytest
from agora.llm.curriculum import Curriculum, mix, schedule, targets


def water_fill(sizes: list[int], weights: list[float], total: float) -> list[float]:
    got, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_ and total > 1e-9:
        share = total / sum(weights[k] for k in open_)
        over = {k for k in open_ if got[k] + share * weights[k] >= 2 * sizes[k]}
        if not over:
            for k in open_:
                got[k] += share * weights[k]
            break
        for k in over:
            total -= 2 * sizes[k] - got[k]
            got[k] = 2 * sizes[k]
        open_ -= over
    return got


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 900, 40, 0, 1000], [7], [0, 0], [1, 1000, 1, 1000, 1, 3]])
def test_targets_equal_water_filling(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in targets(rows, Curriculum()).collect()}
    wanted = water_fill(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes))
    for k, w in enumerate(wanted):
        assert math.isclose(got[f"s{k}"], w, abs_tol=1e-6)


def documents(spark):
    rows = [(k, "word " * (1 + k * 7 % 50), f"s{k % 4}" if k % 3 else "hot", k) for k in range(400)]
    rows += [(7, "again and again", "s1", 0), (7, "again and again", "s1", 0), (None, "no id", "s1", 0), (900, None, None, 0), (901, "", "s2", 0), (902, "a b", None, 0), (903, "x " * 20_000, "long", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int")


def test_every_source_comes_near_its_target(spark):
    rows, docs = documents(spark)
    got = schedule(docs, Curriculum(bucket_rows=10)).collect()
    assert len(got) == len(rows)
    assert sum(r.size for r in got) == sum(len((t or "").split()) for _, t, _, _ in rows)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6
        assert all(r.taken <= 2 * r.size and len(r.positions) == r.copies for r in mine)
        assert all(0 <= p <= 1 for r in mine for p in r.positions)
    again = schedule(docs.repartition(5), Curriculum(bucket_rows=100_000)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert schedule(docs.limit(0)).count() == 0


def test_times_invert_the_integrated_schedule(spark):
    docs = spark.createDataFrame([(k, "w", "a" if k % 2 else "b") for k in range(600)], "doc_id long, text string, source string")
    plan = Curriculum(ramps=((0.0, 2.0), (2.0, 0.0)))
    got = schedule(docs, plan).collect()
    for source, ramp in (("a", (0, 2)), ("b", (2, 0))):
        times = sorted(p for r in got if r.source == source for p in r.positions)
        for k, t in enumerate(times):
            reached = ramp[0] * t + (ramp[1] - ramp[0]) * t * t / 2
            assert math.isclose(reached, min(1, (k + 0.5) / got[0].target), abs_tol=1e-9)


def test_mix_repeats_documents_in_order(spark):
    rows, docs = documents(spark)
    taken = mix(docs)
    assert taken.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in taken.collect())
    assert words == sum(r.taken for r in schedule(docs).collect())
