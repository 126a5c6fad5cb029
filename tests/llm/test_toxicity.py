from __future__ import annotations

import random
import zlib

import pytest
from agora.llm.queries import op7_toxicity
from agora.llm.toxicity import Matcher, Model, choose, fit, fold, held_out, reject, score
from pyspark.sql import functions as F


def test_folding():
    assert fold("You 1D10T, іdіоt 2024 cl0wn! $cum, m@n 5 o'clock") == (" you idiot idiot clown scum man o clock ", 8)
    assert fold("") == ("", 0) == fold("12 34 !!")


def test_hits_equal_brute_force():
    rng = random.Random(1)
    lexicon = {" bad ": 2.0, " ba": 1.0, " worse": 3.0, " not bad ": 0.5}
    exceptions = (" not bad ", " bad idea ")
    own = Matcher(Model(lexicon, exceptions))
    for _ in range(300):
        text = fold(" ".join(rng.choice(["bad", "not", "idea", "worse", "worsens", "bat", "a"]) for _ in range(rng.randint(0, 12))))[0]
        excused = [(i, i + len(e)) for e in exceptions for i in range(len(text)) if text.startswith(e, i)]
        wanted = [
            (i, i + len(p), w) for p, w in lexicon.items() for i in range(len(text))
            if text.startswith(p, i) and not any(a <= i and i + len(p) <= b for a, b in excused)
        ]
        assert sorted(own.hits(text)) == sorted(wanted)


def test_lexicon_draws_out_beginnings():
    rows = [(" idi", 100, 0), (" idio", 100, 0), (" idiot", 99, 0), (" idiot ", 98, 0), (" low", 90, 2), (" lowa ", 30, 0), (" lowb ", 30, 0), (" the ", 100, 100), (" rare ", 3, 0)]
    got = choose(rows, 100, 1000)
    assert set(got) == {" idiot ", " low"}


def test_held_out_accuracy(spark):
    found = op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in found)
    assert right / len(found) > 0.975
    assert all(0 <= r.score <= 1 for r in found)
    for r in found[:50]:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "xa")]
    rows, labels = [], []
    for k in range(800):
        toxic = k % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["grubble", "grubbling", "sn1tch"])
        elif k % 7 == 0:
            text[10:12] = ["old", "snitch"]
        rows.append((k, " ".join(text), "clash"))
        labels.append((k, int(toxic)))
    rows += [(None, None, "x"), (2000, "", "x"), (2001, "GRUBBL3D", "x"), (2001, "GRUBBL3D", "x"), (2002, "kara " * 50_000 + "grubble", "x")]
    labels += [(None, 1), (3, None), (0, 0), (1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_fit_finds_stems_and_exceptions(spark, small):
    docs, labels = small
    model = fit(docs, labels)
    assert any(t.startswith(" grubb") for t in model.lexicon)
    assert not any(t.startswith((" ka", " lo", " mi", " nu")) for t in model.lexicon)
    got = {(r.doc_id, i): r.score for i, r in enumerate(score(docs, model).collect())}
    by_id = {k: v for (k, _), v in got.items()}
    assert len(got) == docs.count()
    assert by_id[2001] > 0.5 > by_id[2000] == by_id[None]
    kept = reject(docs, model, 0.3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in by_id.items() if v < 0.3}
    assert score(docs.limit(0), model).count() == 0
    assert spark.createDataFrame([(5,), (None,)], "i long").select(held_out(F.col("i"))).count() == 2


def test_one_class_gives_an_empty_model(spark, small):
    docs, labels = small
    model = fit(docs, labels.where("toxic = 0"))
    assert model == Model()
    assert len({r.score for r in score(docs, model).collect()}) == 1


def test_model_does_not_depend_on_partitions(spark, small):
    docs, labels = small
    # Copies of one document, by the folded words, with different texts.
    more = spark.createDataFrame([(5000 + k, "ka ra " * (k % 3 + 1) + "grubble" + "!" * k, "x") for k in range(40)], docs.schema)
    marks = spark.createDataFrame([(5000 + k, 1) for k in range(40)], labels.schema)
    docs, labels = docs.unionAll(more), labels.unionAll(marks)
    models = [fit(docs.repartition(n), labels.repartition(m)) for n, m in ((1, 3), (7, 1))]
    assert models[0] == models[1]
    assert models[0].lexicon
