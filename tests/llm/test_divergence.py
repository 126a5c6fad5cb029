from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from agora.llm.divergence import SCALE, audit, count_terms, radix_order


def brute_terms(text: str | None) -> list[str]:
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in found]


def brute(rows: list[tuple], least: int, top: int) -> list[tuple]:
    rows = [(brute_terms(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        held = Counter(t for r in mine for t in set(r[0]))
        kept = sorted(t for t in held if held[t] >= least)
        count = defaultdict(Counter)
        for words, _, source in mine:
            count[source].update(w for w in words if w in set(kept))
        whole = sum(count.values(), Counter())

        def p(c):
            return {t: 1 + SCALE * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        share, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            parts = {
                "pair": [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in count if o != s],
                "term": [(f(share[s][t], q[t]), t) for t in kept if count[s][t] and share[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(items) if part == "pair" or k < top]
    return out


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    stock = ["a", "Zz", "é", "été", "日本", "x" * 8, "X" * 9, "y" * 16, "Y" * 17, "long" * 9, "long" * 9 + "er", "ß" * 40, "w" * 300, "\U0001f600b"]
    stock += ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 20))) for _ in range(40)]
    rows: list[tuple] = []
    for k in range(120):
        words = rng.choices(stock[k % 7 :], k=rng.choice([0, 1, 5, 40]))
        rows.append(("".join(w + rng.choice([" ", "\n", "1", "@", "[", "\x00", "\x7f"]) for w in words), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "é", None])))
    return [*rows, *rows[:10], (None, "en", "none"), ("once only", "fr", "a"), ("", "fr", "b"), (None, "la", None)]


def test_equals_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "text string, lang string, source string, term string, n int")
    for least, top, sources, terms in ((10, 10, 256, 4096), (3, 2, 2, 5), (1, 4, 1, 1000)):
        got = [tuple(r) for r in audit(docs.repartition(4), least, top, sources, terms).collect()]
        assert sorted(got) == sorted(brute(rows, least, top))


def test_count_terms():
    rng = random.Random(2)
    rows = corpus(3)
    texts = [t or "" for t, _, _ in rows]
    group = np.array([rng.randrange(5) for _ in rows])
    n, docs = Counter(), Counter()
    for t, g in zip(texts, group.tolist(), strict=True):
        n.update((w, g) for w in brute_terms(t))
        docs.update({(w, g) for w in brute_terms(t)})
    term, g, got, held = count_terms(pa.array(["skipped", *texts]).slice(1), group)
    keys = list(zip(term.to_pylist(), g.tolist(), strict=True))
    assert dict(zip(keys, got.tolist(), strict=True)) == n
    assert dict(zip(keys, held.tolist(), strict=True)) == docs
    assert len(keys) == len(n)
    assert len(count_terms(pa.array(["", "12"]), np.array([0, 1]))[0]) == 0


def test_radix_order_is_stable():
    rng = np.random.default_rng(4)
    high, low = (rng.integers(0, 3, 1000).astype(np.uint64) << np.uint64(s) for s in (60, 17))
    order = radix_order([high, low])
    assert order.tolist() == np.lexsort((low, high)).tolist()
    assert radix_order([np.empty(0, np.uint64)]).tolist() == []


def test_exact_beyond_64_bits(spark):
    """One p's numerator exceeds a long: SCALE times the count."""
    from pyspark.sql import functions as F

    from agora.llm.divergence import _p

    n, total, kept = 9 * 10**12, 10**13, 7
    row = spark.range(1).select(_p(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + SCALE * (n + 2) // (total + 2 * kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert audit(docs).collect() == []
