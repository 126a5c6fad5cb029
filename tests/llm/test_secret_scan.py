from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm.queries import op8_secret_scan
from agora.llm.secret_scan import ALPHABETS, KINDS, STEP, battery, departure, encoding, least_bucket, redact, reference, scan

KEYWORD = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE = (
    ("assign", KEYWORD + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def brute(text: str | None) -> list[tuple[int, int, int]]:
    found = []
    for number, (_, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), number, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(found)


def corpus(rng: random.Random) -> list[tuple[int | None, str | None]]:
    syllables = ["the", "ing", "er", "tion", "an", "ea", "st", "on", "re", "ou"]
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (None, "token: abcdefghijkl"), (3, "é token = \"" + "0a" * 20 + "\" \U0001f600 AKIA" + "Q" * 14)]
    rows += [(4, "token=secret: abcdefghijklmnop"), (4, "token=secret: abcdefghijklmnop"), (5, "AKIAB AKIA" + "Z9" * 10 + "aAPI_KEY':  'x.y=z/1234567"), (6, "deadbeef" * 3 + "g" + "0123456789abcde"), (7, "PassWord token=token=abcdefgh secret= short")]
    for k in range(200):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 16))) for _ in range(60)]
        rows.append((100 + k, " ".join(words)))
    alphabet = string.ascii_letters + string.digits
    rows.append((8, "here " + "".join(rng.choice(alphabet) for _ in range(64)) + " there " + "".join(rng.choice("0123456789ABCDEF") for _ in range(64))))
    rows.append((9, ("x" * 30 + " " + "token=abcdefghijklm1 ") * 300))
    return rows


def test_base_spans_equal_brute_force_and_random_strings_are_added(spark):
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = scan(docs).collect()
    assert len(got) == len(rows)
    wanted = sorted((str(i), str(brute(t))) for i, t in rows)
    assert sorted((str(r.doc_id), str([(s.start, s.kind, s.end) for s in r.base])) for r in got) == wanted
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        added = [text[s.start : s.end] for s in r.spans if s.kind == 3]
        assert [s for s in r.spans if s.kind < 3] == r.base
        if r.doc_id == 8:
            assert sorted(map(len, added)) == [64, 64]
        else:
            assert not added
    assert scan(docs.limit(0)).count() == 0


def test_redaction_removes_exactly_the_spans(spark):
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    found = {(r.doc_id, str(r.base)): r.spans for r in scan(docs).collect()}
    out = redact(docs)
    assert out.columns == docs.columns
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        mine = by_id[doc_id].pop()
        places = next(v for (i, _), v in found.items() if i == doc_id)
        if text is None:
            assert mine.text is None
            continue
        merged, at = "", 0
        for s in places:
            if s.start >= at:
                merged += text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert mine.text == merged + text[at:]
        assert mine.n_chars == len(mine.text)


def test_query_digests(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op8_secret_scan(spark, sf_dir).collect():
        base = brute(texts[r.doc_id])
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def keys(rng: random.Random, alphabet: str, length: int, n: int) -> list[str]:
    return ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(n)]


def added(spark, rows: list[tuple]) -> list[str]:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    return sorted(texts[r.doc_id][s.start : s.end] for r in scan(docs).collect() for s in r.spans if s.kind == 3)


KEY = "qT7vZ2mXc9KfLw4RbY"


def test_a_key_is_found_whatever_else_the_table_holds(spark):
    rows = [r for r in corpus(random.Random(7)) if r[0] and r[0] >= 100]
    for others in ([], rows[:2], rows):
        assert added(spark, [*others, (1, f"key {KEY} end")]) == [KEY]


def test_keys_of_letters_alone(spark):
    rng = random.Random(12)
    rows = [r for r in corpus(rng) if r[0] and r[0] >= 100]
    lower, upper = keys(rng, string.ascii_lowercase, 64, 6), keys(rng, string.ascii_uppercase, 64, 6)
    found = added(spark, [*rows, *((k, f"a {key} b") for k, key in enumerate(lower + upper))])
    assert set(found) <= set(lower + upper)
    assert len(set(found) & set(lower)) >= 5 and len(set(found) & set(upper)) >= 5


def plain_departure(token: str) -> float | None:
    kind = next((k for k, shape in SHAPES if re.fullmatch(shape, token)), "b64")
    if kind is None:
        return None
    alphabet = ALPHABETS[kind]
    text = token.rstrip("=").replace("-", "+").replace("_", "/") if kind == "b64" else token if kind == "b32" else token.lower()
    x = [max(0, alphabet.find(c)) for c in text]
    n, k = len(x), len(alphabet)
    chi = max(0.0, k / n * sum(x.count(c) ** 2 for c in set(x)) - n)
    z_chi = ((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1)))
    high = sum(2 * y >= k for y in x)
    runs = 1 + sum((2 * a >= k) != (2 * b >= k) for a, b in zip(x, x[1:], strict=False))
    mean = 2 * high * (n - high) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = (runs - mean) / math.sqrt(var) if var > 0 else math.sqrt(n)
    middle = sum(x) / n
    square = sum((y - middle) ** 2 for y in x)
    lag = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False))
    z_serial = lag / square * math.sqrt(n) if square else math.sqrt(n)
    return z_chi + (abs(z_runs) + abs(z_serial)) / 4


SHAPES = [(None, r"[0-9+/_=-]+"), ("word", r"[A-Z]?[a-z]+|[A-Z]+"), ("hex", r"[0-9a-f]+|[0-9A-F]+"), ("b32", r"[A-Z2-7]+"), ("b36", r"[0-9a-z]+|[0-9A-Z]+")]


def test_battery_equals_one_token_at_a_time(spark):
    rng = random.Random(3)
    tokens = [t for a in ALPHABETS.values() for n in (16, 17, 33, 90) for t in keys(rng, a, n, 4)]
    tokens += ["a" * 20, "AB" * 10, "Aaaaaaaaaaaaaaaaa", "1234567890123456", "some_long-name_of_it", "abc=def=abc=defg==", "0" * 15 + "F"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = rows.select("t", departure(F.col("t"), encoding(F.col("t"))).alias("z"), encoding(F.col("t")).alias("k")).collect()
    for r in got:
        wanted = plain_departure(r.t) if r.k else None
        assert r.z == pytest.approx(wanted) if r.k else wanted is None
    x = np.array([[ALPHABETS["b64"].find(c) for c in t] for t in keys(rng, ALPHABETS["b64"], 40, 9)])
    assert battery(x, 64).tolist() == pytest.approx([plain_departure("".join(ALPHABETS["b64"][y] for y in row)) for row in x.tolist()])


def test_false_discovery_step():
    rng = random.Random(4)
    for _ in range(200):
        tests = [rng.choice([rng.randint(0, 900), rng.randint(0, 150)]) for _ in range(rng.randint(1, 60))]
        p = sorted(math.exp(-b * STEP) for b in tests)
        accepted = [x for k, x in enumerate(p) if x <= 0.01 * (k + 1) / len(p)]
        least = least_bucket({b: tests.count(b) for b in tests}, 0.01)
        assert sum(b >= least for b in tests) == sum(x <= max(accepted, default=-1) for x in p)


def test_ordinary_text_departs_more_the_longer_it_is():
    for kind in ALPHABETS:
        means = [reference(kind, n)[0] for n in (16, 32, 64, 128)]
        assert means == sorted(means)
        assert means[-1] > 2
