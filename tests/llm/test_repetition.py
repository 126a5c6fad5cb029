from __future__ import annotations

import random
import re

from agora.llm.repetition import RepetitionRules, repetition
from hypothesis import given, settings, strategies as st

import pyarrow as pa
from agora.llm.repetition import analyse

RULES = RepetitionRules(min_repeat=3, max_covered=0.4, max_longest=6, min_words=4)


def brute(text: str | None, rules: RepetitionRules) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    longest, spans, windows, maximal = 0, set(), set(), set()
    for size in range(1, n):
        at: dict[tuple, list[int]] = {}
        for i in range(n - size + 1):
            at.setdefault(tuple(words[i : i + size]), []).append(i)
        for gram, places in at.items():
            if len(places) < 2:
                continue
            longest = size
            for i in places:
                if size == 3:
                    windows |= set(range(i, i + 3))
                if size >= rules.min_repeat:
                    spans |= set(range(i, i + size))
            before = {words[i - 1] if i else None for i in places}
            after = {words[i + size] if i + size < n else None for i in places}
            if size >= rules.min_repeat and len(before) > 1 and len(after) > 1:
                maximal.add(gram)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < rules.min_words or 100 * len(windows) > 50 * n
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(windows),
        "base_failed": failed,
        "covered_words": len(spans),
        "longest_repeat": longest,
        "n_maximal_repeats": len(maximal),
        "kept": not failed and longest <= rules.max_longest and len(spans) <= rules.max_covered * n,
    }


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#\n\t|", max_size=60)), min_size=1, max_size=6))
def test_analyse_equals_brute_force(texts):
    found = analyse(pa.array(texts, pa.string()), RULES)
    for k, text in enumerate(texts):
        for name, value in brute(text, RULES).items():
            assert found[name][k] == value, (name, text)


def test_rows_of_every_kind(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["w%d" % k for k in range(40)]) for _ in range(2000))
    rows = [(1, "a b c a b c a b c d", "x"), (1, "a b c a b c a b c d", "x"), (2, None, "y"), (None, "", "y"), (3, long, "z"), (4, "same " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = repetition(docs, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        if r.doc_id in (1, 2, None):
            assert {k: r[k] for k in brute(text, RULES)} == brute(text, RULES)
        assert sum(s.end - s.start for s in r.repeat_spans) == r.covered_words
    assert [r.longest_repeat for r in got if r.doc_id == 4] == [2999]
    assert repetition(docs.limit(0), RULES).count() == 0
