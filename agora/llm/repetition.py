"""Repetition inside a document from its word suffix array.

The suffixes of every document are sorted by prefix doubling over word ids.
Neighbouring suffixes share a longest common prefix (LCP); a run of
neighbours whose LCP never falls below a value is an LCP interval, and an
interval whose occurrences are preceded by different words is a maximal
repeated substring. The spans of all occurrences of all maximal repeats of
``min_repeat`` words or more are united; a document is rejected when the
united spans cover too much of it or one repeat is too long.

Documents are independent, so there is no shuffle: a task sorts the suffixes
of a few megabytes of documents at a time with vectorised array steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from agora.llm.common import bounded_slices, map_arrow, split_words

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict. ``min_repeat``: words a repeat needs to count;
    ``max_covered``: largest fraction of words in united repeat spans;
    ``max_longest``: longest repeat allowed, in words."""

    min_repeat: int = 6
    max_covered: float = 0.4
    max_longest: int = 50
    min_words: int = 50
    max_repeat_window_pct: int = 50


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, "
    "n_maximal_repeats long, repeat_spans array<struct<start:long,end:long>>, kept boolean"
)


def suffix_order(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes after each doubling step. ``ids``: a number for
    each (document, word); ``ends``: end of the document of each position.
    Element k of the list gives equal numbers to positions whose next 2**k
    words agree; the last one is the final rank of every suffix."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    levels = [rank.astype(np.int32)]
    crowd = np.bincount(starts, minlength=n)
    active = order[crowd[starts] > 1]
    step = 1
    while len(active):
        nxt = active + step
        inside = nxt < ends[active]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        old = rank[active]
        key = old * (n + 1) + second
        turn = np.argsort(key, kind="stable")
        active, key, old = active[turn], key[turn], old[turn]
        index = np.arange(len(active))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.maximum.accumulate(np.where(new_key, index, 0))
        rank[active] = old + at - np.maximum.accumulate(np.where(new_old, index, 0))
        levels.append(rank.astype(np.int32))
        active = active[np.bincount(at, minlength=len(at))[at] > 1]
        step *= 2
    return rank, levels


def neighbour_lcp(suffixes: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """LCP in words of each suffix with the one before it in suffix order."""
    n = len(suffixes)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    at = 1 + np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    a, b = suffixes[at - 1], suffixes[at]
    size = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + size, b + size
        fits = (x < ends[a]) & (y < ends[b])
        same = fits & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        size += np.where(same, 1 << k, 0)
    lcp[at] = size
    return lcp


def maximal_repeats(
    suffixes: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int
) -> list[tuple[int, int, int]]:
    """LCP intervals of ``least`` words or more whose occurrences are preceded
    by different words: (first, last) index in suffix order and length.
    ``before``: the word before each position, -1 at a document's start
    (a start differs from everything)."""
    found: list[tuple[int, int, int]] = []
    prior = before[suffixes]
    differs = np.concatenate([[0], np.cumsum((prior[1:] != prior[:-1]) | (prior[1:] < 0))])
    high = np.flatnonzero(lcp >= least)
    if not len(high):
        return found
    cuts = np.flatnonzero(np.diff(high) > 1) + 1
    for run in np.split(high, cuts):
        lo, hi = int(run[0]), int(run[-1])
        stack: list[tuple[int, int]] = []
        for j, value in enumerate([*lcp[lo : hi + 1].tolist(), 0], lo):
            left = j - 1
            while stack and stack[-1][1] > value:
                left, size = stack.pop()
                if differs[j - 1] > differs[left]:
                    found.append((left, j - 1, size))
            if value and (not stack or stack[-1][1] < value):
                stack.append((left, value))
    return found


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeated span of ``least`` words or more."""
    at = np.arange(len(longest))
    return np.maximum.accumulate(np.where(longest >= least, at + longest, 0)) > at


def analyse(texts: pa.Array, rules: RepetitionRules) -> dict[str, list]:
    """The features of each text, in order."""
    words, bounds = split_words(texts)
    n, docs = len(words), len(texts)
    counts = np.diff(bounds)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(docs), counts)
    ends = np.repeat(bounds[1:], counts)
    longest = np.zeros(n, np.int64)
    n_maximal = np.zeros(docs, np.int64)
    if n:
        rank, levels = suffix_order(doc * (int(codes.max()) + 1) + codes, ends)
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        lcp = neighbour_lcp(suffixes, levels, ends)
        longest[suffixes] = np.maximum(lcp, np.append(lcp[1:], 0))
        before = np.concatenate([[-1], codes[:-1]])
        before[bounds[:-1][counts > 0]] = -1
        for first, _, _ in maximal_repeats(suffixes, lcp, before, rules.min_repeat):
            n_maximal[doc[suffixes[first]]] += 1
    windows, spans = _covered(longest, 3), _covered(longest, rules.min_repeat)
    sum_of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
    n_repeat, covered = sum_of(windows), sum_of(spans)
    out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ") if " " in k}
    for k, text in enumerate(texts.fill_null("").to_pylist()):
        a, b = int(bounds[k]), int(bounds[k + 1])
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        top = int(longest[a:b].max()) if b > a else 0
        failed = b - a < rules.min_words or 100 * int(n_repeat[k]) > rules.max_repeat_window_pct * (b - a)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], spans[a:b].astype(np.int8), [0]]))) if covered[k] else []
        out["n_words"].append(b - a)
        out["word_chars"].append(len(text) - sum(map(text.count, WHITE)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(int(n_repeat[k]))
        out["base_failed"].append(failed)
        out["covered_words"].append(int(covered[k]))
        out["longest_repeat"].append(top)
        out["n_maximal_repeats"].append(int(n_maximal[k]))
        out["repeat_spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        out["kept"].append(bool(not failed and top <= rules.max_longest and covered[k] <= rules.max_covered * (b - a)))
    return out


OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_())]
    + [(k, pa.int64()) for k in ("covered_words", "longest_repeat", "n_maximal_repeats")]
    + [("repeat_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.bool_())]
)


def repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """Repetition features and verdict of each row of ``docs`` (doc_id, text).

    Output in words: n_words, covered_words (in repeats of ``min_repeat``
    words or more), longest_repeat (occurrences may overlap),
    n_maximal_repeats, repeat_spans (word offsets, end exclusive), and the
    counts word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null or empty text has no words and fails the base rule; a null doc_id
    stays null; repeated rows each give a row; other columns are ignored; an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            found = analyse(part.column("text"), rules)
            found["doc_id"] = part.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pc.cast(found[f.name], f.type) if f.name == "doc_id" else pa.array(found[f.name], f.type) for f in OUT], schema=OUT
            )

    return map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, SCHEMA)
