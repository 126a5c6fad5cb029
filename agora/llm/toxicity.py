"""Toxicity score from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: homoglyphs and digit substitutions inside words
become the letters they stand for, everything else but letters becomes one
space. The lexicon holds whole words and word beginnings whose document
frequency among labelled toxic texts far exceeds that among clean ones, with
their log-odds as weights. Exception phrases are word pairs around a lexicon
match that speak for clean texts; matches inside them don't count. The
score is a logistic function of the summed weights and of their density per
word.

The model is fitted on a bounded sample of labelled rows (``max_docs``);
scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from agora.llm.common import bounded_slices, map_arrow, materialize

#: Letters that look like Latin ones, and what digits and signs
#: stand for inside words.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁԛԝһкмтвнгαεικνορτυχωıɡⅼ",
    "aeopcyxijsdqwhkmtbhraeiknoptuxwigl",
)
DIGITS = str.maketrans("01345789@$", "oieastbgas")
SUBSTITUTED = re.compile(r"(?<=[^\W\d_])[0134578@$9]+|[0134578@$9]+(?=[^\W\d_])")
LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> tuple[str, int]:
    """The folded text, words between single spaces, and its word count."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    text = SUBSTITUTED.sub(lambda m: m.group().translate(DIGITS), text)
    words = LETTERS.findall(text)
    return " " + " ".join(words) + " " if words else "", len(words)


@dataclass(frozen=True)
class Model:
    """``lexicon``: folded pattern (a leading space starts a word, a trailing
    one ends it) -> weight; ``exceptions``: folded phrases; ``beta``: bias and
    coefficients of the two features."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    beta: tuple[float, float, float] = (-3.0, 0.0, 0.0)


class Matcher:
    """Aho-Corasick automaton of a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in model.lexicon.items():
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches outside exception phrases."""
        if not len(self.automaton):
            return []
        found, excused = [], []
        for last, (size, weight) in self.automaton.iter(folded):
            if weight is None:
                excused.append((last + 1 - size, last + 1))
            else:
                found.append((last + 1 - size, last + 1, weight))
        if excused:
            # Phrases end in order; the earliest start of those that end at
            # or behind a place decides whether one reaches over a match.
            ends = [e for _, e in excused]
            starts = np.minimum.accumulate(np.array([s for s, _ in excused])[::-1])[::-1]
            at = np.searchsorted(ends, [e for _, e, _ in found])
            found = [h for h, k in zip(found, at, strict=True) if k == len(ends) or starts[k] > h[0]]
        return found

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + summed weights), log(1 + weights per 100 words)."""
        folded, words = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / (words + 10))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        x = self.model.beta[0] + self.model.beta[1] * a + self.model.beta[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def held_out(doc_id):
    """Rows never learnt from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _copy_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's five-word shingles, which copies and
    near copies share (as likely as their shingles agree)."""
    for part in bounded_slices(batches, "text"):
        keys = []
        for text in part.column("text").fill_null("").to_pylist():
            words = fold(text)[0].split()
            grams = zip(*(words[k:] for k in range(5)), strict=False) if len(words) >= 5 else [words]
            keys.append(min(xxhash.xxh64_intdigest(" ".join(g)) for g in grams) >> 1)
        yield pa.RecordBatch.from_arrays(
            [part.column("text"), part.column("toxic"), pa.array(keys, pa.int64())], names=["text", "toxic", "copy"]
        )


def _terms(text: str, shortest: int, longest: int) -> set[str]:
    """Whole words and word beginnings of a text, in pattern form."""
    out = set()
    for word in set(fold(text)[0].split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(shortest, min(longest, len(word)) + 1))
    return out


def _counted(sample: DataFrame, of, columns: str = "term string, pos long, neg long") -> DataFrame:
    """Documents of either label that have each term of ``of(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                counts[toxic == 1].update(of(text or ""))
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts[::-1])],
                names=["term", "pos", "neg"],
            )

    return map_arrow(sample, run, columns).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose(rows: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Lexicon from (term, toxic, clean document counts): the shortest terms
    that speak clearly for toxic texts, each drawn out as long as it keeps
    nearly all of its toxic documents."""
    weight = {}
    for term, pos, neg in rows:
        odds = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
        if odds >= math.log(20) and odds >= 4 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)):
            weight[term] = odds
    count = {term: pos for term, pos, _ in rows}
    lexicon: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for term in weight:
        longer.setdefault(term[:-1], []).append(term)
    for term in sorted(weight, key=lambda t: (len(t), t)):
        if any(term[:k] in lexicon for k in range(2, len(term))):
            continue
        at = term
        while (more := max(longer.get(at, []), key=lambda t: (count[t], t), default="")) and count[more] >= 0.95 * count[term]:
            at = more
        lexicon[at] = min(8.0, weight[at])
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each row counted ``times``
    times; the bias is not shrunk."""
    a = np.column_stack([np.ones(len(x)), x])
    beta, shrink = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (times * p * (1 - p))[:, None]) + shrink, a.T @ (times * (y - p)) - shrink @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, shortest: int = 3, longest: int = 12) -> Model:
    """A model from at most ``max_docs`` labelled documents, those with the
    smallest hash of their id, that are not held out. ``labels``: doc_id,
    toxic (0/1; a document labelled twice counts as toxic if one label says
    so). Without both classes the lexicon is empty."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic is not null")
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_docs)
    )
    # The sample's size is bounded by max_docs, so it may be broadcast.
    sample = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text")).join(
        F.broadcast(known), "id"
    )
    keyed = map_arrow(sample.select("text", "toxic"), _copy_key, "text string, toxic int, copy long")
    # One of each group of copies, always the same one: their words would all look like evidence.
    alone = keyed.groupBy("copy", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = materialize(alone.select("text", "toxic"), "labelled")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        return Model()
    support = max(5, math.ceil(0.004 * n_pos))
    rows = _counted(sample, lambda text: _terms(text, shortest, longest)).where(
        (F.col("pos") >= support) & (F.col("pos") / n_pos >= 8 * F.col("neg") / n_neg)
    ).collect()
    lexicon = choose([(r.term, r.pos, r.neg) for r in rows], n_pos, n_neg)
    first = Model(lexicon)

    def around(text: str) -> set[str]:
        folded, _ = fold(text)
        out = set()
        for start, end, _ in matcher().hits(folded):
            word_end = folded.find(" ", end - 1) + 1
            if start > 0:
                out.add(folded[folded.rfind(" ", 0, start) : word_end])
            if word_end < len(folded):
                out.add(folded[start : folded.find(" ", word_end) + 1])
        return out

    held: list[Matcher] = []

    def matcher() -> Matcher:
        if not held:
            held.append(Matcher(first))
        return held[0]

    pairs = _counted(sample, around).where(f"neg >= 3 and (pos + 0.5) / {n_pos + 1} < 0.5 * (neg + 0.5) / {n_neg + 1}")
    second = Model(lexicon, tuple(sorted(r.term for r in pairs.select("term").collect())))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(second)
        for part in bounded_slices(batches, "text"):
            x = [own.features(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in x], pa.float64()), pa.array([f[1] for f in x], pa.float64()), part.column("toxic").cast(pa.float64())], names=["a", "b", "y"]
            )

    # Texts without a match share one row of features: counted, not sorted.
    seen = map_arrow(sample, features, "a double, b double, y double").groupBy("a", "b", "y").count().collect()
    seen = np.array(sorted(map(tuple, seen)), float)
    beta = _logistic(seen[:, :2], seen[:, 2], seen[:, 3])
    return Model(second.lexicon, second.exceptions, tuple(float(x) for x in beta))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text without matches; a null
    doc_id stays null; repeated rows each give a row; other columns are
    ignored; empty in, empty out.
    """
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(model)
        for part in bounded_slices(batches, "text"):
            found = [own.score(t) for t in part.column("text").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], schema=out)

    return map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all
    columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(model)
        for part in bounded_slices(batches, "text"):
            texts = part.column(part.schema.get_field_index("text")).fill_null("").to_pylist()
            yield part.filter(pa.array([own.score(t) < threshold for t in texts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
