"""How far the sources of each language differ in the terms they use.

Terms are counted task by task in numpy, in buckets of length. A term of up to
eight bytes is one unsigned 64-bit word, one of up to sixteen is two; these
are sorted by radix and their runs counted. Longer terms are padded to the
next power of two and sorted as bytes, a bucket for each width. Rows are
brought into order of their group first and both sorts are stable, so one
pass over the sorted terms gives the occurrences and the documents of every
(group, term). Spark adds the counts up, one shuffle by language and term.

Smoothed probabilities and divergences are exact integers. A pair of sources
is compared over all kept terms of the language: terms are dealt into blocks,
sources too, and a task compares two blocks of sources on a block of terms as
a dense matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.llm.common import bounded_slices, map_arrow, materialize

SCALE = 1_000_000_000

#: What a byte of a term becomes, 0 if it is no part of one: letters, with
#: A-Z lower-cased, and all bytes of characters beyond ASCII.
FOLD = np.zeros(256, np.uint8)
FOLD[128:] = np.arange(128, 256)
for _low, _high in (("a", "z"), ("A", "Z")):
    _at = np.arange(ord(_low), ord(_high) + 1)
    FOLD[_at] = _at | 0x20

#: Keeps the first k bytes of a big-endian word.
KEEP = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(9)], np.uint64)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows of unsigned 64-bit words (most significant
    word first), by counting sorts of 16 bits from the last digit on."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _bytes_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all the pieces in a row, and the row's bounds."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)
    return data[at], bounds


def _sorted_buckets(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of lengths: the terms' numbers in the order of their
    bytes (equal terms in the given order), and where another term begins."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.ndarray(len(data) + 8, ">u8", padded, strides=(1,))
    for low, high in ((0, 8), (8, 16)):
        mine = np.flatnonzero((lengths > low) & (lengths <= high))
        if len(mine):
            first, size = starts[mine], lengths[mine]
            words = [word[first].astype(np.uint64)]
            if high > 8:
                words.append(word[first + 8].astype(np.uint64))
            words[-1] &= KEEP[size - low]
            order = radix_order(words)
            new = np.ones(len(mine), bool)
            new[1:] = False
            for w in words:
                new[1:] |= w[order[1:]] != w[order[:-1]]
            yield mine[order], new
    width = 16
    while (lengths > width).any():
        mine = np.flatnonzero((lengths > width) & (lengths <= 2 * width))
        width *= 2
        if len(mine):
            size = lengths[mine]
            text, bounds = _bytes_of(data, starts[mine], size)
            rows = np.zeros(len(mine) * width, np.uint8)
            rows[np.arange(len(text)) + np.repeat(np.arange(len(mine)) * width - bounds[:-1], size)] = text
            rows = rows.view(f"S{width}")
            order = np.argsort(rows, kind="stable")
            new = np.ones(len(mine), bool)
            new[1:] = rows[order[1:]] != rows[order[:-1]]
            yield mine[order], new


def count_terms(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) for every term of each group of
    texts (no nulls); ``group`` numbers each text's group."""
    order = np.argsort(group, kind="stable")
    texts, group = texts.take(pa.array(order)), group[order]
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets -= offsets[0]
    data = FOLD[data]
    inside = np.concatenate([data != 0, [False]])
    before = np.concatenate([[False], inside[:-1]])
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = inside.copy()
    after[offsets] = False
    ends = np.flatnonzero(inside[:-1] & ~after[1:]) + 1
    lengths, row = ends - starts, np.searchsorted(offsets, starts, "right") - 1
    found = []
    for at, new in _sorted_buckets(data, starts, lengths):
        r = row[at]
        g = group[r]
        new[1:] |= g[1:] != g[:-1]
        begins = np.flatnonzero(new)
        another = new.copy()
        another[1:] |= r[1:] != r[:-1]
        found.append((at[begins], g[begins], np.diff(np.append(begins, len(at))), np.add.reduceat(another.astype(np.int64), begins)))
    if not found:
        return pa.array([], pa.string()), *(np.empty(0, np.int64) for _ in range(3))
    at, g, n, docs = (np.concatenate(x) for x in zip(*found, strict=True))
    text, bounds = _bytes_of(data, starts[at], lengths[at])
    terms = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text))
    return terms, g, n, docs


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), partial counts of slices of the input."""
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text", 8 << 20):
            lang, source = (part.column(k).dictionary_encode() for k in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            term, g, n, held = count_terms(part.column("text"), group)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(g // len(source.dictionary))),
                    source.dictionary.take(pa.array(g % len(source.dictionary))),
                    term,
                    pa.array(n),
                    pa.array(held),
                ],
                schema=out,
            )

    return map_arrow(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n long, docs long")


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exact."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return _div(up, (total + 2 * kept).cast("decimal(19,0)")) + 1


def _kept(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, total, first): the occurrences of the terms
    that ``least_docs`` documents of the language hold, by source and over all
    sources; ``first`` marks one row of each term. Rows of one term are as
    many as the sources that use it."""
    whole = Window.partitionBy("lang", "term")
    return materialize(
        _counted(docs)
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("held", F.sum("docs").over(whole))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("first", F.col("source") == F.min("source").over(whole))
        .where(F.col("held") >= least_docs)
        .select("lang", "source", "term", "n", "total", "first"),
        "kept",
    )


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, words, terms, lang_words, s) of each group: words and
    terms that count, and the source's number within the language."""
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_words"), F.sum(F.col("first").cast("long")).alias("terms"))
    zero = F.lit(0).cast("long")
    return materialize(
        docs.select("lang", "source")
        .distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left")
        .join(by_lang, "lang", "left")
        .select(
            "lang",
            "source",
            F.coalesce("words", zero).alias("words"),
            F.coalesce("terms", zero).alias("terms"),
            F.coalesce("lang_words", zero).alias("lang_words"),
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("s"),
        ),
        "groups",
    )


def pair_sums(index: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray, term: np.ndarray, source: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of divergences over the terms given) for the pairs of sources
    one of which is in ``left`` and one in ``right`` (masks over ``index``, the
    sources in order). ``base``: a source's p of a term that it lacks."""
    names, at = np.unique(term, return_inverse=True)
    table = np.repeat(base[:, None], len(names), axis=1)
    table[np.searchsorted(index, source), at] = p
    found = []
    for k in np.flatnonzero(left):
        others = np.flatnonzero(right)
        others = others[others > k] if left[others].all() else others
        gap = table[others] - table[k]
        found.append((np.full(len(others), index[k]), index[others], (gap * gap // (table[others] + table[k])).sum(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pairs(groups: DataFrame, shares: DataFrame, sources: int, terms: int) -> DataFrame:
    """(lang, a, b, value, seen): divergence of sources number a < b summed
    over the ``seen`` kept terms that a task came across."""
    number = lambda size: F.floor(F.col("s") / size).cast("int")
    parts = F.ceil(F.col("terms") / terms).cast("int")
    blocks = groups.groupBy("lang").agg(F.max(number(sources)).alias("last"))
    deal = lambda rows: (
        rows.join(blocks, "lang")
        .withColumn("block", number(sources))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("lang", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "s", "term", "p")
    )
    rows = deal(shares.withColumn("part", F.pmod(F.xxhash64("term"), parts).cast("int")))
    empty = (
        groups.where("terms > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("term", F.lit(None).cast("string"))
        .withColumn("p", _p(F.lit(0).cast("long"), F.col("words"), F.col("terms")))
    )
    rows = rows.unionAll(deal(empty))

    def compare(group: pa.Table) -> pa.Table:
        lang, i, j = (group.column(k)[0].as_py() for k in ("lang", "i", "j"))
        term = group.column("term").combine_chunks().dictionary_encode()
        code = term.indices.fill_null(-1).to_numpy()
        s, p, block = (group.column(k).to_numpy() for k in ("s", "p", "block"))
        at = np.flatnonzero(code < 0)
        at = at[np.argsort(s[at])]
        held = code >= 0
        a, b, value = pair_sums(s[at], p[at], block[at] == i, block[at] == j, code[held], s[held], p[held])
        low, high = np.minimum(a, b), np.maximum(a, b)
        seen = np.full(len(a), len(term.dictionary))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": low.astype(np.int32), "b": high.astype(np.int32), "value": value, "seen": seen})

    found = rows.groupBy("lang", "part", "i", "j").applyInArrow(compare, "lang string, a int, b int, value long, seen long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of columns that are not negative."""
    return F.call_function("div", a, b)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, sources: int = 256, terms: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs`` (text, lang,
    source). With p = 1 + floor(10**9 (n + 2) / (N + 2 V)) for a term of n
    occurrences among the N of V kept terms in a group, and the divergence
    floor((p - q)**2 / (p + q)):

    * part ``pair``: every other source of the language, by divergence summed
      over the language's kept terms;
    * part ``term``: the ``top`` terms that the group uses more than its
      language does, by divergence.

    Kept are the terms that ``least_docs`` documents of the language hold.
    Null texts, languages and sources read as empty; empty texts have no
    terms, but their groups take part; repeated rows are documents of their
    own; ties rank by the item's bytes; other columns are ignored; empty in,
    empty out. The result holds every pair of a language's sources, so these
    are taken to be few enough to list; rows of one term or language are as
    many as its sources.
    """
    docs = docs.select(*[F.coalesce(docs[k].cast("string"), F.lit("")).alias(k) for k in ("text", "lang", "source")])
    kept = _kept(docs, least_docs)
    groups = _groups(docs, kept)
    p = _p(F.col("n"), F.col("words"), F.col("terms"))
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", p)
    q = _p(F.col("total"), F.col("lang_words"), F.col("terms"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    tops = (
        shares.withColumn("q", q)
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= top)
    )
    sums = materialize(_pairs(groups, shares, sources, terms), "pairs")
    none = F.when(F.col("terms") > 0, _p(F.lit(0).cast("long"), F.col("words"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    one = groups.select("lang", "source", "s", "terms", none.alias("p0"))
    two = one.select("lang", F.col("source").alias("item"), F.col("s").alias("s2"), F.col("p0").alias("q0"))
    zero = F.lit(0).cast("long")
    pairs = (
        one.join(two, "lang")
        .where("s <> s2")
        .withColumn("a", F.least("s", "s2"))
        .withColumn("b", F.greatest("s", "s2"))
        .join(sums, ["lang", "a", "b"], "left")
        .select(
            "lang",
            "source",
            F.lit("pair").alias("part"),
            "item",
            (F.coalesce("value", zero) + (F.col("terms") - F.coalesce("seen", zero)) * _f(F.col("p0"), F.col("q0"))).alias("value"),
        )
        .withColumn("rank", F.row_number().over(by_value))
    )
    return pairs.unionAll(tops)


#: The audit in DuckDB.
AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), terms AS (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs)
), kept AS (
  SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang
), used AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT g.lang, g.source, coalesce(u.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM used GROUP BY lang, source) u ON u.lang = g.lang AND u.source = g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 2)) // (l.nl + 2 * l.v) AS q
  FROM grp g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
