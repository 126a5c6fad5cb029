"""Secret scan: fixed patterns plus a randomness test battery.

Three patterns give the base spans. On what they leave, runs of encoding
characters are candidates. Each is read in its inferred encoding (letters,
hex, base 32, 36, 64) and tested for randomness: chi-squared uniformity over
the alphabet, the number of runs above and below the alphabet's middle, and
the lag-one serial correlation. The z-scores add up to a departure from
randomness, which grows with length for ordinary text and does not for
random characters.

``reference`` is the departure's distribution for ordinary text of an
encoding and length: letters as frequent as in running text, with the
capitals, digits and signs that names have. It is simulated from fixed
shares, so no answer depends on what else a table holds, but for the number
of tests: a candidate's p-value is the chance that ordinary text of its
length looks as random, and the Benjamini-Hochberg step runs within each
encoding and length class at false discovery rate ``fdr``, so that many short
words do not hide a long key.

Everything is DataFrame expressions over one row at a time; only a histogram
of p-values per class is shuffled and reaches the driver (a bounded number of
rows).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from agora.llm.common import materialize

#: The base patterns. Shorter matches of ``access`` and ``hex``
#: can't hide longer ones, so their lengths are part of the pattern.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")

WORD_SHAPE = r"^([A-Z]?[a-z]+|[A-Z]+)$"
HEX_SHAPE = r"^([0-9a-f]+|[0-9A-F]+)$"
B32_SHAPE = r"^[A-Z2-7]+$"
B36_SHAPE = r"^([0-9a-z]+|[0-9A-Z]+)$"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "word": LETTERS.lower(),
    "hex": "0123456789abcdef",
    "b32": LETTERS + "234567",
    "b36": "0123456789" + LETTERS.lower(),
    "b64": LETTERS + LETTERS.lower() + "0123456789+/",
}

#: Lower ends of the length classes, and the -ln p histogram's step and end.
CLASSES = (16, 20, 24, 32, 48)
STEP, LAST = 0.01, 5000

#: Lengths for which the reference is simulated; between them it is linear.
LENGTHS = (16, 20, 24, 32, 48, 64, 96, 128, 256, 512)

#: Letters per 1000 of running text, a to z (a round mean of
#: English, German, French and Spanish).
LETTER_SHARES = (86, 15, 30, 43, 146, 14, 17, 24, 76, 3, 5, 45, 27, 77, 57, 20, 5, 65, 70, 68, 40, 11, 10, 3, 6, 7)

#: Shares of small letters, capitals, digits and signs in ordinary candidates.
SHARES = {"word": (1, 0, 0, 0), "hex": (0.75, 0, 0.25, 0), "b32": (0, 0.85, 0.15, 0), "b36": (0.85, 0, 0.15, 0), "b64": (0.8, 0.1, 0.05, 0.05)}

#: The least -ln p bucket that is a secret, by encoding and length class.
Threshold = dict[tuple[str, int], int]


def battery(x: np.ndarray, k: int) -> np.ndarray:
    """The departure of each row of symbol numbers below ``k``."""
    n, df = x.shape[1], k - 1
    squares = sum((x == c).sum(axis=1).astype(float) ** 2 for c in range(k))
    chi = np.maximum(k / n * squares - n, 0)
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    side = x * 2 >= k
    high = side.sum(axis=1).astype(float)
    changes = (side[:, 1:] != side[:, :-1]).sum(axis=1)
    runs = 2 * high * (n - high) / n + 1
    spread = (runs - 1) * (runs - 2) / (n - 1)
    z_runs = np.where(spread > 0, (changes + 1 - runs) / np.sqrt(np.where(spread > 0, spread, 1)), math.sqrt(n))
    off = x - x.mean(axis=1, keepdims=True)
    total = (off * off).sum(axis=1)
    z_serial = np.where(total > 0, (off[:, 1:] * off[:, :-1]).sum(axis=1) / np.where(total > 0, total, 1), 1) * math.sqrt(n)
    return z_chi + (np.abs(z_runs) + np.abs(z_serial)) / 4


@lru_cache(maxsize=None)
def reference(kind: str, length: int, samples: int = 4000) -> tuple[float, float]:
    """Mean and deviation of the departure of ordinary text."""
    alphabet = ALPHABETS[kind]
    small, capital, digit, sign = SHARES[kind]
    letters = np.array(LETTER_SHARES) / sum(LETTER_SHARES)
    share = np.zeros(len(alphabet))
    for at, c in enumerate(alphabet):
        if c.isalpha():
            share[at] = (small if c.islower() else capital) * letters[ord(c.lower()) - ord("a")]
        else:
            share[at] = digit if c.isdigit() else sign
    groups = [c.isdigit() for c in alphabet], [c in "+/" for c in alphabet]
    for members in groups:
        share[members] /= max(1, sum(members))
    share /= share.sum()
    x = np.random.default_rng(length).choice(len(alphabet), (samples, length), p=share)
    found = battery(x, len(alphabet))
    return round(float(found.mean()), 4), round(float(found.std()), 4)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, block: int = 64) -> Column:
    """Running sums of an array, in about n * block steps."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def sums(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(block))
        before = F.aggregate(
            F.transform(starts, lambda k: total(F.slice(v, k + 1, block))),
            F.array(F.lit(0).cast("long")),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        )
        return _let(
            before,
            lambda b: F.transform(
                v, lambda x, i: b[F.floor(i / block).cast("int")] + total(F.slice(v, i - i % block + 1, i % block + 1))
            ),
        )

    return _let(values, lambda v: F.when(F.size(v) > 0, sums(v)).otherwise(F.array().cast("array<bigint>")))


def _parts(text: Column, pattern: str, body: Callable[[Column], Column], otherwise: Column, group: int = 0) -> Column:
    """``body`` over (m: matches, g: a group of them, pieces: the text around
    them) if the pattern occurs, else ``otherwise``."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
        F.split(text, pattern, -1).alias("pieces"),
    )
    return F.when(text.rlike(pattern), _let(found, body)).otherwise(otherwise)


def _places(p: Column) -> Column:
    """(start, end, m, g) of each match in code points."""
    sizes = F.transform(p["m"], lambda m, i: (F.length(p["pieces"][i]) + F.length(m)).cast("long"))
    return _let(
        _running(sizes),
        lambda ends: F.transform(
            p["m"],
            lambda m, i: F.struct((ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("m"), p["g"][i].alias("g")),
        ),
    )


def _rebuilt(p: Column, replace: Callable[[Column, Column], Column]) -> Column:
    """The text with each match m (group g) replaced."""
    body = F.transform(p["m"], lambda m, i: F.concat(p["pieces"][i], replace(m, p["g"][i])))
    return F.concat(F.array_join(body, ""), F.element_at(p["pieces"], -1))


SPANS = "array<struct<start:bigint,end:bigint>>"


def _spans(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    def body(p: Column) -> Column:
        good = F.filter(_places(p), lambda x: F.length(x["g"]) >= least)
        return F.transform(good, lambda x: F.struct(x["start"], x["end"])).cast(SPANS)

    return _parts(text, pattern, body, F.array().cast(SPANS), group)


def _replaced(text: Column, pattern: str, by: Callable[[Column], Column], least: int = 0, group: int = 0) -> Column:
    swap = lambda m, g: F.when(F.length(g) >= least, by(m)).otherwise(m)
    return _parts(text, pattern, lambda p: _rebuilt(p, swap), text, group)


def without_base(rows: DataFrame, name: str, by: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with all base matches in column ``name`` replaced. One column
    step per pattern: a text that several expressions use is made once."""
    rows = rows.withColumn(name, _replaced(F.col(name), ASSIGN, by, 12, 2))
    rows = rows.withColumn(name, _replaced(F.col(name), ACCESS, by))
    return rows.withColumn(name, _replaced(F.col(name), HEX, by))


def encoding(token: Column) -> Column:
    """The inferred encoding of a candidate; null for plain digits."""
    return (
        F.when(token.rlike(r"^[0-9+/_=-]+$"), None)
        .when(token.rlike(WORD_SHAPE), "word")
        .when(token.rlike(HEX_SHAPE), "hex")
        .when(token.rlike(B32_SHAPE), "b32")
        .when(token.rlike(B36_SHAPE), "b36")
        .otherwise("b64")
    )


def departure(token: Column, kind: Column) -> Column:
    """How far a token departs from random characters of its encoding, in
    added z-scores (``battery`` in columns)."""
    plain = F.when(kind.isin("word", "hex", "b36"), F.lower(token)).when(kind == "b64", F.translate(F.rtrim(F.translate(token, "=", " ")), "-_ ", "+/=")).otherwise(token)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for k, v in ALPHABETS.items() for x in (k, v)]), kind)

    def tests(s: Column) -> Column:
        x, n, k = s["x"], F.size(s["x"]).cast("double"), s["k"].cast("double")
        squares = F.aggregate(
            F.array_distinct(x),
            F.lit(0.0),
            lambda acc, c: acc + F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), 2.0),
        )
        chi, df = k / n * squares - n, k - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = F.size(F.filter(x, lambda y: y * 2 >= k)).cast("double")
        low = n - high
        changes = F.size(F.filter(F.sequence(F.lit(1), F.size(x) - 1), lambda i: (x[i] * 2 >= k) != (x[i - 1] * 2 >= k)))
        mean_runs = 2 * high * low / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, (changes + 1 - mean_runs) / F.sqrt(var_runs)).otherwise(F.sqrt(n))
        mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n

        def serial(m: Column) -> Column:
            spread = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - m) * (y - m))
            lag = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda a, i: a + (x[i] - m) * (x[i - 1] - m))
            return F.when(spread > 0, lag / spread * F.sqrt(n)).otherwise(F.sqrt(n))

        z_serial = _let(mean, serial)
        return z_chi + (F.abs(z_runs) + F.abs(z_serial)) / 4

    values = F.transform(
        F.filter(F.split(plain, ""), lambda c: F.length(c) > 0), lambda c: F.greatest(F.instr(alphabet, c) - 1, F.lit(0)).cast("int")
    )
    return _let(F.struct(values.alias("x"), F.length(alphabet).alias("k")), lambda s: F.when(F.size(s["x"]) > 2, tests(s)))


def _class(size: Column) -> Column:
    """Index of the length class."""
    return sum(((size >= low).cast("int") for low in CLASSES[1:]), F.lit(0))


def _judged(token: Column) -> Column:
    """(kind, size class, p-value bucket) of a candidate."""
    kind, size = encoding(token), F.length(token)

    def bucket(z: Column) -> Column:
        return F.when(kind.isNotNull(), _bucket(z, kind, size))

    return F.struct(kind.alias("kind"), _class(size).alias("cls"), F.when(kind.isNotNull(), _let(departure(token, kind), bucket)).alias("bucket"))


def _bucket(departed: Column, kind: Column, size: Column) -> Column:
    """-ln p in histogram steps: p is the chance that ordinary text of this
    encoding and length departs as little."""
    n = F.greatest(F.lit(LENGTHS[0]), F.least(size, F.lit(LENGTHS[-1]))).cast("double")
    at = sum(((n >= low).cast("int") for low in LENGTHS[1:-1]), F.lit(0))
    table = F.create_map(
        *[x for k in ALPHABETS for x in (F.lit(k), F.array(*[F.struct(*[F.lit(float(v)) for v in (m, *reference(k, m))]) for m in LENGTHS]))]
    )

    def score(s: Column) -> Column:
        low, high = s["t"][s["at"]], s["t"][s["at"] + 1]
        part = (n - low["col1"]) / (high["col1"] - low["col1"])
        mean = low["col2"] + part * (high["col2"] - low["col2"])
        spread = low["col3"] + part * (high["col3"] - low["col3"])
        z = F.least((departed - mean) / spread, F.lit(8.0))
        # The normal tail's logistic form, exact to 2e-4 and falling in z.
        minus_ln_p = F.log1p(F.exp(F.least(F.lit(300.0), -(1.5976 * z + 0.070566 * z * z * z))))
        return F.least(F.floor(minus_ln_p / STEP), F.lit(LAST)).cast("int")

    return _let(F.struct(F.element_at(table, kind).alias("t"), at.alias("at")), score)


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the spans of the three
    base kinds, and the judged candidates. No text is kept."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))

    def judge(p: Column) -> Column:
        return F.transform(_places(p), lambda x: F.struct(x["start"], x["end"], _judged(x["m"]).alias("judged"))).cast(JUDGED)

    one = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("masked")).select(
        "doc_id",
        "masked",
        _spans(F.col("masked"), ASSIGN, 12, 2).alias("assign"),
        _spans(F.col("masked"), ACCESS).alias("access"),
        _spans(F.col("masked"), HEX).alias("hex"),
    )
    one = without_base(one, "masked", lambda m: F.repeat(F.lit(" "), F.length(m)))
    return one.select("doc_id", "assign", "access", "hex", _parts(F.col("masked"), CANDIDATE, judge, F.array().cast(JUDGED)).alias("candidates"))


JUDGED = "array<struct<start:bigint,end:bigint,judged:struct<kind:string,cls:int,bucket:int>>>"


def decide(found: DataFrame, fdr: float = 0.01) -> Threshold:
    """The Benjamini-Hochberg step of each encoding and length class."""
    judged = found.select(F.explode("candidates.judged").alias("j")).where("j.bucket is not null")
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in judged.groupBy("j.kind", "j.cls", "j.bucket").count().collect():
        counts.setdefault((r.kind, r.cls), {})[r.bucket] = r["count"]
    return {group: least_bucket(of, fdr) for group, of in counts.items()}


def least_bucket(counts: dict[int, int], fdr: float) -> int:
    """The least bucket of -ln p that the step accepts, given how many tests
    each bucket holds; one above all buckets if it accepts none."""
    tests, below, least = sum(counts.values()), 0, LAST + 1
    for b in sorted(counts, reverse=True):
        below += counts[b]
        if math.exp(-b * STEP) <= fdr * below / tests:
            least = b
    return least


def _secret(judged: Column, threshold: Threshold) -> Column:
    limit = F.lit(LAST + 1)
    for (kind, cls), least in sorted(threshold.items()):
        limit = F.when((judged["kind"] == kind) & (judged["cls"] == cls), least).otherwise(limit)
    return F.coalesce(judged["bucket"] >= limit, F.lit(False))


def spans(found: DataFrame, threshold: Threshold) -> DataFrame:
    """doc_id and ``spans``, all (start, kind number, end) in order of start
    and kind; code points, end exclusive."""
    def of(name: str, number: int) -> Column:
        return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))

    random = F.filter("candidates", lambda x: _secret(x["judged"], threshold))
    base = [of(k, n) for n, k in enumerate(KINDS[:3])]
    added = F.transform(random, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*base, added)).alias("spans"))


def scan(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): doc_id, base and all
    spans as arrays of (start, kind number in KINDS, end).

    Null counts as empty text (no spans); a null doc_id stays null; repeated
    rows each give a row; other columns are ignored; empty in, empty out.
    """
    found = materialize(candidates(docs), "candidates")
    return spans(found, decide(found, fdr))


def listed(spans: Column | str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", fdr: float = 0.01) -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mark`` (and
    n_chars, where there is such a column, counted anew); all rows and
    columns stay; a null text stays null."""
    limit = decide(materialize(candidates(docs), "candidates"), fdr)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs["text"].cast("string").alias("text"))
    rows = without_base(rows, "text", lambda m: F.lit(mark))

    def swap(m: Column, _: Column) -> Column:
        secret = _let(_judged(m), lambda j: _secret(j, limit))
        return F.when(secret, F.lit(mark)).otherwise(m)

    rows = rows.withColumn("text", _parts(F.col("text"), CANDIDATE, lambda p: _rebuilt(p, swap), F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in names])
