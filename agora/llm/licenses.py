"""Licence scan: TF-IDF cosine to templates, inherited down directories.

A file's lines, and its windows of as many consecutive words as a template
has, across lines, are compared with licence templates as sparse TF-IDF
vectors; the best one decides the file's own licence. A file without one
takes that of the nearest ancestor directory that holds a licence file.
Templates are notices, passages that identify licence texts and headers, and
titles; a title must be a line.

Template words are few, so their weights are literals of the plan. The
document frequencies come from the whole corpus; those of other words are
counted for the words of the lines and windows that are compared. Only lines and windows with one of a
template's heavy words, and with enough of its weight to reach the threshold,
are compared: without, even one that agrees in all other words stays below
it. Inheritance joins each directory once with all its ancestors; files then
join their directory. All steps are DataFrame operations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from agora.llm.common import materialize

#: Notices as projects write them, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright is waived under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Passages of licence texts and headers that tell the licence.
PASSAGES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: What a line of its own says at the top of a licence text.
TITLES = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("ISC", "ISC License"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)"
TERM = r"[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Templates:
    """Licence texts (a bounded, given set) and the cosine that identifies one."""

    texts: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    least: float = 0.8
    passages: tuple[tuple[str, str], ...] = PASSAGES
    titles: tuple[tuple[str, str], ...] = TITLES

    def counts(self) -> dict[tuple[str, str, bool], Counter]:
        """Words of each template: (licence, text, whether it must be a line)."""
        every = [*((*t, False) for t in (*self.texts.items(), *self.passages)), *((*t, True) for t in self.titles)]
        return {t: Counter(re.findall(TERM, t[1].lower())) for t in every}

    def vocabulary(self) -> list[str]:
        return sorted({t for c in self.counts().values() for t in c})


def terms(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_weights(texts: DataFrame, templates: Templates) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template word over all rows of
    ``texts`` (text), and that of a word in no document."""
    known = F.array(*map(F.lit, templates.vocabulary()))
    found = texts.select(F.array_intersect(terms(F.coalesce("text", F.lit(""))), known).alias("t"))
    # One row per template word comes to the driver, and the row count.
    rows = found.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("t")).groupBy("t").count().collect()
    df = {r.t: r["count"] for r in rows}
    n = df.get("", 0)
    return {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in templates.vocabulary()}, math.log(n + 1) + 1


def _heavy(counts: Counter, weight: dict[str, float], least: float) -> list[str]:
    parts = sorted(((c * weight[t], t) for t, c in counts.items()), reverse=True)
    out, whole, rest = [], math.sqrt(sum(x * x for x, _ in parts)), sum(x * x for x, _ in parts)
    for x, t in parts:
        if math.sqrt(max(0.0, rest)) < least * whole * (1 - 1e-9):
            break
        out.append(t)
        rest -= x * x
    return out


def heavy_terms(templates: Templates, weight: dict[str, float]) -> list[str]:
    """Words of which a line must have one to reach the threshold for a
    template: its heaviest, until the others' share of its length is less."""
    return sorted({t for counts in templates.counts().values() for t in _heavy(counts, weight, templates.least)})


def _vectors(templates: Templates, weight: dict[str, float]) -> Column:
    """The templates as one literal: license, must it be a line, number of
    words, heavy words, and the unit vector by word."""
    out = []
    for k, ((name, _, line), counts) in enumerate(templates.counts().items()):
        size = math.sqrt(sum((c * weight[t]) ** 2 for t, c in counts.items()))
        out.append(
            F.struct(
                F.lit(k).alias("k"),
                F.lit(name).alias("license"),
                F.lit(line).alias("line"),
                F.lit(sum(counts.values())).alias("length"),
                F.array(*map(F.lit, _heavy(counts, weight, templates.least))).alias("heavy"),
                F.create_map(*[F.lit(x) for t, c in counts.items() for x in (t, c * weight[t] / size)]).alias("share"),
            )
        )
    return F.array(*out)


def _units(texts: DataFrame, templates: Templates, weight: dict[str, float]) -> DataFrame:
    """Lines and windows of ``texts`` (key, text) that may reach the threshold
    for a template, by their words: key, k, license and words."""
    heavy, vectors = heavy_terms(templates, weight), _vectors(templates, weight)
    longest = max(sum(c.values()) for c in templates.counts().values())
    pattern = rf"(?i)(?<![a-z0-9])({'|'.join(heavy)})(?![a-z0-9])"
    needed = F.array(*map(F.lit, heavy))

    def fits(words: Column, share: Column) -> Column:
        """Whether the template's words in ``words`` have enough of its length."""
        own = F.aggregate(F.array_intersect(words, F.map_keys(share)), F.lit(0.0), lambda a, t: a + F.element_at(share, t) * F.element_at(share, t))
        return F.sqrt(own) >= templates.least * (1 - 1e-9)

    texts = texts.where(F.col("text").rlike(pattern))
    lines = texts.select("key", F.explode(F.filter(F.transform(F.split("text", "\n"), terms), lambda w: F.arrays_overlap(w, needed))).alias("words"))
    lines = lines.select("key", "words", F.explode(F.filter(vectors, lambda t: fits(F.col("words"), t["share"]))).alias("t"))
    words = F.col("words")
    near = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(heavy)),
        lambda i: F.struct(
            F.element_at(words, i).alias("word"),
            F.least(i, F.lit(longest)).alias("at"),
            F.slice(words, F.greatest(F.lit(1), i - longest + 1), F.least(i, F.lit(longest)) + longest - 1).alias("words"),
        ),
    )
    near = texts.select("key", terms(F.col("text")).alias("words")).select("key", F.explode(near).alias("near")).select("key", "near.*")
    near = near.select(
        "key", "at", "words",
        F.explode(F.filter(vectors, lambda t: ~t["line"] & F.array_contains(t["heavy"], F.col("word")) & fits(F.col("words"), t["share"]))).alias("t"),
    )
    starts = F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("t.length") + 1), F.col("at"))
    windows = near.select("key", "t", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("t.length")))).alias("words"))
    windows = windows.where(fits(F.col("words"), F.col("t.share")))
    return lines.select("key", "t.k", "t.license", "words").union(windows.select("key", "t.k", "t.license", "words")).distinct()


def own_licences(texts: DataFrame, templates: Templates, weight: dict[str, float], unknown: float) -> DataFrame:
    """key and best (minus the score, license) of each of ``texts`` (key, text)
    that reaches the threshold; equal keys are equal texts."""
    units = _units(texts, templates, weight).withColumn("unit", F.sha2(F.concat_ws(" ", "words"), 256))
    units = materialize(units, "units")
    counts = units.select("unit", "words").distinct().select("unit", F.explode("words").alias("word")).groupBy("unit", "word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    # All words are counted before they meet the few that are asked for, so
    # that a frequent word costs a row per map task.
    seen = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    asked = counts.select("word").where(~F.col("word").isin(list(weight))).distinct()
    seen = materialize(seen.join(asked, "word", "left_semi"), "seen")
    known = F.create_map(*[F.lit(x) for t, w in weight.items() for x in (t, w)])
    shares = F.transform(_vectors(templates, weight), lambda t: t["share"])
    w, n = F.col("w"), F.col("n")
    # unknown is ln(n + 1) + 1 for n texts.
    parts = counts.join(seen, "word", "left").select(
        "unit", "word", "n", F.coalesce(F.try_element_at(known, F.col("word")), unknown - F.log(F.coalesce("df", F.lit(0)) + 1)).alias("w")
    )
    parts = units.select("unit", "k").distinct().join(parts, "unit")
    scores = parts.groupBy("unit", "k").agg(
        F.sum(n * w * F.try_element_at(F.element_at(shares, F.col("k") + 1), F.col("word"))).alias("dot"),
        F.sqrt(F.sum(n * w * n * w)).alias("size"),
    )
    scores = scores.select("unit", "k", F.round(-F.col("dot") / F.col("size"), 6).alias("minus")).where(F.col("minus") <= -templates.least)
    best = units.drop("words").join(materialize(scores, "scores"), ["unit", "k"])
    return best.groupBy("key").agg(F.min(F.struct("minus", "license")).alias("best"))


def scan(files: DataFrame, templates: Templates = Templates()) -> DataFrame:
    """Licence of each row of ``files`` (doc_id, path, text): doc_id, path,
    own_license and own_score (the best line's or window's template and cosine,
    if it reaches the threshold), license (its own or the inherited one) and
    license_dir (the directory it is inherited from, null if its own).

    The licence of a directory is that of its licence files' best match (ties
    by identifier and path). Null and empty texts have no licence of their
    own; a file without a path inherits nothing; repeated rows each give a
    row; other columns are ignored; empty in, empty out.
    """
    slim = files.select(
        files["doc_id"].cast("long").alias("doc_id"), files["path"].cast("string").alias("path"), files["text"].cast("string").alias("text")
    )
    weight, unknown = term_weights(slim.select("text"), templates)
    parts = F.split("path", "/")
    slim = slim.withColumn("key", F.sha2("text", 256))
    # Written first, so that a text with very many copies is split by the
    # skew join of two plain scans; only candidates look for their match.
    best = materialize(own_licences(slim.select("key", "text"), templates, weight, unknown), "best")
    own = materialize(
        slim.select("doc_id", "path", F.coalesce("key", F.concat(F.lit("none"), F.rand())).alias("key")).join(best, "key", "left").select(
            "doc_id",
            "path",
            F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"),
            F.element_at(parts, -1).rlike(LICENCE_FILE).alias("shared"),
            F.col("best.license").alias("own_license"),
            (-F.col("best.minus")).alias("own_score"),
        ),
        "own",
    )
    granted = (
        own.where("shared and own_license is not null")
        .groupBy(F.col("dir").alias("license_dir"))
        .agg(F.min(F.struct(-F.col("own_score"), "own_license", "path")).alias("best"))
        .select("license_dir", F.col("best.own_license").alias("inherited"))
    )
    names = F.split("dir", "/")
    ancestors = own.where("dir is not null").select("dir").distinct().select(
        "dir",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("license_dir")))).alias("up"),
    ).select("dir", "up.depth", "up.license_dir")
    nearest = ancestors.join(granted, "license_dir").groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "inherited")).alias("near"))
    # Written first, so that a directory with very many files is split by the
    # skew join of two plain scans.
    nearest = materialize(nearest.select("dir", "near.license_dir", "near.inherited"), "nearest")
    return own.join(nearest, "dir", "left").select(
        "doc_id", "path", "own_license", "own_score",
        F.coalesce("own_license", "inherited").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("license_dir")).alias("license_dir"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files (doc_id, path, text): a repository per
    source, a directory per language and per hundred ids; every tenth id is
    its directory's licence file, every hundredth its language's, every
    thousandth its repository's."""
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("none"))
    doc_id = docs["doc_id"]
    folder = F.coalesce(F.floor(doc_id / 100).cast("string"), F.lit("none"))
    path = (
        F.when(doc_id % 1000 == 0, F.concat_ws("/", name("source"), F.concat(F.lit("LICENSE."), doc_id)))
        .when(doc_id % 100 == 0, F.concat_ws("/", name("source"), name("lang"), F.concat(F.lit("LICENSE."), doc_id)))
        .when(doc_id % 10 == 0, F.concat_ws("/", name("source"), name("lang"), folder, F.concat(F.lit("LICENSE."), doc_id)))
        .otherwise(F.concat_ws("/", name("source"), name("lang"), folder, F.concat(F.lit("doc."), F.coalesce(doc_id.cast("string"), F.lit("none")))))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def _sql() -> str:
    rows = ", ".join(f"('{k}', '{t}')" for k, t in TEMPLATES.items())
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
WITH template(license, words) AS (
  SELECT k, regexp_extract_all(lower(t), '{TERM}') FROM (VALUES {rows}) v(k, t)
), template_term AS (
  SELECT license, term, count(*) AS n FROM (SELECT license, unnest(words) AS term FROM template) GROUP BY ALL
), file AS (
  SELECT doc_id, coalesce({lower}, '') AS body,
         coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, (doc_id // 100)::VARCHAR AS f
  FROM documents
), placed AS (
  SELECT doc_id, body,
         CASE WHEN doc_id % 1000 = 0 THEN s WHEN doc_id % 100 = 0 THEN s || '/' || l ELSE s || '/' || l || '/' || f END AS dir,
         CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' ELSE 'doc.' END || doc_id AS name
  FROM file
), seen AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '{TERM}')) AS term FROM placed
), idf AS (
  SELECT term, ln(((SELECT count(*) FROM file) + 1) / (count(doc_id) + 1)) + 1 AS w
  FROM (SELECT DISTINCT term FROM template_term) LEFT JOIN seen USING (term) GROUP BY term
), template_size AS (
  SELECT license, sqrt(sum(n * w * n * w)) AS size FROM template_term JOIN idf USING (term) GROUP BY license
), line AS (
  SELECT doc_id, row_number() OVER () AS line, words
  FROM (SELECT doc_id, regexp_extract_all(unnest(string_split(body, chr(10))), '{TERM}') AS words FROM placed)
), line_term AS (
  SELECT doc_id, line, term, count(*) AS n FROM (SELECT doc_id, line, unnest(words) AS term FROM line) GROUP BY ALL
), line_size AS (
  SELECT doc_id, line, sqrt(sum(CASE WHEN w IS NULL THEN n * power(ln((SELECT count(*) FROM file) + 1) + 1, 2) ELSE n * w * n * w END)) AS size
  FROM line_term LEFT JOIN idf USING (term) GROUP BY ALL
), scored AS (
  SELECT lt.doc_id, lt.line, tt.license, round(sum(lt.n * i.w * tt.n * i.w) / any_value(ts.size) / any_value(ls.size), 6) AS score
  FROM line_term lt JOIN idf i USING (term) JOIN template_term tt USING (term)
       JOIN template_size ts ON ts.license = tt.license JOIN line_size ls ON ls.line = lt.line
  GROUP BY lt.doc_id, lt.line, tt.license
), own AS (
  SELECT p.doc_id, p.dir, p.name, b.license AS own_license, b.score AS own_score
  FROM placed p LEFT JOIN (
    SELECT doc_id, license, score FROM scored WHERE score >= 0.8
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1
  ) b ON b.doc_id = p.doc_id
), granted AS (
  SELECT dir, own_license AS inherited FROM own WHERE own_license IS NOT NULL AND name LIKE 'LICENSE%'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license, name) = 1
), nearest AS (
  SELECT o.doc_id, g.dir AS license_dir, g.inherited
  FROM own o JOIN granted g ON o.dir = g.dir OR starts_with(o.dir, g.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(g.dir) DESC) = 1
)
SELECT o.doc_id, o.dir || '/' || o.name AS path, own_license, own_score,
       coalesce(own_license, inherited) AS license, CASE WHEN own_license IS NULL THEN license_dir END AS license_dir
FROM own o LEFT JOIN nearest n ON n.doc_id = o.doc_id
"""


#: The query's result in SQL.
SCAN_SQL = _sql()
