from __future__ import annotations

import math
import re
from collections import Counter

from agora.llm.licenses import LICENCE_FILE, TEMPLATES, Templates, as_files, heavy_terms, scan, term_weights

FILES = [
    (1, "repo/LICENSE", "Released under the MIT License.\n\nmore text here"),
    (2, "repo/src/a.py", "# Licensed under the Apache License, Version 2.0.\ncode " * 2),
    (3, "repo/src/deep/b.py", "no notice at all, mit der version"),
    (4, "repo/src/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (5, "repo/src/deep/er/c.py", ""),
    (6, "other/d.py", None),
    (7, "e.py", "nothing"),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, None, "nothing"),
    (10, "repository/f.py", "a different directory that only starts alike"),
    (11, "repo/src/deep/LICENSE", "An unknown text that grants nothing."),
    (11, "repo/src/deep/LICENSE", "An unknown text that grants nothing."),
    (None, "repo/g.py", "word " * 40_000 + "\nLicensed under CC BY 4.0"),
]


def brute(files, texts, least):
    words = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    n = len(files)
    df = Counter(t for _, _, x in files for t in set(words(x)))
    vocabulary = {t for x in texts.values() for t in words(x)}
    idf = lambda t: math.log((n + 1) / ((df[t] if t in vocabulary else 0) + 1)) + 1
    own = []
    for _, _, text in files:
        best = []
        for line in (text or "").split("\n"):
            a = Counter(words(line))
            for name, template in texts.items():
                b = Counter(words(template))
                size = math.sqrt(sum((c * idf(t)) ** 2 if t in vocabulary else c * idf(t) ** 2 for t, c in a.items()))
                size *= math.sqrt(sum((c * idf(t)) ** 2 for t, c in b.items()))
                score = round(sum(c * b[t] * idf(t) ** 2 for t, c in a.items()) / size, 6) if size else 0
                if score >= least:
                    best.append((-score, name))
        own.append(min(best, default=(None, None)))
    granted = {}
    for (_, path, _), (minus, name) in zip(files, own, strict=True):
        if path and name and re.match(LICENCE_FILE, path.rsplit("/", 1)[-1]):
            folder = path.rpartition("/")[0]
            granted[folder] = min(granted.get(folder, (0, "~", "")), (minus, name, path))
    out = []
    for (doc_id, path, _), (minus, name) in zip(files, own, strict=True):
        folder, near = path.rpartition("/")[0] if path else None, None
        while near is None and folder is not None:
            if folder in granted:
                near = folder
            folder = None if folder == "" else folder.rpartition("/")[0]
        inherited = granted[near][1] if near is not None else None
        out.append((doc_id, path, name, -minus if minus else None, name or inherited, near if name is None else None))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    files = spark.createDataFrame([(*f, "clash") for f in FILES], "doc_id long, path string, text string, license string")
    got = sorted((tuple(r) for r in scan(files).collect()), key=str)
    assert got == brute(FILES, TEMPLATES, 0.8)
    by_id = {g[0]: g for g in got}
    assert by_id[3][4:] == ("GPL-3.0", "repo/src") == by_id[5][4:]
    assert by_id[2][2] == "Apache-2.0" and by_id[10][4] is None
    assert scan(files.limit(0)).count() == 0


def test_lines_without_a_heavy_word_stay_below_the_threshold(spark):
    texts = spark.createDataFrame([(f[2],) for f in FILES], "text string")
    templates = Templates()
    weight, _ = term_weights(texts, templates)
    heavy = set(heavy_terms(templates, weight))
    for counts in templates.counts().values():
        whole = sum((c * weight[t]) ** 2 for t, c in counts.items())
        light = sum((c * weight[t]) ** 2 for t, c in counts.items() if t not in heavy)
        assert math.sqrt(light / whole) < templates.least


def test_tree_of_documents(spark):
    docs = spark.createDataFrame([(1000, "a", "en", "x"), (1100, "a", "en", "x"), (1110, "a", None, "x"), (1111, "a", "en", "x"), (None, None, "en", "x")], "doc_id long, source string, lang string, text string")
    assert [r.path for r in as_files(docs).orderBy("doc_id").collect()] == ["none/en/none/doc.none", "a/LICENSE.1000", "a/en/LICENSE.1100", "a/none/11/LICENSE.1110", "a/en/11/doc.1111"]


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish"""
BSD = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED"""
THIRD = """Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""


def test_notices_over_lines_within_lines_and_licence_texts(spark):
    wanted = [
        ("GPL-3.0", "# This work is licensed under the GNU\n# General Public License, version 3.\ncode()"),
        ("GPL-3.0", "        GNU GENERAL PUBLIC LICENSE\n           Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation"),
        ("MIT", MIT),
        ("MIT", MIT.split("\n", 3)[3]),
        ("MIT", "MIT License"),
        ("MIT", "After many words about other things. Released under the MIT License. And then there are more words."),
        ("BSD-2-Clause", BSD.format("")),
        ("BSD-3-Clause", BSD.format(THIRD)),
        ("BSD-3-Clause", "// Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
        ("Apache-2.0", "/* Licensed under the Apache\n * License, Version 2.0 (the License);\n */"),
        (None, "They met in a bar, mit freunden, and apache version of the work was released."),
    ]
    filler = [(1000 + k, f"x/{k}", "the words of a text in this work, which is licensed by no one or for a version of it") for k in range(300)]
    files = spark.createDataFrame([*((k, f"d{k}/f", t) for k, (_, t) in enumerate(wanted)), *filler], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in scan(files).collect()}
    assert [got[k] for k in range(len(wanted))] == [w for w, _ in wanted]
    assert {got[f[0]] for f in filler} == {None}


def test_ordinary_words_weigh_by_their_own_frequency(spark):
    text = "Released and also under the MIT License."
    rows = [(1, "a/f", text), *((10 + k, "b/f", "and also so on") for k in range(300))]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    templates = Templates(texts={"MIT": TEMPLATES["MIT"]}, passages=(), titles=())
    n = len(rows)
    idf = lambda df: math.log((n + 1) / (df + 1)) + 1
    score = math.sqrt(5 * idf(1) ** 2 / (5 * idf(1) ** 2 + 2 * idf(n) ** 2))
    found = [r for r in scan(files, templates).collect() if r.own_license]
    assert [(r.doc_id, r.own_license, r.own_score) for r in found] == [(1, "MIT", round(score, 6))]
