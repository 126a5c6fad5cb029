from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from corpus_pipeline import ORACLE_SQL, STAGES, run
from tokenizers import Tokenizer
import public_tokenizers

from agora.llm import simhash, toxicity
from agora.llm.common import materialize, table
from tests.llm.test_secret_scan import brute as base_secrets
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    # Repeated rows, nulls and an extra column go through every stage.
    extra = docs.limit(3).unionAll(docs.limit(1).selectExpr("cast(null as long)", "cast(null as string)", "lang", "cast(null as string)", "n_chars"))
    docs = materialize(docs.unionAll(extra).selectExpr("*", "'kept' as row"), "input")
    out.append(docs)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_all_but_the_last_keep_the_columns(steps):
    assert ORACLE_SQL is None and len(STAGES) == 5
    for df in steps[1:-1]:
        assert [f.name for f in df.schema] == [f.name for f in steps[0].schema]
        assert df.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark, steps):
    model = toxicity.fit(steps[0], table(spark, SF, "labels"))
    own = toxicity.Matcher(model)
    wanted = collections.Counter(map(str, (r for r in steps[0].collect() if own.score(r.text or "") < 0.3)))
    assert collections.Counter(map(str, steps[1].collect())) == wanted


def test_one_document_of_each_component_stays(steps):
    rows = steps[1].collect()
    label = brute_components([simhash.fingerprint((r.text or "").encode(), 3) % (1 << 64) for r in rows], 3)
    groups = collections.defaultdict(list)
    for r, k in zip(rows, label, strict=True):
        groups[k].append(r)
    wanted = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    assert sorted(map(str, steps[2].collect())) == sorted(map(str, wanted))


def test_secrets_are_gone_and_nothing_else(steps):
    after = steps[3].collect()
    assert len(after) == steps[2].count()
    assert not any(base_secrets(r.text) for r in after)
    before = {r.doc_id: r.text for r in steps[2].collect()}
    for r in after:
        if not base_secrets(before[r.doc_id]) and "[SECRET]" not in (r.text or ""):
            assert r.text == before[r.doc_id]


def test_tokens_of_every_copy(steps):
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for r in steps[4].collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        wanted.append((str(r.doc_id), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = [(str(r.doc_id), list(r.ids), r.ids_sha256) for r in steps[5].collect()]
    assert sorted(got) == sorted(wanted)


def test_run_over_an_empty_table(spark, tmp_path):
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert run(spark, str(tmp_path)).count() == 0
