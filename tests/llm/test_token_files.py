from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from agora.llm.token_files import Reader, WordEncoder, read_back, write
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH, remember=50)


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="aΣσ \n\t\x0b\x1c\x85\xa0　'sİ́<|endoftext|>9É", max_size=80)), max_size=4))
def test_words_encode_as_the_whole_text(encoder, theirs, texts):
    got = [np.frombuffer(p, encoder.kind).tolist() for p in encoder.encode(pa.array(texts, pa.string()))]
    assert got == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark, theirs, tmp_path):
    rows = [(k * 37 % 101, f"Document {k} says " + "hello world " * (k % 13)) for k in range(101)]
    rows += [(500, None), (501, ""), (502, "long words " * 9000), (50, "repeated id"), (50, "repeated id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, offset string")
    folder = f"file:{tmp_path}/tokens"
    index = write(docs, PATH, folder, files=3, length=32, rows=4)
    got = sorted(read_back(index, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start, bag = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        bag.append((str(r.doc_id), r.n_tokens, r.ids_crc32))
    wanted = []
    for doc_id, text in rows:
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.append((str(doc_id), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(bag) == sorted(wanted)
    stored = []
    for k in sorted({r.file for r in index.collect()}):
        reader = Reader(f"{folder}/tokens-{k:06d}.arrow")
        total = sum(r.n_tokens for r in index.where(f"file = {k}").collect())
        for row in range(-(-total // 32)):
            ids, mask = reader.sequence(row)
            assert len(ids) == len(mask) == 32 and not ids[~mask].any()
            assert not ids.flags.owndata
            stored += ids[mask].tolist()
    assert len(stored) == start
    with pytest.raises(Exception):
        list(reader.run(total + 10_000, 5))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = write(docs, PATH, str(tmp_path / "none"), files=2)
    assert read_back(index, str(tmp_path / "none")).count() == 0
