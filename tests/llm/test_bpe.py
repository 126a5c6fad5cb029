from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from agora.llm.bpe import Transducer, encode, round_trip
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return Transducer(PATH, window=1)


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def same(own, theirs, text):
    ids = np.frombuffer(own.encode(text), "<u4")
    wanted = theirs.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == wanted
    assert "".join(own.decode(ids, block=3)) == theirs.decode(wanted, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text(alphabet="aetsin 's\n\t\x1c\x85　é1", max_size=300)))
def test_equals_the_library(own, theirs, text):
    same(own, theirs, text)


def test_long_runs_are_stable_in_a_small_window(own, theirs):
    rng = random.Random(5)
    pieces = [b.decode() for b in own.merges.bytes_of if b.isascii() and b.isalpha()]
    for size in (200, 900):
        same(own, theirs, "".join(rng.choice(pieces) for _ in range(size)))
    same(own, theirs, "a" * 20_000)
    same(own, theirs, "<|endoftext|>a<|endoftext|><|endoftext|> <|endoftext")


def test_characters_between_letters_numbers_and_signs(own, theirs):
    """The library's classes of characters, on a spread of all code points."""
    for start in range(0x80, 0x30000, 0x4000):
        chars = [chr(c) for c in range(start, min(start + 0x4000, 0x30000), 5) if not 0xD800 <= c < 0xE000]
        for text in ("".join(f"a{c}1 {c}b" for c in chars), "".join(f"{c}'s! {c}{c}\n" for c in chars)):
            same(own, theirs, text)


def test_memo_stays_bounded(theirs):
    small = Transducer(PATH, remember=50)
    for k in range(20):
        text = " ".join(f"w{k}x{j} caf\u00e9{j}" for j in range(30)) + "<|endoftext|>" + "z" * 200
        same(small, theirs, text)
        assert len(small.known) <= 50 + 200 and max(map(len, small.known)) <= small.LONGEST


def test_decoder_keeps_incomplete_sequences(own, theirs):
    ids = [own.merges.first[b] for b in b"\xe4\xb8\xe4\xb8\xad\xff\xf0\x9f\x98"]
    assert "".join(own.decode(np.array(ids, "<u4"), block=1)) == theirs.decode(ids, skip_special_tokens=False)


def test_rows_of_every_kind(spark, theirs):
    rows = [(1, "Hello there", 0), (1, "Hello there", 0), (2, None, 0), (None, "", 0), (3, "x y " * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    wanted = []
    for doc_id, text, _ in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, round_trip(docs, PATH).collect()))) == sorted(map(str, wanted))
    assert sorted(r.n_tokens for r in encode(docs, PATH).collect()) == sorted(w[1] for w in wanted)
    assert round_trip(docs.limit(0), PATH).count() == 0
