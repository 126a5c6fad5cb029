"""Byte-level BPE as a bounded-lookahead streaming transducer, and back.

Merging by rank looks at a whole pre-token, but what follows a position can
only change the tokens before it through a chain of conflicting merges of
falling rank. ``sufficient_lookahead`` computes from the merge list how many
bytes such a chain can span. The encoder therefore merges a sliding window
and emits every token that ends at least that far before the window's end:
it is stable, whatever comes next, and what follows a token boundary merges
independently of what precedes it. Memory does not grow with the pre-token.

Decoding feeds the tokens' bytes, block by block, through an incremental
UTF-8 state machine that keeps incomplete sequences between blocks.

Documents are independent: one pass over the table, no shuffle.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from agora.llm.common import bounded_slices, map_arrow
from agora.llm.merging import PairMerges, packed

#: The byte-level pre-token pattern and Unicode white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A pre-token never reaches over the start of a chunk, so chunks of this
#: pattern can be encoded (and remembered) one by one.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable
    Latin-1 characters stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeList:
    """Vocabulary and ranked merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        of = byte_alphabet()
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of = [b""] * self.size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(of[c] for c in token)
        for token, k in self.added.items():
            self.bytes_of[k] = token.encode()
        self.first = [0] * 256
        for char, b in of.items():
            self.first[b] = vocab[char]
        self.pairs = [(vocab[a], vocab[b]) for a, b in spec["model"]["merges"]]
        #: a * size + b -> rank * size + merged: the smallest is the next merge
        self.merges = {
            a * self.size + b: rank * self.size + vocab["".join(spec["model"]["merges"][rank])]
            for rank, (a, b) in enumerate(self.pairs)
        }


def sufficient_lookahead(merges: MergeList) -> int:
    """Bytes after a token boundary that decide whether it is final.

    A merge (a, b) can be prevented by an earlier-ranked merge (x, y) whose x
    is a token that arises inside a or b while they form and whose y reaches
    on to the right; that merge can in turn be prevented from its right end.
    Ranks fall along such a chain, so one pass in rank order suffices.
    ``reach[x]``: bytes right of x's end that decide all merges (x, .) so far.
    """
    reach: dict[int, int] = {}
    nodes: dict[int, list[tuple[int, int]]] = {}

    def inside(token: int) -> list[tuple[int, int]]:
        """Tokens that arise while ``token`` forms, and their end's distance from its end."""
        return nodes.get(token, [(token, 0)])

    size = merges.size
    for rank, (a, b) in enumerate(merges.pairs):
        width = len(merges.bytes_of[b])
        parts = [(x, d + width) for x, d in inside(a)] + inside(b)
        need = max((reach[x] - d for x, d in parts if x in reach), default=0)
        reach[a] = max(reach.get(a, 0), width + max(0, need))
        merged = merges.merges[a * size + b] % size
        nodes.setdefault(merged, []).extend([*parts, (merged, 0)])
    return max(reach.values(), default=0)


#: Chunks that are one pre-token: composed Latin letters.
LETTERS = re.compile(" ?(?:[A-Za-z]+|[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)").fullmatch


class Transducer:
    """Streaming encoder of one merge list. ``window``: bytes merged at a time
    beyond the lookahead; ``remember``: pre-tokens and chunks in the memo,
    none longer than ``LONGEST``, before it starts anew from those in use.
    Short pre-tokens that it lacks are merged together, in array rounds."""

    LONGEST = 64

    def __init__(self, path: str, window: int = 2048, remember: int = 100_000) -> None:
        self.merges = MergeList(path)
        self.lookahead = sufficient_lookahead(self.merges)
        self.none = len(self.merges.merges) * self.merges.size + self.merges.size
        self.window = window + self.lookahead + max(map(len, self.merges.bytes_of))
        self.pre_token = regex.compile(PRE_TOKEN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.added = re.compile("|".join(map(re.escape, self.merges.added)) or "(?!)")
        self.added_ids = {token: np.array([k], "<u4").tobytes() for token, k in self.merges.added.items()}
        size = self.merges.size
        self.rounds = PairMerges(self.merges.pairs, [self.merges.merges[a * size + b] % size for a, b in self.merges.pairs], size)
        self.symbol = np.array(self.merges.first, np.int64)
        self.token_bytes = pa.array(self.merges.bytes_of, pa.large_binary())
        self.remember = remember
        self.known: dict[str, bytes] = dict(self.added_ids)

    def merge(self, data: bytes) -> list[int]:
        """All merges of ``data``, lowest rank first, leftmost first."""
        first = self.merges.first
        ids = [first[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        size, get, none = self.merges.size, self.merges.merges.get, self.none
        ranks = [get(a * size + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        ranks.append(none)
        while (best := min(ranks)) != none:
            k = ranks.index(best)
            merged = ids[k] = best % size
            del ranks[k], ids[k + 1]
            if k:
                ranks[k - 1] = get(ids[k - 1] * size + merged, none)
            if k + 1 < len(ids):
                ranks[k] = get(merged * size + ids[k + 1], none)
            else:
                ranks[k:] = [none]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        size, table, n = self.merges.size, self.merges.merges, len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m, k) for k in range(n - 1) if (m := table.get(ids[k] * size + ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            m, k = heapq.heappop(queue)
            right = after[k]
            if ids[k] < 0 or right >= n or table.get(ids[k] * size + ids[right]) != m:
                continue
            ids[k], ids[right] = m % size, -1
            after[k] = after[right]
            if after[k] < n:
                prior[after[k]] = k
                if (m := table.get(ids[k] * size + ids[after[k]])) is not None:
                    heapq.heappush(queue, (m, k))
            if prior[k] >= 0 and (m := table.get(ids[prior[k]] * size + ids[k])) is not None:
                heapq.heappush(queue, (m, prior[k]))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one pre-token, each emitted once it is stable."""
        at, sizes = 0, self.merges.bytes_of
        while len(data) - at > self.window:
            end, stable = 0, self.window - self.lookahead
            for token in self.merge(data[at : at + self.window]):
                if end + len(sizes[token]) > stable:
                    break
                end += len(sizes[token])
                yield token
            at += end
        yield from self.merge(data[at:])

    def _word(self, word: str) -> bytes:
        data = word.encode()
        ids = self.merge(data) if len(data) <= self.window else list(self.stream(data))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pre_tokens(self, chunk: str) -> list[str]:
        """The pattern's matches. Which characters are letters and numbers
        differs between editions of Unicode, so beyond Latin the library that
        the ids must equal decides."""
        if max(chunk) < "\u0250":
            return self.pre_token.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenize_str(chunk)]

    def _learn(self, chunks: set[str]) -> list[str]:
        """Puts the ids of new ``chunks`` and of their pre-tokens into the
        memo; returns those that are too long to stay there."""
        known = self.known
        words = set(filter(LETTERS, chunks))
        several = {c: self._pre_tokens(c) for c in chunks.difference(words)}
        words.update(*several.values())
        words.difference_update(known)
        data = {w: w.encode() for w in words}
        long = [w for w, x in data.items() if len(x) > self.LONGEST]
        for w in long:
            del data[w]
            known[w] = self._word(w)
        joined = np.frombuffer(b"".join(data.values()), np.uint8)
        ids, counts = self.rounds.merge(self.symbol[joined], np.fromiter(map(len, data.values()), np.int64, len(data)))
        known.update(zip(data, packed(ids, counts, np.dtype("<u4")), strict=True))
        for c, parts in several.items():
            if c not in known:
                known[c] = b"".join([known[w] for w in parts])
        return long + [c for c in several if len(c) > self.LONGEST and c not in self.added_ids]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        chunks = []
        for text in texts:
            mine, at = [], 0
            for m in self.added.finditer(text):
                mine += CHUNK.findall(text[at : m.start()])
                mine.append(m.group())
                at = m.end()
            chunks.append(mine + CHUNK.findall(text[at:]) if at else CHUNK.findall(text))
        wanted = set().union(*chunks)
        known = self.known
        long = self._learn(wanted.difference(known))
        out = [b"".join(map(known.__getitem__, mine)) for mine in chunks]
        for c in set(long):
            del known[c]
        if len(known) > self.remember:
            wanted.difference_update(long)
            self.known = {c: known[c] for c in wanted} | self.added_ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one after the other."""
        found = self.token_bytes.take(pa.array(ids))
        return found.buffers()[2].to_pybytes() if found.buffers()[2] is not None else b""

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> Iterator[str]:
        """The text of ``ids`` in pieces; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), block):
            yield machine.decode(self.bytes_of(ids[at : at + block]))
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """The encoder of a file, built once in each Python worker."""
    return Transducer(path)


#: Bytes of text encoded at a time; a slice's pieces are held as Python strings.
SLICE = 2 << 20

ENCODED = "doc_id long, ids array<int>, n_tokens long"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of each row's whole text (null: empty): doc_id, ids, n_tokens."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for part in bounded_slices(batches, "text", SLICE):
            encoded = own.encode_all(part.column("text").fill_null("").to_pylist())
            sizes = np.array([len(x) // 4 for x in encoded], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(offsets, ids), pa.array(sizes)], schema=out
            )

    return map_arrow(_inputs(docs), run, ENCODED)


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes each row's whole text: token count and SHA-256 of
    the ids (little-endian unsigned 32-bit) and of the decoded UTF-8 text;
    ``keep_ids`` adds the ids.

    Null text counts as empty (0 tokens); a null doc_id stays null; repeated
    rows each give a row; other columns are ignored; empty in, empty out.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    ids_type = pa.list_(pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for part in bounded_slices(batches, "text", SLICE):
            counts, ids_hash, text_hash, kept = [], [], [], []
            for mine in own.encode_all(part.column("text").fill_null("").to_pylist()):
                decoded = hashlib.sha256()
                for piece in own.decode(np.frombuffer(mine, "<u4")):
                    decoded.update(piece.encode())
                counts.append(len(mine) // 4)
                if keep_ids:
                    kept.append(np.frombuffer(mine, "<i4"))
                ids_hash.append(hashlib.sha256(mine).hexdigest())
                text_hash.append(decoded.hexdigest())
            rows = pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], schema=out
            )
            yield rows.append_column("ids", pa.array(kept, ids_type)) if keep_ids else rows

    return map_arrow(_inputs(docs), run, DIGEST + ", ids array<int>" * keep_ids)


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
