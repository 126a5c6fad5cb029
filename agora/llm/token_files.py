"""Token ids in Arrow IPC files of equal-length sequences.

Documents are range-partitioned by id; each partition's ids run on, document
after document, through the rows of one file: ``ids`` and ``mask`` are
fixed-size lists of ``length`` values, so row k is at a computable place and
is read without copying (memory-mapped where the file is local). The last
row is padded with 0, its mask tells how far it counts. An index table has
each document's file, place and size.

A task writes its file under a name of its own attempt and then moves it to
its final name, so a repeated task replaces a file by an equal one.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from agora.llm.bpe import byte_alphabet
from agora.llm.common import bounded_slices, map_arrow, materialize, shared_folder, split_words
from agora.llm.merging import PairMerges


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a Spark-style URI."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


#: Words of which letters and signs can be encoded apart: Latin-1 letters
#: (composed, of one code point in either case), then ASCII signs.
PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{de}\x{e0}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[!-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Encodes with a tokenizers file, slice by slice. The file must drop
    white space, lower-case, and never join letters with signs (as the
    word-level BPE does), so that a text's ids are its pieces' ids in order:
    the words between ASCII white space and, of plain words, their
    lower-cased letters and the signs behind them. A slice's distinct words
    are looked at once. The letters of plain words are merged together by the
    file's merge list; everything else goes through the library and is
    remembered, ``remember`` pieces of up to ``LONGEST`` bytes at most."""

    LONGEST = 64

    def __init__(self, path: str, remember: int = 100_000) -> None:
        # Spark runs a worker on each core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [(vocab[x], vocab[y]) for x, y in model["merges"]]
        merged = [vocab[x + y] for x, y in model["merges"]]
        self.rounds = PairMerges(pairs, merged, self.size)
        of = byte_alphabet()
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for char, byte in of.items():
            self.inner[byte], self.last[byte] = vocab[char], vocab[char + end]
        self.remember = remember
        self.known: dict[str, np.ndarray] = {}

    def _library(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and their numbers."""
        found = []
        for piece in pieces.to_pylist():
            ids = self.known.get(piece)
            if ids is None:
                ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.int64)
                if len(piece) <= self.LONGEST:
                    self.known[piece] = ids
            found.append(ids)
        if len(self.known) > self.remember:
            self.known = {}
        return np.concatenate([*found, np.empty(0, np.int64)]), np.array([len(x) for x in found], np.int64)

    def _merged(self, letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of lower-case letters (one pre-token each)."""
        if not len(letters):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.frombuffer(letters.buffers()[1], np.int32, len(letters) + 1, 4 * letters.offset)
        lengths, joined = np.diff(at).astype(np.int64), np.frombuffer(letters.buffers()[2], np.uint8)[at[0] : at[-1]]
        symbols, ends = self.inner[joined], np.cumsum(lengths) - 1
        symbols[ends] = self.last[joined[ends]]
        return self.rounds.merge(symbols, lengths)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids (``kind``) of each text (no nulls)."""
        words, bounds = split_words(texts)
        coded = words.dictionary_encode()
        distinct, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        short = pc.less_equal(pc.binary_length(distinct), self.LONGEST)
        parts = pc.extract_regex(pc.if_else(short, distinct, ""), PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(parts.field("letters").filter(pa.array(plain))).dictionary_encode()
        signs = parts.field("signs").filter(pa.array(plain)).dictionary_encode()
        # Piece 0 is empty; the letters', the signs' and the other words' pieces follow.
        found = [self._merged(letters.dictionary), self._library(signs.dictionary), self._library(distinct.filter(pa.array(~plain)))]
        pool = np.concatenate([x for x, _ in found]).astype(self.kind)
        size = np.concatenate([[0], *[n for _, n in found]])
        start = np.cumsum(size) - size
        first, second = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        first[plain] = 1 + letters.indices.to_numpy(zero_copy_only=False)
        second[plain] = 1 + len(letters.dictionary) + signs.indices.to_numpy(zero_copy_only=False)
        first[~plain] = 1 + len(letters.dictionary) + len(signs.dictionary) + np.arange((~plain).sum())
        pieces = np.stack([first[place], second[place]], axis=1).ravel() if len(place) else np.empty(0, np.int64)
        many = size[pieces]
        ends = np.cumsum(many)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[pieces] - (ends - many), many)]
        at = np.concatenate([[0], ends])[2 * bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Writer:
    """Appends ids to one file of sequences."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int) -> None:
        self.length, self.rows = length, rows
        self.kind = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.size, self.dtype = [], 0, kind

    def add(self, packed: bytes) -> None:
        self.held.append(packed)
        self.size += len(packed) // self.dtype.itemsize
        if self.size >= self.length * self.rows:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        block = self.length * self.rows
        stop = len(ids) if end else len(ids) // block * block
        for at in range(0, stop, block):
            part = ids[at : min(at + block, stop)]
            full = -(-len(part) // self.length) * self.length
            mask = np.arange(full) < len(part)
            values = np.concatenate([part, np.zeros(full - len(part), self.dtype)])
            self.out.write_batch(
                pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, mask)], schema=self.schema
                )
            )
        self.held, self.size = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class Reader:
    """Random access to one file of sequences."""

    def __init__(self, uri: str) -> None:
        store, path = filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    @lru_cache(maxsize=4)  # noqa: B019
    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.file.get_batch(k)
        return batch.column("ids").values.to_numpy(zero_copy_only=True), batch.column("mask").values

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one row; the ids are a view of the file."""
        ids, mask = self._batch(row // self.rows)
        at = row % self.rows * self.length
        return ids[at : at + self.length], mask.slice(at, self.length).to_numpy(zero_copy_only=False)

    def run(self, start: int, size: int) -> Iterator[np.ndarray]:
        """Views of ``size`` ids from place ``start`` on."""
        block = self.rows * self.length
        while size > 0:
            ids, _ = self._batch(start // block)
            part = ids[start % block : start % block + size]
            if not len(part):
                raise EOFError("the file ends before the run does")
            yield part
            start, size = start + len(part), size - len(part)


INDEX = "file long, offset long, doc_id long, n_tokens long"


def write(
    docs: DataFrame,
    path: str,
    folder: str,
    files: int | None = None,
    end_id: int = 1,
    length: int = 2048,
    rows: int = 64,
) -> DataFrame:
    """Encodes each row of ``docs`` (doc_id, text; null: empty), appends
    ``end_id`` and writes the ids in ascending order of doc_id (nulls first;
    equal ids by text hash) to files ``folder/tokens-<number>.arrow``.
    ``files``: their number, by default the session's shuffle partitions.

    Returns the index, a written table: file, offset (ids before the
    document in its file), doc_id, n_tokens. Repeated rows are written each;
    other columns are ignored; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    order = ["doc_id", "tie"]
    ranged = (
        slim.withColumn("tie", F.xxhash64("text")).repartitionByRange(count, *order).sortWithinPartitions(*order)
    )
    out = pa.schema([(n, pa.int64()) for n in ("file", "offset", "doc_id", "n_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        store.create_dir(place)
        task, writer, offset = TaskContext.get(), None, 0
        number = task.partitionId()
        temporary = f"{place}/_attempt-{number:06d}-{task.taskAttemptId()}"
        encoder = word_encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        for part in bounded_slices(batches, "text"):
            if writer is None:
                sink = store.open_output_stream(temporary)
                writer = Writer(sink, encoder.kind, length, rows)
            sizes = []
            for mine in encoder.encode(part.column("text").fill_null("")):
                writer.add(mine + end)
                sizes.append(len(mine) // encoder.kind.itemsize + 1)
            ends = offset + np.cumsum(sizes)
            starts = np.concatenate([[offset], ends[:-1]])
            offset = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), number)), pa.array(starts), part.column("doc_id"), pa.array(sizes, pa.int64())], schema=out
            )
        if writer is not None:
            writer.close()
            sink.close()
            store.move(temporary, f"{place}/tokens-{number:06d}.arrow")

    return materialize(map_arrow(ranged, run, INDEX), "index")


def read_back(index: DataFrame, folder: str, digest: Callable[[Iterator[np.ndarray]], int] | None = None) -> DataFrame:
    """Reads every document's ids from the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers, or another ``digest`` of their pieces)."""
    def crc(pieces: Iterator[np.ndarray]) -> int:
        value = 0
        for piece in pieces:
            value = zlib.crc32(piece.astype("<u4").tobytes(), value)
        return value

    value = digest or crc
    # One row per file: the windows' input is bounded by the number of files.
    sizes = index.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))
    placed = index.join(F.broadcast(before), "file")
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, reader = None, None
        for part in batches:
            if not part.num_rows:
                continue
            found = []
            for file, offset, size in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "n_tokens")), strict=True):
                if file != number:
                    number, reader = file, Reader(f"{folder}/tokens-{file:06d}.arrow")
                found.append(value(reader.run(offset, size)))
            start = pc.add(part.column("offset"), part.column("before"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), start, part.column("n_tokens"), pa.array(found, pa.int64())], schema=out)

    return map_arrow(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, **options) -> DataFrame:
    """``write`` to a new folder under the shared one, then ``read_back``."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_back(write(docs, path, folder, **options), folder)
