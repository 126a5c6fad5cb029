"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from pathlib import Path
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from agora.session import checkpoint_dir, written

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/written/{name}-{uuid.uuid4().hex}"


#: Writes a relation to the shared folder and reads it back.
materialize = written


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package where the driver
    found it. On a cluster it is installed or shipped with --py-files; this
    covers a checkout that is on the driver's path only."""
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        # Workers serve later tasks too: give back what this one held.
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def bounded_slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each
    slice (one value at least), which bounds a task's working memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for text k the range
    ``bounds[k]:bounds[k + 1]`` of its words (null texts have none)."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    at = np.concatenate([[0], np.cumsum(lengths)])
    return words.filter(pa.array(real)), before[at]
