"""Versioned folders: a table, or a set of tables, replaced all or nothing.

Under ``base`` every write goes to a new folder ``v-<number>``. When it is
complete an empty file ``_published/<number>`` appears; creating it is one
step on every file system, and readers open the greatest published number.
A write that fails leaves a folder that no reader opens and that the next
successful write removes. One writer at a time.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

PUBLISHED = "_published"
PREFIX = "v-"


class NothingPublished(FileNotFoundError):
    """No complete version under a folder."""


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder and all in it."""
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def _published(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n) for n in children(spark, f"{base}/{PUBLISHED}") if n.isdigit())


def _versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n.removeprefix(PREFIX)) for n in children(spark, base) if n.startswith(PREFIX))


def folder(base: str, version: int) -> str:
    return f"{base}/{PREFIX}{version:012d}"


def new_version(spark: SparkSession, base: str) -> int:
    """A number above all earlier ones, unfinished writes included."""
    return max([0, *_published(spark, base), *_versions(spark, base)]) + 1


def current_version(spark: SparkSession, base: str) -> int:
    found = _published(spark, base)
    if not found:
        raise NothingPublished(f"no complete version under {base}")
    return found[-1]


def current(spark: SparkSession, base: str) -> str:
    """The folder that readers open."""
    return folder(base, current_version(spark, base))


def publish(spark: SparkSession, base: str, version: int, keep: int = 1) -> str:
    """Make a complete version the current one, then remove the others but
    for the ``keep`` versions published before it (jobs that opened one of
    those still read it) and the remains of failed writes."""
    fs, at = _fs(spark, f"{base}/{PUBLISHED}/{version:012d}")
    fs.create(at, False).close()
    kept = {v for v in _published(spark, base) if v <= version}
    kept = set(sorted(kept)[-(keep + 1) :])
    for old in _published(spark, base):
        if old < version and old not in kept:
            remove(spark, f"{base}/{PUBLISHED}/{old:012d}")
    for old in _versions(spark, base):
        if old < version and old not in kept:
            remove(spark, folder(base, old))
    return folder(base, version)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file beside the data (a layout, never rows)."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
