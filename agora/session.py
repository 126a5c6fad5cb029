"""Session construction and the shared folder used to cut lineage.

The library never changes settings of a session it is handed; these
defaults apply only to sessions it builds itself (tests, bench, CLI).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are designed around. AQE re-plans joins from
# runtime sizes (dimension sides become broadcasts once their exact size
# is known), splits skewed shuffle partitions and coalesces small ones.
SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "agora",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``. Only a local-mode session
    (tests) without one gets a private temporary folder; on a cluster a
    machine-local folder would not be shared by the executors, so an unset
    setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: point it at a folder every executor can reach"
            )
        configured = tempfile.mkdtemp(prefix="agora-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: The folder of the run in progress, below the shared one.
_RUN: ContextVar[str] = ContextVar("agora_run", default="")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name of the run in progress."""
    return f"{checkpoint_dir(spark)}/written/{_RUN.get()}{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a relation as parquet to a new folder under the shared one and
    read it back: later uses prune columns, the planner knows its size, and
    a lost executor re-reads files instead of replaying the work."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.delete(path, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[None]:
    """What ``written`` writes inside this block is removed at its end, when
    the results that read it have been written; other runs of the session,
    also concurrent ones, keep theirs. Blocks may be nested."""
    mine = f"{_RUN.get()}run-{uuid.uuid4().hex}/"
    token = _RUN.set(mine)
    try:
        yield
    finally:
        _RUN.reset(token)
        _remove(spark, f"{checkpoint_dir(spark)}/written/{mine}")


def drop_written(spark: SparkSession) -> bool:
    """Remove everything ``written`` has put into the session's shared
    folder outside of a ``run_folder``, and the latter's too: for the end of
    a session."""
    return _remove(spark, f"{checkpoint_dir(spark)}/written")
