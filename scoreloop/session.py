"""Session settings and shared scratch locations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

# Semantics the library relies on. Sizing is left to the cluster, but for one thing: shuffles
# begin with many partitions, which AQE merges up to its advisory size. With few, what a task
# sorts would grow with the input.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Spark's own setting: shuffle files go when the execution that wrote them ends, not when the driver
# happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_DIRS: dict[str, str] = {}
_INSIDE: list[int] = []
_INSIDE_LOCK, _BEFORE = Lock(), ["false"]


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder, because
    there the driver and the executors share one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_DIRS[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files. Several threads may be inside: the last one out restores the setting."""
    with _INSIDE_LOCK:
        if not _INSIDE:
            _BEFORE[:] = [spark.conf.get(CLEANUP, "false")]
            spark.conf.set(CLEANUP, "true")
        _INSIDE.append(1)
    try:
        yield
    finally:
        with _INSIDE_LOCK:
            _INSIDE.pop()
            if not _INSIDE:
                spark.conf.set(CLEANUP, _BEFORE[0])


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder (or ``path``) and read it back.

    Cuts the lineage: what is read several times is worked out once, and a lost executor
    later costs a re-read, not a recomputation. The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, label)
    with shuffle_files_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
