"""Shared storage for intermediate tables.

Everything written here goes to the folder the cluster names in
``spark.checkpoint.dir``, so a lost executor never takes the data with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_RECORDED: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor must reach."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"start the session with {CHECKPOINT_KEY} set to a folder every executor can reach")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/geoscore/{name}-{uuid.uuid4().hex}"
    recorded = _RECORDED.get()
    if recorded is not None:
        recorded.append(path)
    return path


def enable_checkpoints(spark: SparkSession) -> None:
    """Give iterative learners a reliable folder to cut their lineage in."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def store(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The stored table keeps column pruning, filter pushdown and, with
    ``partition_by``, partition pruning for every later pass.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths handed out inside, for :func:`drop`."""
    paths: list[str] = []
    token = _RECORDED.set(paths)
    try:
        yield paths
    finally:
        _RECORDED.reset(token)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes stored tables; frames that read them can't be used any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
