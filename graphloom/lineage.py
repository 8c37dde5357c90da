"""Cutting lineage through storage that every executor shares.

An executor can be lost at any moment, so nothing here relies on blocks that
live on one machine: state goes to the folder named by ``spark.checkpoint.dir``.
Only a local session without that setting (as in unit tests) gets a scratch folder.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint root of the session; on a cluster it must be set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint: same rows in the same partitions, no history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back (columnar, splittable, of known size)."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_path` once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def tidy(spark: SparkSession) -> None:
    """Let go of what finished jobs left in the driver: plans that Python still names, broadcasts, shuffles; its heap shrinks back.

    Spark drops a broadcast or a shuffle when the driver's collector finds that nothing refers to it, which may be
    long after the job. For operators of many jobs, between their steps; nothing that is in use goes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Rounds:
    """State that is replaced again and again: each round's table stands until the next one is complete.

    As a context manager it also deletes the last table where the block fails.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: list[str] = []

    def store(self, df: DataFrame, *numbers: Column) -> tuple[DataFrame, dict]:
        """``df`` in shared storage, and numbers (named aggregates) observed while it is written: one job."""
        path, seen = new_path(self.spark, self.name), Observation()
        state = written(df.observe(seen, *numbers) if numbers else df, self.name, path)
        found = seen.get if numbers else {}
        for old in self.paths:
            release(self.spark, old)
        self.paths = [path]
        return state, found

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            for path in self.paths:
                release(self.spark, path)


@contextmanager
def stored_edges(graph) -> Iterator[DataFrame]:
    """A graph's edges, derived once and kept in shared storage for a block."""
    spark, path = graph.edges.sparkSession, new_path(graph.edges.sparkSession, "edges")
    try:
        yield written(graph.edges, "edges", path)
    finally:
        release(spark, path)
