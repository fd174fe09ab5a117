"""Intermediate tables of the operators, in the shared folder that the session
names (``spark.checkpoint.dir``)."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Within it, shuffle files go as soon as the job that wrote them ends;
    what later jobs need is in written tables."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


_BATCH, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in batches of 4 MB, so that a
    worker's memory does not grow with the texts of 10,000 rows; a size that the
    session has set itself stays."""
    if spark.conf.get(_BATCH).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH, _BATCH_BYTES)


def give_back() -> None:
    """Return a Python worker's unused memory to the system (called at the end of
    a task; workers live on between tasks)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """``run`` over the batches of a task, with its memory given back at the end."""
    def inner(batches):
        yield from run(batches)
        give_back()

    inner.__annotations__ = getattr(run, "__annotations__", {})
    return inner


class Scratch:
    """Writes intermediate tables and deletes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, step: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{step}")
        with shuffle_cleanup(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            if path := self._paths.pop(id(t), None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
