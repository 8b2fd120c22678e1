"""Intermediate tables in the folder that all executors share.

Iterative and multi-pass operators cut their lineage by writing a table, so that a lost executor never loses
the only copy of a step.  The folder is ``spark.checkpoint.dir`` of the session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_scopes: list[list[Workspace]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder if all runs on this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Named intermediate tables of one operator call.

    ``save`` writes a table and reads it back; ``drop`` deletes tables that nothing reads any more.  What is left goes when a
    :func:`temporary_tables` block around it ends, or else when the session's file system is closed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"
        self._hadoop(self.path)[0].deleteOnExit(self._hadoop(self.path)[1])
        if _scopes:
            _scopes[-1].append(self)

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, release: bool = True) -> None:
        for name in names:
            files, target = self._hadoop(f"{self.path}/{name}")
            files.delete(target, True)
        if release:
            self.release()

    def release(self) -> None:
        """Lets Spark remove shuffle files of plans that have ended: Python lets go first, then the JVM."""
        import gc

        for _ in range(2):  # what Python lets go reaches the JVM with its next call
            gc.collect()
            self.spark._jvm.System.gc()

    def remove(self) -> None:
        """Deletes all of its tables."""
        files, target = self._hadoop(self.path)
        files.delete(target, True)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Deletes, when it ends, the tables of all operators that were called inside; so what is still to be read from them must
    have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for work in _scopes.pop():
            work.remove()
