"""Intermediate tables in the folder that driver and executors share.

A table written here cuts the lineage and survives the loss of executors: any executor can read it again.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-fitloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


#: Whether Spark deletes a statement's shuffle files as it ends, and not when the driver next collects garbage. What is written here is read
#: from there, so nobody reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of runs, of those who sweep them up later.
_open: list[list[Scratch]] = []


class Scratch:
    """Tables of one run of an operator, under one new folder of the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        if _open:
            _open[-1].append(self)

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write ``df`` and return what reads it; with a folder for each value of the columns ``by``, where such are named."""
        own = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.partitionBy(*by).parquet(f"{self.path}/{name}")
        finally:
            if own is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, own)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
        self.names = [n for n in self.names if n not in names]

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df``, an operator's result, and delete all tables before it."""
        before = list(self.names)
        kept = self.keep(df, name)
        self.drop(*before)
        return kept


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete the tables of all runs that begin inside, at the end: for who has written what came of them."""
    _open.append([])
    try:
        yield
    finally:
        for run in _open.pop():
            run.drop("")
