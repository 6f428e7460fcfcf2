"""Where tables that later jobs read are written. Kept apart, so that Python workers import little."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; in local mode alone, one of our own where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="annulus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes an execution's shuffle files as soon as that execution has ended."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, Spark hands Python workers so many rows at a time at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written below the shared folder, so that later jobs neither recompute nor depend on one executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, rows: int = 10_000) -> DataFrame:
        """Write ``df`` and return it as read from there; rows: to a batch of its Python workers."""
        with shuffles_freed(self.spark), batches_of(self.spark, rows):
            df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
