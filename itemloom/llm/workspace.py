"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only on a single one, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/itemloom"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the session's Arrow batches by bytes, because texts can be long; a lower bound stays.

    It is a setting of the session, since results are lazy and run after their operator has returned.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= size:
        spark.conf.set(key, str(size))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


class Workspace:
    """Tables of one run: written as Parquet, read back without their lineage, dropped when used up.

    What a lazy result still reads stays until the session ends, when its file system deletes it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        path, files = self._files(self.path)
        files.deleteOnExit(path)

    def _files(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later read needs."""
        for name in names:
            path, files = self._files(f"{self.path}/{name}")
            files.delete(path, True)

    def tidy(self) -> None:
        """Lets the driver's JVM notice which shuffles nothing refers to any more, so that Spark's cleaner deletes their files."""
        self.spark.sparkContext._jvm.System.gc()
