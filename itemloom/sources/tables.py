"""Parquet tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table's columns; zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in df.schema])


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed into the shared folder of spark.checkpoint.dir, without its lineage; a local folder only on one machine.

    It is read back as Parquet, so that joins go by the size that it has: a checkpoint would be taken for as small as the
    files that it was computed from, and broadcast whole.  Files are far shorter than their rows, though, and a broadcast holds rows:
    where these are over the limit of a broadcast, the table asks for a merge join.  The folder goes when the session ends.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/itemloom"
    path = f"{folder}/{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return out.hint("merge") if written.get["n"] * (8 + df._jdf.schema().defaultSize()) > most else out
