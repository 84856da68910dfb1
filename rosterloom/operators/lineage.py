"""Cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where that is unset and the master is local, as in tests,
    a folder of this process's own; on a cluster it has to be set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='rosterloom-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, checkpointed to the shared folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read again; ``removed`` deletes them."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
