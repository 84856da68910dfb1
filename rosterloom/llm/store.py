"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` of the session names it; where it is unset and the master is local, as in tests, a folder of
this process's own is set; on a cluster without the setting it is an error. A written table cuts the lineage: when an executor is lost, what it had
written is read again and not made again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Small tables matter more than the CPU time for it: these tables count as disk.
CODEC = "zstd"


def shared(spark: SparkSession) -> str:
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='rosterloom-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder, a folder for each value of the columns ``by``, and read again."""
    path = place(spark, name)
    df.write.option("compression", CODEC).partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned and nothing reads any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
