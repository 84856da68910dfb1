"""An extension beyond the batch run: seats as a stream.

Rows of seats that arrive in files are chained into runs by a session window: a gap of more than
``most_gap`` days ends a run. With ``availableNow`` a run reads what has arrived since the last one and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seats(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def runs(rows: DataFrame, keys: list[str], when: str, most_gap: str = "1 day", late: str = "30 days") -> DataFrame:
    """The runs of each key: first and last row's time and how many rows; rows later than ``late`` are dropped."""
    window = F.session_window(F.col(when), most_gap)
    return rows.withWatermark(when, late).groupBy(*keys, window.alias("w")).agg(F.min(when).alias("first"), F.max(when).alias("last"), F.count("*").alias("rows")).drop("w")


def counts(rows: DataFrame, when: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """How many rows of each kind fall into each window of time."""
    return rows.withWatermark(when, late).groupBy(F.window(when, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def arrive(df: DataFrame, path: str, checkpoint: str) -> None:
    """What has arrived, appended to a table; returns when all of it is written."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
