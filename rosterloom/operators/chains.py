"""Segments of one person and seat, chained into continuous tenures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def current_runs(df: DataFrame, keys: Sequence[str], s: str, e: str, tie: Sequence[str], most_gap: int = 1) -> DataFrame:
    """The segments of each key's newest run, walking back while an earlier segment ends at most
    ``most_gap`` days before the next one begins; an open earlier segment or an overlap ends the run.
    Segments without a start take no part."""
    dated = df.filter(F.col(s).isNotNull())
    forward = Window.partitionBy(*keys).orderBy(F.col(s), *map(F.col, tie))
    gap = F.datediff(F.col(s), F.lag(e).over(forward))
    broken = F.when(F.row_number().over(forward) == 1, 0).when(gap.between(0, most_gap), 0).otherwise(1)
    after = forward.rowsBetween(1, Window.unboundedFollowing)
    marked = dated.withColumn("_b", broken).withColumn("_later", F.coalesce(F.sum("_b").over(after), F.lit(0)))
    return marked.filter("_later = 0").drop("_b", "_later")


def latest_tenures(df: DataFrame, keys: Sequence[str], s: str, e: str, tie: Sequence[str], most_gap: int = 1) -> DataFrame:
    """Each key's newest run as one row: its start, the end of its newest segment (null: open), and
    how many segments it has. An end that the newest segment lacks is never taken from an earlier one."""
    newest = F.max_by(F.struct(F.col(e).alias("e")), F.struct(F.col(s), *map(F.col, tie)))
    runs = current_runs(df, keys, s, e, tie, most_gap)
    return runs.groupBy(*keys).agg(F.min(s).alias("tenure_start"), newest["e"].alias("tenure_end"), F.count("*").alias("segments"))


def current_start(df: DataFrame, keys: Sequence[str], s: str, is_open) -> DataFrame:
    """The latest start among open rows, or else the latest of all."""
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(is_open, F.col(s))), F.max(s)).alias("current_start"))
