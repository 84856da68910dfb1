"""One row per key: ``row_number() = 1`` windows, which Spark cuts down before and after the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top1(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def keep_latest(df: DataFrame, keys: Sequence[str], when: str, tie: Sequence[str]) -> DataFrame:
    """The latest row of each key; no date counts as earliest, ties go to the first row."""
    return top1(df, keys, [F.col(when).desc_nulls_last(), *map(F.col, tie)])


def keep_earliest(df: DataFrame, keys: Sequence[str], when: str, tie: Sequence[str]) -> DataFrame:
    return top1(df, keys, [F.col(when).asc_nulls_last(), *map(F.col, tie)])


def keep_active_first(df: DataFrame, keys: Sequence[str], active: Column, when: str, tie: Sequence[str]) -> DataFrame:
    """An active row beats the others, then the later one."""
    return top1(df, keys, [F.coalesce(active, F.lit(False)).desc(), F.col(when).desc_nulls_last(), *map(F.col, tie)])


def keep_first_dated(df: DataFrame, keys: Sequence[str], when: str, tie: Sequence[str]) -> DataFrame:
    """The first row with a date, or else the first row."""
    return top1(df, keys, [F.col(when).isNull(), *map(F.col, tie)])


def unique_or_drop(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value of each key that has exactly one distinct value."""
    lo, hi = F.min(value), F.max(value)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(lo.alias(value), hi.alias("_hi")).filter(F.col(value) == F.col("_hi")).drop("_hi")


def limit_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def fold_fanout(df: DataFrame, keys: Sequence[str], firsts: dict[str, str], lists: dict[str, str], order: str) -> DataFrame:
    """Rows of a fan-out as one: ``firsts`` from the first row, ``lists`` as the sorted distinct values."""
    aggs = [F.min_by(c, order).alias(name) for name, c in firsts.items()]
    aggs += [F.array_sort(F.collect_set(c)).alias(name) for name, c in lists.items()]
    return df.groupBy(*keys).agg(*aggs)


def first_of_each(keys: DataFrame, rows: DataFrame, key: str, of: str, order: Sequence[str]) -> DataFrame:
    """Each of ``keys`` with the first of its rows: a lateral lookup of one row, which the optimizer turns into a join and a
    window over the rows. A key without rows is absent."""
    own = rows.filter(F.col(of) == F.col(key).outer()).orderBy(*order).limit(1)
    return keys.lateralJoin(own)
