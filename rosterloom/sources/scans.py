"""Scans that a run shares, samples and traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scans:
    """Each named scan is made once and its rows are kept for all that ask; ``close`` lets them go."""

    def __init__(self):
        self._kept: dict[tuple, DataFrame] = {}

    def get(self, key: tuple, scan: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._kept:
            self._kept[key] = scan().persist()
        return self._kept[key]

    def close(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()


def head(df: DataFrame, n: int, **equal) -> DataFrame:
    """The first n rows that hold the given values; the limit reaches the scan."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    return df.limit(n)


def sample_columns(df: DataFrame | None) -> list[str] | None:
    """The columns that a source gives; None if it could not be read, which isn't the same as no columns."""
    return None if df is None else list(df.columns)


def trace(people: DataFrame, memberships: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """All memberships of the first n people with their groups, known or not: id, group_id, group_name, begin_date, end_date."""
    few = people.orderBy("id").limit(n).select(F.col("id").alias("_p"))
    names = groups.select(F.col("id").alias("_g"), F.col("name").alias("group_name")).dropDuplicates(["_g"])
    met = memberships.join(F.broadcast(few), F.col("person_id") == F.col("_p")).join(names, F.col("group_id") == F.col("_g"), "left")
    return met.select(F.col("_p").alias("id"), "group_id", "group_name", "begin_date", "end_date")


def near_misses(groups: DataFrame, column: str, wanted: str) -> DataFrame:
    """Groups that mention a chamber's name and aren't named so."""
    from rosterloom.functions import text

    name, own = text.folded(F.lit(wanted)), text.folded(F.col(column))
    return groups.filter(F.contains(own, name) & (own != name))
