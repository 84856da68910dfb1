"""Joins that refuse to arbitrate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.assign import settled


def claimants(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Per key: how many distinct items claim it, and the item if it is one."""
    grouped = df.groupBy(*keys).agg(F.min(item).alias("item"), F.count_distinct(item).alias("claims"))
    return grouped.select(*keys, "claims", F.when(F.col("claims") == 1, F.col("item")).alias("item"))


def unique_key_join(probe: DataFrame, build: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """``probe`` with the one item of its key, and how many items claim the key; more than one: no item."""
    return probe.join(claimants(build, keys, item), list(keys), "left").withColumn("claims", F.coalesce("claims", F.lit(0)))


def collisions(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """The keys that more than one item claims."""
    return claimants(df, keys, item).filter("claims > 1").drop("item")


def corroborated_pick(candidates: DataFrame, keys: Sequence[str], item: str, agrees: Column, contradicts: Column, seated: Column) -> DataFrame:
    """One item per key or none: contradicted candidates go; exactly one that agrees wins; several that
    agree are none; else the only seated one; else the sole survivor, if nobody is seated."""
    left = candidates.filter(~F.coalesce(contradicts, F.lit(False)))
    a, s = F.coalesce(agrees, F.lit(False)), F.coalesce(seated, F.lit(False))
    counted = left.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(a).alias("n_agree"), F.count_if(s).alias("n_seated"),
        F.min(F.when(a, F.col(item))).alias("i_agree"), F.min(F.when(s, F.col(item))).alias("i_seated"), F.min(item).alias("i"),
    )
    picked = F.when(F.col("n_agree") == 1, F.col("i_agree")).when(F.col("n_agree") > 1, None).when(F.col("n_seated") == 1, F.col("i_seated")).when((F.col("n_seated") == 0) & (F.col("n") == 1), F.col("i"))
    return counted.select(*keys, picked.alias("picked"), "n", "n_agree", "n_seated")


def reverse_walk(items: DataFrame, held: DataFrame, held_ids: DataFrame, item: str, ident: str) -> DataFrame:
    """Items that no active member is matched to, neither by item nor by identifier."""
    return items.join(held.select(item).filter(F.col(item).isNotNull()).distinct(), item, "left_anti").join(held_ids.select(ident).filter(F.col(ident).isNotNull()).distinct(), ident, "left_anti")


def greedy_assign(candidates: DataFrame, group: str, member: str, order: str, item: str, score: str) -> DataFrame:
    """Members in their order take their best candidate that is not taken yet; they compete only within ``group``."""
    who, what = F.struct(group, order, member), F.struct(group, item)
    pairs = candidates.select(who.alias("_who"), what.alias("_what"), F.col(score).alias("_score"))

    def best(left: DataFrame) -> DataFrame:
        return left.groupBy("_who").agg(F.max_by("_what", F.struct("_score", -F.col(f"_what.{item}"))).alias("_what"))

    return settled(pairs, "_who", "_what", best, whole=False).select(f"_who.{group}", f"_who.{member}", f"_what.{item}")


def two_signal_align(left: DataFrame, right: DataFrame, left_key: str, right_key: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Each left row with a right row by two signals, each only where it is unique; where both speak and
    differ it is a conflict."""

    def by(signal: tuple[str, str], name: str) -> DataFrame:
        a, b = signal
        own = left.filter(F.col(a).isNotNull()).groupBy(a).agg(F.min(left_key).alias(left_key), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
        other = right.filter(F.col(b).isNotNull()).groupBy(b).agg(F.min(right_key).alias(name), F.count("*").alias("_m")).filter("_m = 1").drop("_m")
        return own.join(other, F.col(a) == F.col(b)).select(left_key, name)

    met = left.select(left_key).join(by(first, "by_first"), left_key, "left").join(by(second, "by_second"), left_key, "left")
    verdict = F.when(F.col("by_first").isNull() & F.col("by_second").isNull(), "unmatched").when(F.col("by_first") != F.col("by_second"), "conflict").otherwise("matched")
    return met.select(left_key, F.when(verdict == "matched", F.coalesce("by_first", "by_second")).alias(right_key), verdict.alias("verdict"))


def spare_right(aligned: DataFrame, right: DataFrame, right_key: str) -> DataFrame:
    """The right rows that ``two_signal_align`` gave to no left row."""
    return right.join(aligned.select(right_key).filter(F.col(right_key).isNotNull()).distinct(), right_key, "left_anti")


def column_hunt(records: DataFrame, person: str, wanted: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """For each column, how many people's wanted value stands in it."""
    long = records.select(person, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([person], list(columns), "column_name", "cell")
    hit = long.join(wanted.select(F.col(person).alias("_p"), F.col(value).cast("string").alias("_v")), (F.col(person) == F.col("_p")) & (F.col("cell") == F.col("_v")))
    return hit.groupBy("column_name").agg(F.count_distinct(person).alias("people"))
