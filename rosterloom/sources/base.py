"""What every source gives: members, tenures, periods, segments and link conflicts, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.operators.profile import Watched
from rosterloom.schema import LINK_CONFLICTS, MEMBERS, PERIODS, TENURES


@dataclass
class Roster:
    members: DataFrame
    tenures: DataFrame
    periods: DataFrame
    segments: DataFrame
    link_conflicts: DataFrame
    #: The stages of the fetch, where the source watches them: known when the members have been read.
    watched: Watched | None = None


SEGMENTS = "person_key string, council string, start date, end date"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, in a form that lets the optimizer drop whatever is joined with them."""
    kinds = [c.strip().split(" ", 1) for c in schema.split(", ")]
    return spark.range(1).filter(F.lit(False)).select(*[F.lit(None).cast(k).alias(n) for n, k in kinds])


def with_order(df: DataFrame) -> DataFrame:
    """The rows with their place in the source, taken before anything is shuffled."""
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())


def present(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate column that the source has; null columns count, absent ones don't."""
    return next((c for c in candidates if c in df.columns), None)


def first_of(df: DataFrame, *candidates: str) -> Column:
    """The first non-blank value among the candidate columns that the source has."""
    own = [text.blank_to_null(F.col(f"`{c}`").cast("string")) for c in candidates if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def leaf_of(columns: list[str], name: str) -> str | None:
    """A column by its exact name, or by the last underscore segment of the name: the shallowest, then alphabetical."""
    if name in columns:
        return name
    leaf = lambda c: c.lower().rsplit("_", 1)[-1]
    return min((c for c in columns if leaf(c) == leaf(name)), key=lambda c: (c.count("_"), c), default=None)


def by_leaf(df: DataFrame, name: str) -> str | None:
    return leaf_of(df.columns, name)


def by_hint(df: DataFrame, *hints: str) -> str | None:
    """The first column that contains a hint, the hints in their order."""
    return next((c for h in hints for c in df.columns if h.lower() in c.lower()), None)


def as_members(df: DataFrame, **columns: Column) -> DataFrame:
    """The member schema from the given expressions; what isn't given is null."""
    kinds = {c.strip().split(" ", 1)[0]: c.strip().split(" ", 1)[1] for c in MEMBERS.split(", ")}
    assert set(columns) <= set(kinds)
    return df.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def shaped(df: DataFrame, schema: str) -> DataFrame:
    kinds = [c.strip().split(" ", 1) for c in schema.split(", ")]
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in kinds])


def role_allowed(role: Column, allowed: Sequence[str]) -> Column:
    """Folded equality with one of the allowed roles; no list allows all."""
    if not allowed:
        return F.lit(True)
    return F.coalesce(text.folded(role).isin(*[" ".join(a.split()).casefold() for a in allowed]), F.lit(False))


def link_conflicts(rows: DataFrame, person: str, link: str, council: Column, seats: DataFrame | None = None) -> DataFrame:
    """Items that several source records name; with ``seats`` (person ids), only if one of them has a seat."""
    named = rows.select(F.col(person).cast("bigint").alias("id"), text.item_id(F.col(link)).alias("qid")).filter("qid IS NOT NULL AND id IS NOT NULL").distinct()
    several = named.groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("person_ids")).filter(F.size("person_ids") > 1)
    if seats is not None:
        held = named.join(seats.select(F.col(seats.columns[0]).cast("bigint").alias("id")).distinct(), "id", "left_semi").select("qid").distinct()
        several = several.join(held, "qid", "left_semi")
    return shaped(several.withColumn("council", council), LINK_CONFLICTS)


EMPTY = {"tenures": TENURES, "periods": PERIODS, "segments": SEGMENTS, "link_conflicts": LINK_CONFLICTS}


def roster(spark: SparkSession, members: DataFrame, watched: Watched | None = None, **parts: DataFrame) -> Roster:
    return Roster(members, **{n: parts.get(n, empty(spark, s)) for n, s in EMPTY.items()}, watched=watched)
