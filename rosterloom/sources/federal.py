"""The federal roster: a table of seats with its history, and a table of periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import dates, text
from rosterloom.operators import chains, dedup
from rosterloom.operators.profile import Watched
from rosterloom.schema import PERIODS, TENURES
from rosterloom.sources import base


def _in_councils(df: DataFrame, councils: Sequence[str]) -> Column:
    return F.upper(F.trim("CouncilAbbreviation")).isin(*[c.strip().upper() for c in councils])


def stages(rows: DataFrame, councils: Sequence[str], active_only: bool = True) -> list[tuple[str, Column]]:
    """What a row has to pass to become a member, in order."""
    active = [("active", text.as_bool(F.col("Active")))] if active_only else []
    return [*active, ("person_number", F.col("PersonNumber").isNotNull()), ("council", _in_councils(rows, councils))]


def members(rows: DataFrame, councils: Sequence[str], active_only: bool = True) -> DataFrame:
    """One member for each person and council, the latest seat; rows without a person number are dropped."""
    df = base.with_order(rows).filter(_in_councils(rows, councils) & F.col("PersonNumber").isNotNull())
    df = df.filter(text.as_bool(F.col("Active"))) if active_only else df
    c, day = F.col, lambda name: dates.federal_date(F.col(name))
    out = base.as_members(
        df, ord=c("ord"), person_key=text.as_int(c("PersonNumber")), council=F.upper(F.trim("CouncilAbbreviation")), full_name=F.nullif(F.concat_ws(" ", text.blank_to_null(c("FirstName")), text.blank_to_null(c("LastName"))), F.lit("")),
        active=text.as_bool(c("Active")), date_joining=day("DateJoining"), date_leaving=day("DateLeaving"), constituency=text.blank_to_null(c("CantonAbbreviation")), parl_group=text.blank_to_null(c("ParlGroupAbbreviation")), party=text.blank_to_null(c("PartyAbbreviation")),
        birth_date=day("DateOfBirth"), place_of_birth=text.birthplace(c("BirthPlace_City"), c("BirthPlace_Canton")), places_of_origin=text.origin_places(c("Citizenship")) if "Citizenship" in df.columns else F.lit(None), number_of_children=text.as_int(c("NumberOfChildren")),
    )
    return dedup.keep_latest(out, ["person_key", "council"], "date_joining", ["ord"])


def segments(history: DataFrame, councils: Sequence[str]) -> DataFrame:
    """Each spell once: the historic table repeats them by language and by change."""
    df = base.with_order(history).filter(_in_councils(history, councils) & F.col("PersonNumber").isNotNull())
    own = df.select("ord", text.as_int(F.col("PersonNumber")).cast("string").alias("person_key"), F.upper(F.trim("CouncilAbbreviation")).alias("council"), dates.federal_date(F.col("DateJoining")).alias("start"), dates.federal_date(F.col("DateLeaving")).alias("end"))
    return own.filter("start IS NOT NULL").groupBy("person_key", "council", "start", "end").agg(F.min("ord").alias("ord"))


def tenures(history: DataFrame, councils: Sequence[str]) -> DataFrame:
    """Each person's current spell in a council, chained over the terms it is cut into."""
    runs = chains.latest_tenures(segments(history, councils), ["person_key", "council"], "start", "end", ["ord"])
    return base.shaped(runs.withColumnsRenamed({"tenure_start": "start", "tenure_end": "end"}), TENURES)


def periods(rows: DataFrame) -> DataFrame:
    """Each period once; a dated row is preferred."""
    own = base.with_order(rows).select("ord", text.as_int(F.col("LegislativePeriodNumber")).cast("int").alias("number"), F.col("LegislativePeriodName").alias("name"), dates.federal_date(F.col("StartDate")).alias("start"), dates.federal_date(F.col("EndDate")).alias("end"))
    return base.shaped(dedup.keep_first_dated(own.filter("number IS NOT NULL"), ["number"], "start", ["ord"]), PERIODS)


def period_ids(rows: DataFrame) -> DataFrame:
    """(id, number) of each period's row: ballots name periods by the id of a row, all else by number."""
    own = rows.select(text.as_int(F.col("ID")).alias("id"), text.as_int(F.col("LegislativePeriodNumber")).cast("int").alias("number"))
    return own.filter("id IS NOT NULL AND number IS NOT NULL").distinct()


def corrected(found: DataFrame, tenures: DataFrame) -> int:
    """How many members' starts the chained spells move."""
    starts = tenures.select(F.col("person_key").alias("_p"), F.upper("council").alias("_c"), F.col("start").alias("_s"))
    met = found.join(starts, (F.col("person_key") == F.col("_p")) & (F.upper("council") == F.col("_c")))
    return met.filter(F.col("_s").isNotNull() & ~F.coalesce("tenure_start", "date_joining").eqNullSafe(F.col("_s"))).count()


def with_tenure_starts(found: DataFrame, tenures: DataFrame) -> DataFrame:
    """Members whose seat began before their latest row says: the start of the chained spell."""
    starts = tenures.select(F.col("person_key").alias("_p"), F.upper("council").alias("_c"), F.col("start").alias("_s"))
    met = found.join(starts, (F.col("person_key") == F.col("_p")) & (F.upper("council") == F.col("_c")), "left")
    return met.withColumn("tenure_start", F.coalesce("_s", "tenure_start")).select(found.columns)


def read(rows: DataFrame, history: DataFrame, period_rows: DataFrame, councils: Sequence[str], active_only: bool = True) -> base.Roster:
    spells = tenures(history, councils)
    watched = Watched(rows, stages(rows, councils, active_only))
    people = with_tenure_starts(members(watched.rows, councils, active_only), spells)
    return base.roster(rows.sparkSession, people, watched, tenures=spells, periods=periods(period_rows), segments=base.shaped(segments(history, councils), base.SEGMENTS))
