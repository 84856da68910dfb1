"""Periods against roll calls: who was assigned to a period, and who voted in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.operators import intervals
from rosterloom.operators.lineage import written
from rosterloom.plans.rules import start_date
from rosterloom.sources import votes


def coverage(members: DataFrame, periods: DataFrame) -> DataFrame:
    """(number, person_key): the periods that each member's seat covers."""
    own = members.select("person_key", start_date().alias("s"), F.col("date_leaving").alias("e"))
    return intervals.overlap_join(own, periods.select("number", "start", "end"), ("s", "e"), ("start", "end"), small=True).select("number", "person_key").distinct()


def validate(members: DataFrame, periods: DataFrame, attendance: DataFrame) -> DataFrame:
    """Per period of the roll calls (number, person_key): assigned, voted, still sitting, voters whose
    present seat began later (an earlier mandate), and sitting voters that were not assigned, of
    whom there must be none."""
    c = F.col
    assigned = coverage(members, periods).withColumn("assigned", F.lit(True))
    voted = attendance.select("number", F.col("person_key").cast("string").alias("person_key")).distinct().withColumn("voted", F.lit(True))
    seats = members.groupBy("person_key").agg(F.min(start_date()).alias("since"), F.lit(True).alias("sitting"))
    ends = periods.select("number", F.col("end").alias("p_end"))
    met = assigned.join(voted, ["number", "person_key"], "full_outer").join(seats, "person_key", "left").join(F.broadcast(ends), "number", "left")
    met = met.join(voted.select("number").distinct(), "number", "left_semi")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    yes = lambda x: F.coalesce(x, F.lit(False))
    earlier = yes(c("p_end") < c("since"))
    n = lambda x, name: F.count_if(x).alias(name)
    return met.groupBy("number").agg(
        n(yes(c("assigned")), "assigned"), n(yes(c("voted")), "voted"), n(yes(c("voted")) & yes(c("sitting")), "still_sitting"),
        n(yes(c("voted")) & yes(c("sitting")) & earlier, "earlier_mandate"), n(yes(c("voted")) & yes(c("sitting")) & no(c("assigned")) & ~earlier, "not_assigned"),
    ).withColumn("valid", c("not_assigned") == 0)


MOST_PERIODS = 3


def people(members: DataFrame, periods: DataFrame, attendance: DataFrame) -> DataFrame:
    """(number, person_key, verdict) of everybody whom a period's roll call or its seats name: ``agrees``, ``left_since`` (voted, sits no
    more), ``earlier_mandate``, ``not_assigned`` (the one that must not be) and ``did_not_vote``."""
    c = F.col
    assigned = coverage(members, periods).withColumn("assigned", F.lit(True))
    voted = attendance.select("number", c("person_key").cast("string").alias("person_key")).distinct().withColumn("voted", F.lit(True))
    seats = members.groupBy("person_key").agg(F.min(start_date()).alias("since"), F.lit(True).alias("sitting"))
    met = assigned.join(voted, ["number", "person_key"], "full_outer").join(seats, "person_key", "left").join(F.broadcast(periods.select("number", c("end").alias("p_end"))), "number", "left")
    met = met.join(F.broadcast(voted.select("number").distinct()), "number", "left_semi")
    verdict = (
        F.when(c("voted").isNull(), "did_not_vote").when(c("sitting").isNull(), "left_since").when(c("assigned"), "agrees")
        .when(F.coalesce(c("p_end") < c("since"), F.lit(False)), "earlier_mandate").otherwise("not_assigned")
    )
    return met.select("number", "person_key", verdict.alias("verdict"))


def newest_assigned(members: DataFrame, periods: DataFrame, n: int = MOST_PERIODS) -> DataFrame:
    """The newest periods (with their id) that any member is assigned to: only those can contradict an assignment."""
    used = coverage(members, periods).select("number").distinct()
    return periods.filter("id IS NOT NULL").join(used, "number", "left_semi").orderBy(F.desc("number")).limit(n)


def from_service(spark: SparkSession, members: DataFrame, periods: DataFrame, url: str, vote_ids: Sequence[int] = (), language: str = "DE", delay: float = 1.0, most_periods: int = MOST_PERIODS) -> tuple[DataFrame, list[dict]]:
    """The verdicts of ``people`` by the roll calls of a service, and the votes that couldn't be read.

    ``periods`` are (id, number, start, end). Without votes they are discovered for the newest assigned periods. The votes, a few by
    their nature, come to the driver; ballots don't.
    """
    chosen = list(vote_ids) or sorted(r["vote_id"] for r in votes.find_votes(spark, newest_assigned(members, periods, most_periods), url, language, delay).collect())
    if not chosen:
        raise ValueError("no roll call was found; name a vote for each period")
    found = written(votes.ballots(spark, chosen, url, language, delay), "ballots")  # the service is read once
    failed = [r.asDict() for r in found.filter("error IS NOT NULL").select("vote", "error").collect()]
    return people(members, periods.select("number", "start", "end"), votes.attendance(found, periods)), failed
