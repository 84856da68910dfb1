"""Mandate and contact indexes of a council's records system; an open end is a far date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import dates, text
from rosterloom.operators import dedup
from rosterloom.schema import TENURES
from rosterloom.sources import base


def seat_today(start: Column, end: Column, role: Column, roles: Sequence[str], today: Column) -> Column:
    """Begun by today and not over before it, in an allowed role."""
    e = dates.open_end(end)
    return F.coalesce(dates.compact_date(start) <= today, F.lit(False)) & (e.isNull() | (e >= today)) & base.role_allowed(role, roles)


def _in_bodies(mandates: DataFrame, bodies: dict[str, str]) -> DataFrame:
    """Mandates with their council, by the exact folded name of the body."""
    names = {" ".join(v.split()).casefold(): k for k, v in bodies.items()}
    council = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return base.with_order(mandates).withColumn("council", F.try_element_at(council, text.folded(F.col("gremium")))).filter("council IS NOT NULL")


def members(mandates: DataFrame, persons: DataFrame, bodies: dict[str, str], roles: Sequence[str], today: Column) -> DataFrame:
    """A member for each person and council, the earliest seat. A mandate's own names, district and
    party win over the contact's; a year of birth never becomes a date."""
    own = _in_bodies(mandates, bodies).filter(seat_today(F.col("dauer_start"), F.col("dauer_end"), F.col("funktion"), roles, today))
    numbered = base.with_order(persons)
    who = dedup.top1(numbered, ["obj_guid"], [F.col("ord").desc()])
    met = own.join(who.select(*[F.col(c).alias(f"p_{c}") for c in persons.columns]), F.col("kontaktguid") == F.col("p_obj_guid"), "left")
    both = lambda c: base.first_of(met, c, f"p_{c}")
    name = text.given_and_last(both("vorname"), both("name"), base.first_of(met, "p_namevorname"))
    out = base.as_members(
        met, ord=F.col("ord"), person_key=F.col("kontaktguid"), council=F.col("council"), full_name=F.nullif(F.trim(F.concat_ws(" ", name["given"], name["last"])), F.lit("")), active=F.lit(True), date_joining=dates.compact_date(F.col("dauer_start")), date_leaving=dates.open_end(F.col("dauer_end")),
        constituency=both("wahlkreis"), party=both("partei"), parl_group=base.first_of(met, "p_fraktion"), occupations=text.split_list(base.first_of(met, "p_beruf")), website=base.first_of(met, "p_homepageprivat"),
    )
    return dedup.keep_earliest(out, ["person_key", "council"], "date_joining", ["ord"])


def tenures(mandates: DataFrame, bodies: dict[str, str]) -> DataFrame:
    own = _in_bodies(mandates, bodies).select("ord", F.col("kontaktguid").alias("person_key"), "council", dates.compact_date(F.col("dauer_start")).alias("start"), dates.open_end(F.col("dauer_end")).alias("end"))
    return base.shaped(dedup.keep_latest(own.filter("start IS NOT NULL"), ["person_key", "council"], "start", ["ord"]), TENURES)
