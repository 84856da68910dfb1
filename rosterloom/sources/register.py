"""A historical register: three sheets of persons, seats and parties, dates in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import dates, text
from rosterloom.operators import dedup
from rosterloom.schema import TENURES
from rosterloom.sources import base


def _date(prefix: str) -> Column:
    return dates.composed_date(F.col(f"{prefix}_jahr"), F.col(f"{prefix}_monat"), F.col(f"{prefix}_tag"))


def _seats(rows: DataFrame, chamber: str) -> DataFrame:
    own = base.with_order(rows).filter(F.trim("rat") == chamber)
    return own.select("ord", "id_einsitz_new", F.trim("id_person_new").alias("pid"), "wahlkreis", _date("datum_eintritt").alias("start"), _date("datum_austritt").alias("end"), text.blank_to_null(F.col("datum_austritt_jahr")).isNull().alias("open"))


def members(seats: DataFrame, persons: DataFrame, parties: DataFrame, chamber: str, council: str, today: Column) -> DataFrame:
    """Open seats begun by today (or without a known beginning), each person once: an active seat, then
    the later one. The party is the last one given for the seat, the district is the seat's own."""
    own = _seats(seats, chamber).filter(F.col("open") & (F.col("start").isNull() | (F.col("start") <= today)))
    who = persons.dropDuplicates(["id_person_new"]).select(F.trim("id_person_new").alias("p_id"), "vorname", "nachname", "beruf", dates.composed_date(F.col("datum_geburt_jahr"), F.col("datum_geburt_monat"), F.col("datum_geburt_tag")).alias("born"))
    last = lambda c: F.max_by(text.blank_to_null(F.col(c)), F.when(text.blank_to_null(F.col(c)).isNotNull(), F.col("ord"))).alias(c)
    party = base.with_order(parties).groupBy(F.trim("id_einsitz_new").alias("e_id")).agg(last("parteibezeichnung"), last("fraktion"))
    met = own.join(who, F.col("pid") == F.col("p_id"), "left").join(party, F.trim("id_einsitz_new") == F.col("e_id"), "left")
    out = base.as_members(
        met, ord=F.col("ord"), person_key=F.coalesce(text.blank_to_null(F.col("pid")), F.col("p_id")), council=F.lit(council), full_name=F.nullif(F.concat_ws(" ", text.blank_to_null(F.col("vorname")), text.blank_to_null(F.col("nachname"))), F.lit("")), active=F.lit(True), date_joining=F.col("start"), date_leaving=F.col("end"),
        constituency=F.nullif(text.tidy(F.col("wahlkreis")), F.lit("")), parl_group=F.col("fraktion"), party=F.col("parteibezeichnung"), birth_date=F.col("born"), occupations=text.split_list(F.col("beruf")),
    )
    return dedup.keep_active_first(out, ["person_key", "council"], F.col("active"), "date_joining", ["ord"])


def tenures(seats: DataFrame, chamber: str, council: str) -> DataFrame:
    own = _seats(seats, chamber).filter("start IS NOT NULL AND pid IS NOT NULL").select("ord", F.col("pid").alias("person_key"), F.lit(council).alias("council"), "start", "end")
    return base.shaped(dedup.keep_latest(own, ["person_key", "council"], "start", ["ord"]), TENURES)
