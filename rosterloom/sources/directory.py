"""A directory of memberships and persons: a seat is a membership of the chamber's group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import dates, text
from rosterloom.operators import dedup
from rosterloom.schema import TENURES
from rosterloom.sources import base


def group_ids(groups: DataFrame, chambers: dict[str, str], configured: dict[str, int] | None = None) -> dict[str, int]:
    """Each council's group by the exact folded name of its chamber in any name or title column; the
    first match wins, a configured id before all. Near misses are no match."""
    names = [c for c in groups.columns if c.startswith(("name", "title"))]
    out = dict(configured or {})
    wanted = {" ".join(v.split()).casefold(): k for k, v in chambers.items() if k not in out}
    if wanted and names:
        cells = base.with_order(groups).select("ord", "id", F.explode(F.array(*[text.folded(F.col(c)) for c in names])).alias("cell"))
        hits = cells.filter(F.col("cell").isin(*wanted)).groupBy("cell").agg(F.min_by("id", "ord").alias("id"))
        out |= {wanted[r["cell"]]: r["id"] for r in hits.collect()}  # at most a row a chamber
    return out


def seat_today(begin: Column, end: Column, role: Column, roles: Sequence[str], today: Column) -> Column:
    """Begun by today, with an empty end (even an end to come disqualifies), in an allowed role."""
    b = dates.iso_date(begin)
    return text.blank_to_null(end).isNull() & F.coalesce(b <= today, F.lit(False)) & base.role_allowed(role, roles)


def members(memberships: DataFrame, persons: DataFrame, groups: dict[str, int], roles: Sequence[str], today: Column) -> DataFrame:
    """A member for each person and council; a seat whose person is unknown stays."""
    council = F.create_map(*[F.lit(x) for k, v in groups.items() for x in (v, k)]) if groups else None
    rows = base.with_order(memberships)
    role = base.present(rows, "role_name_de", "role_name")
    role = F.col(role) if role else F.lit(None).cast("string")
    seats = rows.filter(F.col("group_id").isin(*groups.values()) if groups else F.lit(False))
    seats = seats.filter(seat_today(F.col("begin_date"), F.col("end_date"), role, roles, today))
    who = persons.dropDuplicates(["id"]).select(*[F.col(c).alias(f"p_{c}") for c in persons.columns])
    met = seats.join(who, F.col("person_id") == F.col("p_id"), "left")
    name = text.given_and_last(base.first_of(met, "p_firstname"), base.first_of(met, "p_lastname"), base.first_of(met, "p_fullname"))
    out = base.as_members(
        met, ord=F.col("ord"), person_key=F.coalesce(F.col("person_id"), F.col("p_id")), council=F.try_element_at(council, F.col("group_id")) if groups else F.lit(None), full_name=F.nullif(F.trim(F.concat_ws(" ", name["given"], name["last"])), F.lit("")), active=F.lit(True),
        date_joining=dates.iso_date(F.col("begin_date")), date_leaving=dates.iso_date(F.col("end_date")), constituency=text.tidy(base.first_of(met, "p_electoral_district_de", "p_electoral_district_fr")), party=base.first_of(met, "p_party_de"), birth_date=dates.iso_date(base.first_of(met, "p_birthday")),
        occupations=text.split_list(base.first_of(met, "p_occupation_de")), website=base.first_of(met, "p_website_personal"),
    )
    return dedup.keep_latest(out, ["person_key", "council"], "date_joining", ["ord"])


def tenures(memberships: DataFrame, groups: dict[str, int]) -> DataFrame:
    """The latest spell of each person in each council."""
    council = F.create_map(*[F.lit(x) for k, v in groups.items() for x in (v, k)])
    rows = base.with_order(memberships).filter(F.col("group_id").isin(*groups.values()))
    own = rows.select("ord", F.col("person_id").cast("string").alias("person_key"), F.try_element_at(council, F.col("group_id")).alias("council"), dates.iso_date(F.col("begin_date")).alias("start"), dates.iso_date(F.col("end_date")).alias("end"))
    return base.shaped(dedup.keep_latest(own.filter("start IS NOT NULL"), ["person_key", "council"], "start", ["ord"]), TENURES)


def spans(memberships: DataFrame, persons: DataFrame, groups: dict[str, int]) -> DataFrame:
    """What this source says of a seat, by item and council: items that several records claim are left
    out first, then each seat's rows are chained to the spell that is current."""
    from rosterloom.operators import chains
    from rosterloom.schema import SPANS

    council = F.create_map(*[F.lit(x) for k, v in groups.items() for x in (v, k)])
    links = persons.select(F.col("id").cast("bigint").alias("pid"), text.item_id(F.col("wikidata_id")).alias("qid")).filter("qid IS NOT NULL").distinct()
    sole = links.groupBy("qid").agg(F.count("*").alias("n"), F.min("pid").alias("pid")).filter("n = 1").drop("n")
    rows = base.with_order(memberships).filter(F.col("group_id").isin(*groups.values())).join(sole, F.col("person_id") == F.col("pid"))
    own = rows.select("ord", "qid", "pid", F.try_element_at(council, F.col("group_id")).alias("council"), dates.iso_date(F.col("begin_date")).alias("start"), dates.iso_date(F.col("end_date")).alias("end"))
    runs = chains.latest_tenures(own, ["qid", "council"], "start", "end", ["ord"])
    ids = own.groupBy("qid", "council").agg(F.array_sort(F.collect_set("pid")).alias("person_ids"))
    return base.shaped(runs.join(ids, ["qid", "council"]).withColumnsRenamed({"tenure_start": "start", "tenure_end": "end"}), SPANS)
