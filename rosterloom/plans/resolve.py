"""From members to items: exact identifiers first, corroborated names after, never arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.operators.assign import settled, settled_alike  # noqa: F401


def corroborates(born: Column, last_name: Column, item_born: Column, label: Column, qid: Column) -> Column:
    """Whether an item looks like a member, its identifier aside: two known birth dates decide; else the surname
    stands in the item's label; a label that is missing or only the item's id says no."""
    name, last = text.folded(label), text.folded(last_name)
    usable = F.coalesce((name != "") & (name != text.folded(qid)) & (last != ""), F.lit(False))
    return F.when(born.isNotNull() & item_born.isNotNull(), born == item_born).otherwise(usable & F.coalesce(F.contains(name, last), F.lit(False)))


def by_identifier(members: DataFrame, items: DataFrame, corroborate: bool = False) -> DataFrame:
    """``members`` with qid, qid_source, duplicate_qids and mismatch_qids: an identifier that one item has is a match, one that
    several items have is a conflict with its claimants. With ``corroborate`` (an identifier that isn't
    verified) the sole claimant has to look like the member too; else it is a mismatch and no match."""
    claim = F.struct("qid", *[(F.col(c) if c in items.columns else F.lit(None).cast(k)).alias(c) for c, k in (("birth_date", "date"), ("label", "string"))])
    keyed = items.select("qid", text.id_normal(F.col("join_id")).alias("_id"), claim.alias("_claim")).filter("_id <> ''").groupBy("_id", "qid").agg(F.min("_claim").alias("_claim"))
    claims = keyed.groupBy("_id").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list("qid")).alias("_qids"), F.min("_claim").alias("_claim"))
    met = members.withColumn("_key", text.id_normal(F.col("person_key"))).join(claims, F.col("_key") == F.col("_id"), "left")
    sole, none = F.col("_n") == 1, F.array().cast("array<string>")
    alike = F.lit(True)
    if corroborate:
        last = F.col("last_name") if "last_name" in members.columns else text.given_and_last(F.lit(None), F.lit(None), F.col("full_name"))["last"]
        alike = corroborates(F.col("birth_date"), last, F.col("_claim.birth_date"), F.col("_claim.label"), F.col("_claim.qid"))
    one = sole & alike
    return met.select(
        *members.columns, F.when(one, F.col("_qids")[0]).alias("qid"), F.when(one, "identifier").alias("qid_source"),
        F.when(F.col("_n") > 1, F.col("_qids")).otherwise(none).alias("duplicate_qids"),
        F.when(sole & ~alike, F.col("_qids")).otherwise(none).alias("mismatch_qids"),
    )


def by_name(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rest by name: ``candidates`` are (name, qid, birth_date, has_position).

    Of a member's candidates those with another birth date go; one whose birth date agrees wins,
    several that agree are none; else the only one with the position; else a sole survivor, if nobody has
    the position. An item goes to the first member in the order of the rows that picks it; members
    who pick a taken item choose again among what is left, until no pick changes.
    """
    open_ = members.filter(F.col("qid").isNull() & text.searchable_name(F.col("full_name"))).select("ord", text.folded(F.col("full_name")).alias("_name"), F.col("birth_date").alias("_born"))
    named = candidates.select(text.folded(F.col("name")).alias("_n"), F.col("qid").alias("_q"), F.col("birth_date").alias("_b"), F.coalesce("has_position", F.lit(False)).alias("_seated")).dropDuplicates(["_n", "_q"])
    # members of one name and birth date have the same candidates: pairs are made for each such kind, not for each member
    open_ = open_.withColumn("_kind", F.concat_ws("|", F.coalesce(F.col("_born").cast("string"), F.lit("")), "_name"))
    pairs = open_.select("_kind", "_name", "_born").distinct().join(named, F.col("_name") == F.col("_n")).filter("_b IS NULL OR _born IS NULL OR _b = _born")
    pairs = pairs.select("_kind", "_q", "_seated", F.coalesce(F.col("_b") == F.col("_born"), F.lit(False)).alias("_agrees"))
    chosen = settled_alike(open_.select(F.col("_kind").alias("_alike"), F.col("ord").alias("_member")), pairs, "_kind", "_q", lambda left: _picks(left, "_kind"))
    met = members.join(chosen.select(F.col("_member").alias("_o"), "_q"), F.col("ord") == F.col("_o"), "left")
    return met.select(*[c for c in members.columns if c not in ("qid", "qid_source")], F.coalesce("qid", "_q").alias("qid"), F.when(F.col("qid").isNull() & F.col("_q").isNotNull(), "name").otherwise(F.col("qid_source")).alias("qid_source")).select(members.columns)


def _picks(pairs: DataFrame, member: str = "ord") -> DataFrame:
    counted = pairs.groupBy(member).agg(
        F.count("*").alias("n"), F.count_if("_agrees").alias("a"), F.count_if("_seated").alias("s"),
        F.min(F.when(F.col("_agrees"), F.col("_q"))).alias("qa"), F.min(F.when(F.col("_seated"), F.col("_q"))).alias("qs"), F.min("_q").alias("q"),
    )
    pick = F.when(F.col("a") == 1, F.col("qa")).when(F.col("a") > 1, None).when(F.col("s") == 1, F.col("qs")).when((F.col("s") == 0) & (F.col("n") == 1), F.col("q"))
    return counted.select(member, pick.alias("_q")).filter("_q IS NOT NULL")


def unresolved_names(members: DataFrame) -> DataFrame:
    """The names to search for, each once, in the order of the rows."""
    names = members.filter(F.col("qid").isNull()).groupBy(text.tidy(F.col("full_name")).alias("name")).agg(F.min("ord").alias("ord"))
    return names.orderBy("ord").select("name")
