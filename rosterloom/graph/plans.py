"""The graph's questions as plans over its tables.

Tables: items (qid, label, birth_date, death_date), identifiers (qid, property, value), properties
(qid, property), parties (qid, party_qid, ended), statements (statement_id, qid, position_qid, rank,
start, end), qualifiers (statement_id, property, value_qid), names (qid, name, origin, lang).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.schema import ITEMS, STATEMENTS
from rosterloom.sources.base import shaped

#: The qualifiers of a seat.
DISTRICT, GROUP, TERM = "P768", "P4100", "P2937"


def with_identifier(items: DataFrame, identifiers: DataFrame, prop: str) -> DataFrame:
    own = identifiers.filter(F.col("property") == prop).select("qid", F.col("value").alias("join_id"))
    return own.join(items, "qid", "left")


def seats(statements: DataFrame, qualifiers: DataFrame, positions: Sequence[str]) -> DataFrame:
    """Each statement for the positions once, deprecated ones left out, its qualifiers as sorted sets.

    Qualifiers are folded before the join, so nothing fans out.
    """
    held = statements.filter(F.col("position_qid").isin(*positions) & (F.coalesce("rank", F.lit("")) != "deprecated"))
    held = held.groupBy("statement_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("qid", "position_qid", "start", "end")])
    of = lambda p, name: F.array_sort(F.collect_set(F.when(F.col("property") == p, F.col("value_qid")))).alias(name)
    own = qualifiers.filter(F.col("property").isin(DISTRICT, GROUP, TERM)).groupBy("statement_id").agg(of(DISTRICT, "districts"), of(GROUP, "groups"), of(TERM, "terms"))
    met = held.join(own, "statement_id", "left")
    none = F.array().cast("array<string>")
    return shaped(met.withColumns({c: F.coalesce(c, none) for c in ("districts", "groups", "terms")}).withColumn("ord", F.xxhash64("statement_id")), STATEMENTS)


def open_parties(parties: DataFrame) -> DataFrame:
    return parties.filter(~F.coalesce("ended", F.lit(False))).select("qid", "party_qid").distinct()


def people(items: DataFrame, identifiers: DataFrame, properties: DataFrame, parties: DataFrame, statements: DataFrame, join_property: str, wanted: Sequence[str]) -> DataFrame:
    """Item rows with all that the rules compare; asked about are items with the join identifier or a seat."""
    values = identifiers.groupBy("qid", "property").agg(F.min("value").alias("value")).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("identifiers"))
    have = properties.filter(F.col("property").isin(*wanted)).groupBy("qid").agg(F.array_sort(F.collect_set("property")).alias("properties"))
    member_of = open_parties(parties).groupBy("qid").agg(F.array_sort(F.collect_set("party_qid")).alias("parties"))
    asked = identifiers.filter(F.col("property") == join_property).select("qid").union(statements.select("qid")).distinct().withColumn("person_data_known", F.lit(True))
    met = items.join(values, "qid", "left").join(have, "qid", "left").join(member_of, "qid", "left").join(asked, "qid", "left")
    return shaped(met.withColumn("join_id", F.try_element_at("identifiers", F.lit(join_property))).withColumn("person_data_known", F.coalesce("person_data_known", F.lit(False))), ITEMS)


def search(names: DataFrame, wanted: DataFrame, items: DataFrame, statements: DataFrame, identifiers: DataFrame, positions: Sequence[str], prop: str) -> DataFrame:
    """Candidates for names: items whose label or alias is exactly the name, with a seat or the
    identifier, and whether they have the seat."""
    hit = wanted.select(text.tidy(F.col("name")).alias("name")).distinct().join(names.select("qid", text.tidy(F.col("name")).alias("name")).distinct(), "name")
    seated = statements.filter(F.col("position_qid").isin(*positions)).select("qid").distinct().withColumn("has_position", F.lit(True))
    known = identifiers.filter(F.col("property") == prop).groupBy("qid").agg(F.min("value").alias("join_id"))
    met = hit.join(seated, "qid", "left").join(known, "qid", "left").filter("has_position OR join_id IS NOT NULL").join(items.select("qid", "label", "birth_date"), "qid", "left")
    return met.select("name", "qid", "label", "birth_date", F.coalesce("has_position", F.lit(False)).alias("has_position"), "join_id")


def name_variants(names: DataFrame, qids: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Aliases and other names of items, in the languages or without one, each (name, origin) once."""
    own = names.filter(F.col("lang").isNull() | F.col("lang").isin(*languages)).join(qids.select("qid").distinct(), "qid", "left_semi")
    return own.dropDuplicates(["qid", "name", "origin"]).select("qid", "name", "origin", "lang")


def coverage(people_: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many of the people have each flag; a row a person goes in."""
    return people_.agg(F.count_distinct("qid").alias("people"), *[F.count_distinct(F.when(c, F.col("qid"))).alias(n) for n, c in flags.items()])


def marginal_gain(identifiers: DataFrame, new: str, old: str) -> DataFrame:
    """How many items have the new identifier and not the old one."""
    has = lambda p: identifiers.filter(F.col("property") == p).select("qid").distinct()
    return has(new).join(has(old), "qid", "left_anti").agg(F.count("*").alias("gain"))


def usage(qualifiers: DataFrame, prop: str, n: int = 60) -> DataFrame:
    """The values of a qualifier by the statements that use them."""
    return qualifiers.filter(F.col("property") == prop).groupBy("value_qid").agg(F.count_distinct("statement_id").alias("statements")).orderBy(F.desc("statements"), "value_qid").limit(n)


def positions_held(statements: DataFrame, qids: DataFrame, n: int = 25) -> DataFrame:
    """The positions that most of the items hold."""
    own = statements.join(qids.select("qid").distinct(), "qid", "left_semi")
    return own.groupBy("position_qid").agg(F.count_distinct("qid").alias("people")).orderBy(F.desc("people"), "position_qid").limit(n)


def model_census(statements: DataFrame, qualifiers: DataFrame, position: str) -> DataFrame:
    """How many people have so many statements and so many terms for a seat."""
    terms = qualifiers.filter(F.col("property") == TERM)
    own = statements.filter(F.col("position_qid") == position).join(terms.select("statement_id", "value_qid"), "statement_id", "left")
    per = own.groupBy("qid").agg(F.count_distinct("statement_id").alias("statements"), F.count_distinct("value_qid").alias("terms"))
    return per.groupBy("statements", "terms").agg(F.count("*").alias("people")).orderBy("statements", "terms")


def escaped(x: Column) -> Column:
    """A text as it stands in a quoted literal of a query."""
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def batches(wanted: DataFrame, column: str, size: int) -> DataFrame:
    """The distinct values in batches of ``size`` in their order, as a reader asks for them: batch and values."""
    from rosterloom.operators.profile import numbered

    own = numbered(wanted.select(column).filter(F.col(column).isNotNull()).distinct(), [column], "_k")
    return own.groupBy(F.floor((F.col("_k") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(column)).alias("values"))


def described(wanted: DataFrame, labels: DataFrame, instances: DataFrame, languages: Sequence[str]) -> DataFrame:
    """qid, label, description and instance_of of each wanted item once, also of those the graph doesn't know.

    ``labels`` has (qid, lang, label, description), of which the first language that has a value counts;
    ``instances`` has (qid, class_label), of which the classes are a sorted set.
    """
    own = wanted.select("qid").filter(F.col("qid").isNotNull()).distinct()
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    best = lambda c: F.min(F.when(F.col(c).isNotNull() & (place > 0), F.struct(place.alias("k"), F.col(c).alias("v"))))["v"].alias(c)
    texts = labels.groupBy("qid").agg(best("label"), best("description"))
    classes = instances.groupBy("qid").agg(F.array_sort(F.collect_set("class_label")).alias("instance_of"))
    met = own.join(texts, "qid", "left").join(classes, "qid", "left")
    return met.withColumn("instance_of", F.coalesce("instance_of", F.array().cast("array<string>")))


def of_class(instances: DataFrame, numbers: DataFrame, class_qid: str) -> DataFrame:
    """The items of a class, with their number where they have one."""
    own = instances.filter(F.col("class_qid") == class_qid).select("qid").distinct()
    return own.join(numbers.groupBy("qid").agg(F.min("number").alias("number")), "qid", "left")


def with_details(wanted: DataFrame, **sides: tuple[DataFrame, str]) -> DataFrame:
    """The wanted items with an optional value from each side, given as (table, column); several values are several rows."""
    out = wanted.select("qid").distinct()
    for name, (table, column) in sides.items():
        out = out.join(table.select("qid", F.col(column).alias(name)).distinct(), "qid", "left")
    return out


def formatter(properties: DataFrame, labels: DataFrame, prop: str, lang: str) -> DataFrame:
    """One row for a property: its formatter address and its label, each where there is one."""
    one = properties.sparkSession.range(1).select(F.lit(prop).alias("property"))
    urls = properties.filter(F.col("property") == prop).groupBy("property").agg(F.min("formatter_url").alias("formatter_url"))
    names = labels.filter((F.col("qid") == prop) & (F.col("lang") == lang)).groupBy(F.col("qid").alias("property")).agg(F.min("label").alias("label"))
    return one.join(urls, "property", "left").join(names, "property", "left")


def open_now(people_: DataFrame, statements: DataFrame, positions: Sequence[str]) -> DataFrame:
    """``people_`` with open: whether any statement for the positions, walked anew, has no end."""
    held = statements.filter(F.col("position_qid").isin(*positions) & F.col("end").isNull()).select("qid").distinct().withColumn("open", F.lit(True))
    return people_.join(held, "qid", "left").withColumn("open", F.coalesce("open", F.lit(False)))
