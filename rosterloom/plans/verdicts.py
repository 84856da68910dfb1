"""What measured counts say about a source: each verdict is one row of counts with CONFIRMED,
CONTRADICTED or INCONCLUSIVE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.operators.profile import CONFIRMED, CONTRADICTED, INCONCLUSIVE, verdict

#: Fewer pairs of dates than this decide nothing.
LEAST_PAIRS = 10
#: The share of judged misses from which one explanation is taken for the whole.
EXPLAINED = 0.85


def judged(df: DataFrame, counts: dict[str, Column | None], *ladder: tuple[Column, str]) -> DataFrame:
    """One row: how many rows meet each condition (None: all rows), and the verdict of the ladder."""
    row = df.agg(*[(F.count("*") if x is None else F.count_if(F.coalesce(x, F.lit(False)))).alias(n) for n, x in counts.items()])
    return row.withColumn("verdict", verdict(*ladder))


def start_dates(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Start dates of two sources: in how many pairs they agree, and which side the others lean to."""
    a, b = F.col(ours), F.col(theirs)
    known = a.isNotNull() & b.isNotNull()
    counts = {"pairs": known, "agree": known & (a == b), "ours_earlier": known & (a < b), "ours_later": known & (a > b), "first_of_january": known & (F.dayofyear(a) == 1)}
    return judged(pairs, counts, (F.col("pairs") < LEAST_PAIRS, INCONCLUSIVE), (F.col("agree") < F.col("pairs"), CONTRADICTED))


def dated_column(df: DataFrame, column: str) -> DataFrame:
    """Whether a column is there and filled: absent is inconclusive, present and empty contradicted."""
    has = column in df.columns
    filled = text.blank_to_null(F.col(column).cast("string")).isNotNull() if has else F.lit(False)
    out = judged(df, {"n_rows": None, "filled": filled}, (F.lit(not has) | (F.col("n_rows") == 0), INCONCLUSIVE), (F.col("filled") == 0, CONTRADICTED), (F.col("filled") < F.col("n_rows"), INCONCLUSIVE))
    return out.withColumn("present", F.lit(has))


def seat_count(members: DataFrame, person: str, seats: int) -> DataFrame:
    """Whether as many people sit as the chamber has seats."""
    row = members.agg(F.count_distinct(person).alias("people"))
    return row.withColumn("seats", F.lit(seats).cast("bigint")).withColumn("verdict", verdict((F.col("people") == 0, INCONCLUSIVE), (F.col("people") != F.col("seats"), CONTRADICTED)))


def identifier_gain(people: DataFrame, ours: str, other: str) -> DataFrame:
    """How many people have each identifier, either, and the other one alone."""
    a, b = text.blank_to_null(F.col(ours)).isNotNull(), text.blank_to_null(F.col(other)).isNotNull()
    return judged(people, {"people": None, "ours": a, "other": b, "either": a | b, "gained": b & ~a}, (F.col("people") == 0, INCONCLUSIVE), (F.col("gained") == 0, CONTRADICTED))


def identifier_values(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Expected values against those on the graph: agree, differ, absent."""
    e = expected.select(key, text.id_normal(F.col(value)).alias("_e"))
    a = actual.select(F.col(key).alias("_k"), text.id_normal(F.col(value)).alias("_a")).distinct()
    met = e.join(a, F.col(key) == F.col("_k"), "left").groupBy(key, "_e").agg(F.bool_or(F.col("_a") == F.col("_e")).alias("hit"), F.count("_a").alias("n"))
    counts = {"people": None, "agree": F.col("hit"), "differ": (F.col("n") > 0) & ~F.coalesce("hit", F.lit(False)), "absent": F.col("n") == 0}
    return judged(met, counts, (F.col("agree") + F.col("differ") == 0, INCONCLUSIVE), (F.col("differ") > 0, CONTRADICTED))


def misses(rows: DataFrame, reason: str) -> DataFrame:
    """Whether one reason explains the misses; rows without a reason aren't judged."""
    n = rows.groupBy(reason).agg(F.count("*").alias("n"))
    top = n.filter(F.col(reason).isNotNull()).agg(F.sum("n").alias("judged"), F.max("n").alias("most"), F.max_by(reason, "n").alias("reason"))
    return top.withColumn("verdict", verdict((F.coalesce("judged", F.lit(0)) == 0, INCONCLUSIVE), (F.col("most") < EXPLAINED * F.col("judged"), INCONCLUSIVE)))


#: The share of people that have to agree, in percent, for a column and a property to be one kind of number.
AGREEING = 85
#: Misses that say something of the match by name, not of the identifier.
ARTEFACTS = ("different person", "ambiguous name", "no value in export")


def miss_verdict(found: DataFrame, matched: Column) -> DataFrame:
    """What misses (``reason`` as ``miss_reasons`` gives it) mean for joining on an identifier, ``matched`` being the people compared: without
    values that differ all is explained unless some people can't be decided; with some, the share that agrees decides whether both
    sides hold one kind of number."""
    n = lambda c, name: F.count_if(c).alias(name)
    reason = F.col("reason")
    row = found.agg(n(reason == "value differs", "differ"), n(reason.isin(*ARTEFACTS), "artefacts"), n(reason == "undecided", "undecided")).withColumn("matched", matched.cast("bigint"))
    row = row.withColumn("agree", F.col("matched") - F.col("differ") - F.col("artefacts") - F.col("undecided"))
    enough = 100 * F.col("agree") >= AGREEING * F.col("matched")
    return row.withColumn("verdict", verdict(((F.col("differ") > 0) & ~enough, CONTRADICTED), ((F.col("differ") == 0) & (F.col("undecided") > 0), INCONCLUSIVE)))


def described(id_: Column, body: Column, *names: tuple[str, Column]) -> Column:
    """A row as one line: its id, its body if it has one, and the first of its names that is filled."""
    quoted = lambda name, x: F.concat(F.lit(f"{name}='"), x.cast("string"), F.lit("'"))
    first = [F.when(text.blank_to_null(x.cast("string")).isNotNull(), quoted(name, x)) for name, x in names]
    return F.concat_ws(", ", F.concat(F.lit("id="), F.coalesce(id_.cast("string"), F.lit("None"))), F.when(body.isNotNull(), quoted("body_key", body)), *([F.coalesce(*first)] if first else []))


def labels(source: DataFrame, used: DataFrame, name: str, label: str) -> DataFrame:
    """Source names matched with labels in use, as they are and then without a leading numeral; unique
    matches only. Columns: name, label, how (exact, numeral, unmatched) and, for labels nothing took, unused."""
    bare = lambda x: F.regexp_replace(text.folded(x), r"^([ivxlc]+|\d+)\s+", "")
    s = source.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    u = used.select(F.col(label).alias("label")).filter("label IS NOT NULL").distinct()

    def unique(key) -> DataFrame:
        return u.groupBy(key(F.col("label")).alias("_k")).agg(F.min("label").alias("_l"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")

    exact, short = unique(text.folded), unique(bare).withColumnsRenamed({"_k": "_k2", "_l": "_l2"})
    met = s.join(exact, text.folded(F.col("name")) == F.col("_k"), "left").join(short, bare(F.col("name")) == F.col("_k2"), "left")
    met = met.select("name", F.coalesce("_l", "_l2").alias("label"), F.when(F.col("_l").isNotNull(), "exact").when(F.col("_l2").isNotNull(), "numeral").otherwise("unmatched").alias("how"))
    spare = u.join(met.select(F.col("label").alias("_m")).filter("_m IS NOT NULL").distinct(), F.col("label") == F.col("_m"), "left_anti")
    return met.unionByName(spare.select(F.lit(None).cast("string").alias("name"), "label", F.lit("unused").alias("how")))


def yaml_block(df: DataFrame, key: str, value: str) -> DataFrame:
    """Lines of a configuration block, in the order of the keys."""
    return df.orderBy(key).select(F.concat(F.lit('  "'), F.replace(F.col(key), F.lit('"'), F.lit('\\"')), F.lit('": '), F.col(value)).alias("value"))


def source_identifier(rows: DataFrame, expected: int, number: str = "PersonNumber", code: str = "PersonIdCode", errors: int = 0) -> DataFrame:
    """Which of a person's two numbers is the identifier: the first confirms, the second or neither contradicts; with no
    rows nothing was tested."""
    hit = lambda c: F.coalesce(F.max((F.col(c) == expected).cast("int")), F.lit(0)) == 1
    row = rows.agg(F.count("*").alias("n_rows"), hit(number).alias("in_number"), hit(code).alias("in_code"))
    meaning = F.when(F.col("n_rows") == 0, "tables failed" if errors else "no such person").when(F.col("in_number"), number).when(F.col("in_code"), code).otherwise("neither")
    return row.withColumn("meaning", meaning).withColumn("verdict", verdict((F.col("n_rows") == 0, INCONCLUSIVE), (~F.col("in_number"), CONTRADICTED)))


def count_agreement(df: DataFrame, column: str) -> DataFrame:
    """Whether every row has a value in a column that is known to exist."""
    return judged(df, {"total": None, "filled": F.col(column).isNotNull()}, (F.col("total") == 0, INCONCLUSIVE), (F.col("filled") < F.col("total"), CONTRADICTED))


def first_variant(results: DataFrame, order: str, label: str, count: str, least: int = 1) -> DataFrame:
    """Of search variants tried in order the first that found enough; a null count is an error, no row at all no variant."""
    return results.agg(F.min_by(label, F.when(F.col(count) >= least, F.col(order))).alias("winner"), F.count_if(F.col(count).isNull()).alias("errors"), F.count_if(F.col(count) < least).alias("empty"))


def link_coverage(people: DataFrame, own: str, party: str) -> DataFrame:
    """How many people link to the graph and to a party there, with the shares in percent."""
    filled = lambda c: F.count_if(text.blank_to_null(F.col(c).cast("string")).isNotNull())
    row = people.agg(F.count("*").alias("people"), filled(own).alias("linked"), filled(party).alias("with_party"))
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.col(c), F.col("people")), F.lit(0.0)), 1)
    return row.withColumns({"linked_share": share("linked"), "party_share": share("with_party")})


def graph_reach(holders: DataFrame, own: str, mirror: str, other: str) -> DataFrame:
    """Which identifier joins a chamber's holders: its own before a mirror's, a foreign service's never. A row a holder goes in."""
    has = lambda c: text.blank_to_null(F.col(c).cast("string")).isNotNull()
    counts = {"holders": None, "with_own": has(own), "with_mirror": has(mirror), "with_other": has(other), "with_any": has(own) | has(mirror) | has(other)}
    row = judged(holders, counts, (F.col("holders") == 0, INCONCLUSIVE), ((F.col("with_own") == 0) & (F.col("with_mirror") == 0), CONTRADICTED))
    joins = F.when(F.col("with_own") > 0, own).when(F.col("with_mirror") > 0, mirror)
    broad = F.coalesce(100 * F.col("with_any") >= 50 * F.col("holders"), F.lit(False))
    return row.withColumn("joined_by", joins).withColumn("reach", F.when(joins.isNull(), "none").when(F.col("with_own") > 0, "own").when(broad, "most").otherwise("some"))


def position_item(statements: DataFrame, position: str, seats: int) -> DataFrame:
    """Whether an item is the seat: nobody holds it, or more hold it openly than there are seats: it isn't."""
    held = statements.filter(F.col("position_qid") == position)
    row = held.agg(F.count_distinct("qid").alias("holders"), F.count_distinct(F.when(F.col("end").isNull(), F.col("qid"))).alias("open_holders"))
    ladder = ((F.col("holders") == 0, CONTRADICTED), (F.col("open_holders") > seats, CONTRADICTED), (F.col("open_holders") == 0, INCONCLUSIVE))
    return row.withColumn("seats", F.lit(seats).cast("bigint")).withColumn("verdict", verdict(*ladder))


def qualifier_readiness(source: DataFrame, used: DataFrame, name: str, label: str, holders: int) -> DataFrame:
    """Whether the graph uses a qualifier for the source's values: unused is no practice, used without a match is another thing."""
    known = used.select(text.folded(F.col(label)).alias("_l")).filter("_l IS NOT NULL").distinct().withColumn("_u", F.lit(True))
    own = source.select(text.folded(F.col(name)).alias("_n")).filter("_n IS NOT NULL").distinct().join(known, F.col("_n") == F.col("_l"), "left")
    row = own.agg(F.count("*").alias("source_values"), F.count("_u").alias("matched")).join(known.agg(F.count("*").alias("used")), how="cross")  # one row each
    row = row.withColumn("holders", F.lit(holders).cast("bigint"))
    return row.withColumn("verdict", verdict((F.col("holders") == 0, INCONCLUSIVE), (F.col("used") == 0, INCONCLUSIVE), (F.col("matched") == 0, CONTRADICTED)))


#: What a column of keys is called.
ID_HINTS = ("guid", "id", "nummer", "number", "key")
#: An export's columns for identifiers, and their properties.
IDENTIFIER_COLUMNS = {"gnd": "P227", "viaf": "P214", "hls": "P902"}


def id_columns(columns: list[str]) -> list[str]:
    """Columns that look like identifiers: a segment of the name is a word for a key, or it ends with one."""
    return [c for c in columns if any(part == h or (len(h) > 2 and part.endswith(h)) for part in c.lower().split("_") for h in ID_HINTS)]


def joinability(df: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """Whether anything in a source could join with the graph: a row for each column that looks like a key, with its filled and
    its distinct values and how many of those the graph holds (``known``, normalised), and the verdict over all of them. No
    key-like column, or only empty ones, decides nothing; keys of the source's own make, which no property holds, say no."""
    found = id_columns(df.columns)
    if not found:
        return df.limit(0).select(*[F.lit(None).cast(k).alias(n) for n, k in (("column_name", "string"), ("filled", "bigint"), ("keys", "bigint"), ("known", "bigint"), ("verdict", "string"))])
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in found]).unpivot([], found, "column_name", "cell").withColumn("cell", text.id_normal(F.col("cell")))
    keys = cells.groupBy("column_name", "cell").agg(F.count("*").alias("n"))
    held = known.select(text.id_normal(F.col(value)).alias("_v")).filter("_v <> ''").distinct()
    met = keys.join(held, F.col("cell") == F.col("_v"), "left")
    filled = F.coalesce(F.col("cell") != "", F.lit(False))
    own = met.groupBy("column_name").agg(F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"), F.count_if(filled).alias("keys"), F.count("_v").alias("known"))
    return own.withColumn("verdict", verdict((F.col("filled") == 0, INCONCLUSIVE), (F.col("known") == 0, CONTRADICTED)))


def identifier_columns(columns: list[str]) -> dict[str, str]:
    """The columns of an export that hold a known identifier, with its property."""
    return {c: IDENTIFIER_COLUMNS[c.lower()] for c in columns if c.lower() in IDENTIFIER_COLUMNS}


def property_coverage(members: DataFrame, candidates: list[str]) -> DataFrame:
    """What a source says for one check: filled for somebody, no such column, or a column that is empty for all."""
    have = [c for c in candidates if c in members.columns]
    some = F.lit(False)
    for c in have:
        some = some | text.blank_to_null(F.col(c).cast("string")).isNotNull()
    row = judged(members, {"members": None, "covered": some}, (F.col("covered") > 0, CONFIRMED), (F.lit(not have), CONTRADICTED), (F.lit(True), INCONCLUSIVE))
    return row.withColumn("columns", F.lit(", ".join(have)))


def volume_note(found: Column, members: Column, covered: Column) -> Column:
    """What a number of findings means for a chamber."""
    share = F.coalesce(F.try_divide(100 * found, members), F.lit(0.0))
    return F.when((found == 0) & (covered == 0), "not compared").when(found == 0, "nothing to do").when(share >= 50, "bulk worklist").otherwise("clean-up")


def findings_by_property(found: DataFrame) -> DataFrame:
    """Findings of missing person data for each property."""
    return found.filter("kind = 'ADD_PERSON_DATA'").groupBy(F.coalesce("payload.property", F.lit("?")).alias("property")).agg(F.count("*").alias("n"))


def configured(config, bodies: dict[str, str]) -> list[tuple[str, str, str]]:
    """(kind, key, item) of everything a configuration names."""
    maps = {"position": bodies, "constituency": config.constituencies, "parl_group": config.parl_groups, "party": config.parties, "term": {str(k): v for k, v in config.terms.items()}}
    return [(kind, key, qid) for kind, own in maps.items() for key, qid in sorted(own.items())]


def config_items(spark, named: list[tuple[str, str, str]], described: DataFrame) -> DataFrame:
    """Each configured item with its label and classes, and whether it resolves; ``described`` as ``graph.plans.described`` gives it."""
    rows = spark.createDataFrame(named, "kind string, key string, qid string")
    met = rows.join(described, "qid", "left")
    return met.select("kind", "key", "qid", "label", F.array_join("instance_of", ", ").alias("instance_of"), text.blank_to_null(F.col("label")).isNotNull().alias("resolves"))


def tenure_dates(members: DataFrame, council: str, joined: str, left: str) -> DataFrame:
    """For each council: members, distinct, first and last starts, whether all starts are a first of January, members
    without a start, and members who sit and yet have an end."""
    s = F.col(joined)
    return members.groupBy(council).agg(
        F.count("*").alias("members"), F.count_distinct(s).alias("starts"), F.min(s).alias("first_start"), F.max(s).alias("last_start"),
        F.coalesce(F.bool_and(F.when(s.isNotNull(), F.dayofyear(s) == 1)), F.lit(False)).alias("all_first_of_january"), F.count_if(s.isNull()).alias("undated"), F.count_if(F.col(left).isNotNull()).alias("with_end"),
    )


def miss_reasons(wanted: DataFrame, export: DataFrame, name: str, value: str, born: str | None = None) -> DataFrame:
    """Why a name matched an export and its identifier didn't: name, value, held (the export's values) and reason. Names that the
    export hasn't, and values that it holds, are no misses."""
    birth = F.min(F.col(born)) if born else F.min(F.lit(None).cast("date"))
    rows = export.groupBy(F.col(name).alias("_n")).agg(F.array_sort(F.collect_set(text.blank_to_null(F.col(value).cast("string")))).alias("held"), birth.alias("_born"))
    met = wanted.join(rows, F.col(name) == F.col("_n")).withColumn("_v", F.trim(F.col(value).cast("string"))).filter(~F.array_contains("held", F.col("_v")))
    theirs = F.col(born) if born and born in wanted.columns else F.lit(None).cast("date")
    reason = (
        F.when(F.size("held") > 1, "ambiguous name").when(F.size("held") == 0, "no value in export").when(theirs.isNull() | F.col("_born").isNull(), "undecided")
        .when(theirs != F.col("_born"), "different person").otherwise("value differs")
    )
    return met.select(name, F.col("_v").alias("value"), "held", reason.alias("reason"))


def same_source_pairs(members: DataFrame, items: DataFrame, statements: DataFrame, spans: DataFrame) -> DataFrame:
    """Sitting members with the start that the graph and the second source give: qid, ours, graph, other."""
    ids = items.select(text.id_normal(F.col("join_id")).alias("_id"), F.col("qid").alias("_q")).filter("_id <> ''").groupBy("_id").agg(F.min("_q").alias("_q"), F.count("*").alias("_n")).filter("_n = 1")
    own = members.filter("active").select(text.id_normal(F.col("person_key")).alias("_k"), F.coalesce("tenure_start", "date_joining").alias("ours")).join(ids, F.col("_k") == F.col("_id"))
    graph = statements.filter("end IS NULL").groupBy("qid").agg(F.max("start").alias("graph"))
    other = spans.groupBy("qid").agg(F.max("start").alias("other"))
    met = own.join(graph, F.col("_q") == graph["qid"], "left").drop("qid")
    return met.join(other, F.col("_q") == other["qid"], "left").select(F.col("_q").alias("qid"), "ours", "graph", "other")


__all__ = ["CONFIRMED", "CONTRADICTED", "INCONCLUSIVE", "config_items", "configured", "count_agreement", "dated_column", "findings_by_property", "first_variant", "graph_reach", "id_columns", "identifier_columns", "identifier_gain", "identifier_values", "joinability", "judged", "labels", "link_coverage", "described", "miss_reasons", "miss_verdict", "misses", "position_item", "property_coverage", "qualifier_readiness", "same_source_pairs", "seat_count", "source_identifier", "start_dates", "tenure_dates", "volume_note", "yaml_block"]
