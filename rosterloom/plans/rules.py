"""Members against items, in both directions, as typed findings.

Each pass is one select: a row yields an array of candidate findings, those whose condition holds
are kept and exploded, so no pass reads or joins its input once a rule. Findings are ordered by
priority and folded label; ties keep the order in which they arise (step, row, rule).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.config import PERIOD, Config
from rosterloom.functions import text
from rosterloom.functions.dates import date_text, time_literal
from rosterloom.operators import dedup, intervals
from rosterloom.schema import FINDINGS, MECHANICAL, OTHER_PRIORITY, PAYLOAD, PRIORITY, QUALIFIER_ONLY

_FIELDS = [tuple(x.strip().split(" ", 1)) for x in re.split(r",\s*(?![^<]*>)", PAYLOAD)]


def payload(**given: Column | str) -> Column:
    """A payload struct; fields that aren't given are null."""
    assert set(given) <= {n for n, _ in _FIELDS}
    return F.struct(*[(given[n] if isinstance(given.get(n), Column) else F.lit(given.get(n))).cast(k).alias(n) for n, k in _FIELDS])


def rule(when: Column, kind: str, detail: Column, **given) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), payload(**given).alias("payload")))


def _found(rows: DataFrame, step: int, at: Column, rules: Sequence[Column], **who: Column) -> DataFrame:
    """The findings of the rules on rows; ``who`` are the columns that don't depend on the rule."""
    numbered = [F.struct(F.lit(k).alias("nth"), r.alias("f")) for k, r in enumerate(rules)]
    own = {c: who.get(c, F.lit(None).cast("string")) for c in FINDINGS if c not in ("kind", "step", "at", "nth", "detail", "payload")}
    long = rows.select(at.cast("long").alias("at"), *[x.alias(c) for c, x in own.items()], F.explode(F.filter(F.array(*numbered), lambda x: x["f"].isNotNull())).alias("x"))
    return long.select(F.col("x.f.kind").alias("kind"), F.lit(step).alias("step"), F.col("x.nth").alias("nth"), F.col("x.f.detail").alias("detail"), F.col("x.f.payload").alias("payload"), "at", *own).select(*FINDINGS)


def _member(c: str = "") -> dict[str, Column]:
    return {"council": F.col("council"), "member_label": F.col("full_name"), "person_key": F.col("person_key"), "person_qid": F.col("qid"), "qid_source": F.col("qid_source"), "constituency": F.col("constituency"), "parl_group": F.col("parl_group")}


def _checked(x: Column) -> Column:
    """A detail, with a request to confirm a match that was made by name."""
    return F.concat(x, F.when(F.col("qid_source") == "name", " (matched by name: confirm the person)").otherwise(""))


def start_date() -> Column:
    return F.coalesce("tenure_start", "date_joining")


def expected(members: DataFrame, periods: DataFrame, config: Config) -> DataFrame:
    """``members`` with the statements they should have: exp, an array of (start, end, terms).

    The periods are a small dimension and come as one row, so members are neither shuffled nor repeated.
    """
    known = periods.select(F.struct("number", "start", "end", config.term(F.col("number")).alias("term")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("_periods"))
    s, e = start_date(), F.col("date_leaving")
    covered = F.filter("_periods", lambda p: intervals.covers(s, e, p["start"], p["end"]))
    terms = lambda ps: F.array_distinct(F.filter(F.transform(ps, lambda p: p["term"]), lambda t: t.isNotNull()))
    row = lambda a, b, t, lo, hi: F.struct(a.alias("start"), b.alias("end"), t.alias("terms"), lo.alias("p_start"), hi.alias("p_end"))
    if config.statement_model == PERIOD:
        def one(p):
            a, b = intervals.clip(s, e, p["start"], p["end"])
            return row(a, b, terms(F.array(p)), p["start"], p["end"])

        exp = F.transform(covered, one)
    else:
        none = F.lit(None).cast("date")
        exp = F.array(row(s, e, terms(covered), none, none))
    return members.join(F.broadcast(known), how="cross").withColumn("exp", exp).drop("_periods")


def _held(statements: DataFrame, body: dict) -> DataFrame:
    return statements.filter(F.col("position_qid") == body["position_qid"])


def _consumed(exp: Column, held: Column) -> Column:
    """For each expected statement in turn the place of the one of ``held`` that it takes, or null: by a shared term,
    else by overlapping dates, else a lone undated one. A fold within the row: what is left and what was taken."""
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    undated = lambda h: h["start"].isNull() & h["end"].isNull()

    def step(acc: Column, want: Column) -> Column:
        left = acc["left"]
        first = lambda fits: F.get(F.transform(F.filter(left, fits), lambda h: h["at"]), 0)
        shared = first(lambda h: F.coalesce(F.arrays_overlap(listed(h["terms"]), listed(want["terms"])), F.lit(False)))
        dated = first(lambda h: ~undated(h) & intervals.overlaps(h["start"], h["end"], want["p_start"], want["p_end"]))
        lone = F.when(F.size(left) == 1, first(undated))
        pick = F.coalesce(shared, dated, lone)
        return F.struct(F.filter(left, lambda h: pick.isNull() | (h["at"] != pick)).alias("left"), F.concat(acc["taken"], F.array(pick)).alias("taken"))

    places = F.transform(held, lambda h, k: F.struct(k.alias("at"), h["start"].alias("start"), h["end"].alias("end"), h["terms"].alias("terms")))
    return F.aggregate(exp, F.struct(places.alias("left"), F.array().cast("array<int>").alias("taken")), step, lambda acc: acc["taken"])


def matched(members: DataFrame, statements: DataFrame, config: Config, body: dict) -> DataFrame:
    """A row for each matched member and expected statement, with the statement that fills it (its
    columns prefixed with s_) or nulls, and how many statements the member has for the seat."""
    held = _held(statements, body)
    count = held.groupBy("qid").agg(F.count("*").alias("n_statements")).withColumnRenamed("qid", "_cq")
    own = members.filter(F.col("qid").isNotNull()).join(count, F.col("qid") == F.col("_cq"), "left").drop("_cq")
    columns = held.select([F.col(c).alias(f"s_{c}") for c in held.columns])
    if config.statement_model != PERIOD:
        best = dedup.top1(columns, ["s_qid"], [F.col("s_end").isNull().desc(), F.col("s_start").desc_nulls_last(), F.col("s_ord")])
        return own.withColumn("e", F.col("exp")[0]).withColumn("k", F.lit(0)).join(best, F.col("qid") == F.col("s_qid"), "left")
    # the statements of an item for one seat, in order, with all their columns: what a row takes needs no second join
    lists = columns.groupBy("s_qid").agg(F.array_sort(F.collect_list(F.struct("s_ord", "s_statement_id", *[c for c in columns.columns if c not in ("s_ord", "s_statement_id")]))).alias("_held")).withColumnRenamed("s_qid", "_lq")
    plain = F.transform("_held", lambda h: F.struct(h["s_start"].alias("start"), h["s_end"].alias("end"), h["s_terms"].alias("terms")))
    rows = own.join(lists, F.col("qid") == F.col("_lq"), "left").withColumn("_taken", _consumed(F.col("exp"), F.coalesce(plain, F.array())))
    rows = rows.select("*", F.posexplode("exp").alias("k", "e")).withColumn("_s", F.get("_held", F.get("_taken", F.col("k"))))
    return rows.select(*own.columns, "k", "e", *[F.col("_s").getField(c).alias(c) for c in columns.columns])


def statement_findings(rows: DataFrame, config: Config, body: dict, today: Column) -> DataFrame:
    """What the rows of ``matched`` lack or contradict."""
    c = F.col
    exp_start, exp_end, terms = c("e.start"), c("e.end"), c("e.terms")
    district, group = config.constituency(c("constituency")), config.parl_group(c("parl_group"))
    has = c("s_statement_id").isNotNull()
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    no_district, no_group = (q.isNotNull() & ~F.array_contains(listed(have), q) for q, have in ((district, c("s_districts")), (group, c("s_groups"))))
    missing = F.array_except(terms, listed(c("s_terms")))
    several = F.when(c("n_statements") > 1, True)
    ended = has & c("active") & c("s_end").isNotNull() & (c("s_end") <= today) & exp_end.isNull()
    common = {"biography": config.biography(c("person_key")), "statement_id": c("s_statement_id"), "ambiguous_statement": several}
    position = body["position_qid"]
    dated = lambda label, d: _checked(F.concat(F.lit(label), date_text(d)))
    rules = [
        rule(~has, "ADD_MEMBERSHIP", dated("no statement for this seat; held since ", exp_start), position=position, start=exp_start, end=exp_end, district=district, group=group, terms=terms, biography=common["biography"]),
        rule(ended, "REVIEW_ENDED", dated("sitting, but the statement ended on ", c("s_end")), **common),
        rule(has & ~F.coalesce(ended, F.lit(False)) & c("s_end").isNull() & exp_end.isNotNull(), "ADD_END_DATE", dated("the statement is open; the seat ended on ", exp_end), position=position, end=exp_end, terms=terms, **common),
        rule(has & c("s_start").isNull() & exp_start.isNotNull(), "ADD_START_DATE", dated("the statement has no start; the seat began on ", exp_start), position=position, start=exp_start, terms=terms, **common),
        rule(has & (c("s_start") != exp_start), "FIX_START_DATE", _checked(F.concat(F.lit("the statement starts on "), date_text(c("s_start")), F.lit(", the seat on "), date_text(exp_start))), position=position, start=exp_start, wikidata_start=c("s_start"), **common),
        rule(has & (F.size(missing) > 0), "ADD_TERM", _checked(F.concat(F.lit("missing terms: "), F.array_join(missing, ", "))), position=position, terms=missing, **common),
        rule(has & (no_district | no_group), "ADD_QUALIFIER", _checked(F.concat(F.lit("missing qualifiers: "), F.concat_ws(", ", F.when(no_district, F.concat(F.lit("P768 "), district)), F.when(no_group, F.concat(F.lit("P4100 "), group))))), position=position, district=F.when(no_district, district), group=F.when(no_group, group), terms=terms, **common),
    ]
    return _found(rows, 0, c("ord") * 1000 + 100 + c("k"), rules, **_member())


def _values(column: str, kind: T.DataType) -> Column:
    """A member's value as a list of strings; zero and blanks say nothing."""
    x = F.col(column)
    if isinstance(kind, T.ArrayType):
        out = F.transform(x, lambda v: F.trim(v.cast("string")))
    elif isinstance(kind, T.IntegralType):
        out = F.when(x > 0, F.array(x.cast("string")))
    else:
        out = F.array(F.trim(x.cast("string")))
    return F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def item_findings(members: DataFrame, items: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Findings about identifiers, and about party and person data, of matched members."""
    c = F.col
    facts = items.select(c("qid").alias("i_qid"), "join_id", "identifiers", "parties", "properties", "person_data_known")
    rows = members.filter(c("qid").isNotNull()).join(facts, c("qid") == c("i_qid"), "left")
    blank = lambda x: text.blank_to_null(x).isNull()
    bio = config.biography(c("person_key"))
    rules = []
    for p in (config.identifier_property, *config.other_identifiers):
        if p == config.identifier_property and config.identifier_from_source:
            rules.append(rule((c("qid_source") == "name") & blank(c("join_id")), "ADD_IDENTIFIER", _checked(F.concat(F.lit(f"add {p} "), c("person_key"))), property=p, parliament_id=c("person_key"), biography=bio))
        else:
            rules.append(rule(blank(F.try_element_at(c("identifiers"), F.lit(p))), "MISSING_IDENTIFIER", _checked(F.lit(f"no {p}; its value has to be looked up")), property=p, biography=bio))
    before = _found(rows, 0, c("ord") * 1000, rules, **_member()) if rules else None
    party, parties = config.party(c("party")), F.coalesce(c("parties"), F.array().cast("array<string>"))
    detail = F.when(F.size(parties) == 0, F.concat(F.lit("no open party; the source has "), party)).otherwise(F.concat(F.lit("open parties "), F.array_join(parties, ", "), F.lit("; the source has "), party))
    rules = [rule(party.isNotNull() & ~F.array_contains(parties, party), "REVIEW_PARTY", _checked(detail), party=party, biography=bio)]
    for check in config.person_data:
        values = _values(check.column, members.schema[check.column].dataType)
        absent = ~F.array_contains(F.coalesce(c("properties"), F.array().cast("array<string>")), check.property_id)
        compared = party.isNotNull() if check.property_id == "P102" else F.lit(False)
        rules.append(rule(c("person_data_known") & absent & ~compared & (F.size(values) > 0), "ADD_PERSON_DATA", _checked(F.concat(F.lit(f"no {check.label} ({check.property_id}); the source has "), F.array_join(values, ", "))), property=check.property_id, values=values, biography=bio))
    return before, _found(rows, 0, c("ord") * 1000 + 900, rules, **_member())


def unmatched_findings(members: DataFrame, config: Config) -> DataFrame:
    """Identifiers that several items claim, and members without any item."""
    c = F.col
    conflict = F.size("duplicate_qids") > 0
    bio = config.biography(c("person_key"))
    rules = [
        rule(conflict, "DUPLICATE_IDENTIFIER", F.concat(F.lit(f"{config.identifier_property} "), c("person_key"), F.lit(" is claimed by "), F.array_join("duplicate_qids", ", ")), duplicate_qids=c("duplicate_qids"), parliament_id=c("person_key"), biography=bio),
        rule(~conflict & c("qid").isNull(), "NO_WIKIDATA_ITEM", F.lit("no item was found by identifier or by name"), biography=bio),
    ]
    return _found(members, 0, c("ord") * 1000 - 1, rules, **_member())


def disagreements(members: DataFrame, spans: DataFrame, config: Config) -> DataFrame:
    """Members whose seat a second source describes otherwise; what only one source knows is a gap."""
    c = F.col
    other = spans.select(c("qid").alias("o_qid"), F.upper("council").alias("o_council"), c("start").alias("o_start"), c("end").alias("o_end"), c("person_ids").alias("o_ids"))
    rows = members.join(other, (c("qid") == c("o_qid")) & (F.upper("council") == c("o_council")))
    s = start_date()
    kinds = F.array_compact(F.array(
        F.when(s != c("o_start"), F.concat(F.lit("starts "), date_text(s), F.lit(" and "), date_text(c("o_start")))),
        F.when(c("active") & c("date_leaving").isNull() & c("o_end").isNotNull() & (s.isNull() | (c("o_end") >= s)), F.concat(F.lit("sitting, but closed on "), date_text(c("o_end")))),
        F.when(c("date_leaving").isNotNull() & c("o_end").isNull(), F.concat(F.lit("left on "), date_text(c("date_leaving")), F.lit(", but open"))),
    ))
    rules = [rule(F.size("_kinds") > 0, "SOURCES_DISAGREE", _checked(F.concat(F.lit("the sources disagree: "), F.array_join("_kinds", "; "))), sources_disagree=F.lit(True), start=s, other_start=c("o_start"), other_end=c("o_end"), other_person_ids=c("o_ids"), biography=config.biography(c("person_key")))]
    return _found(rows.withColumn("_kinds", kinds), 0, c("ord") * 1000 + 999, rules, **_member())


def stamped(found: DataFrame, disputed: DataFrame, config: Config) -> DataFrame:
    """Findings of matched members with the doubts that keep them from being applied."""
    if not config.identifier_verified:
        found = found.withColumn("payload", F.col("payload").withField("identifier_unverified", F.when(F.col("person_qid").isNotNull(), True)))
    marks = disputed.select(F.col("person_qid").alias("_dq"), F.upper("council").alias("_dc")).distinct()
    met = found.join(marks, (F.col("person_qid") == F.col("_dq")) & (F.upper("council") == F.col("_dc")), "left")
    return met.withColumn("payload", F.col("payload").withField("sources_disagree", F.when(F.col("_dq").isNotNull(), True).otherwise(F.col("payload.sources_disagree")))).select(*FINDINGS)


def reverse_findings(members: DataFrame, items: DataFrame, statements: DataFrame, tenures: DataFrame, conflicts: DataFrame, config: Config, body: dict) -> list[DataFrame]:
    """The graph's side: source links and identifiers that collide, and people it still has as sitting."""
    c = F.col
    council = F.lit(body["council"])
    own = conflicts.filter(F.upper("council") == body["council"].upper())
    link = _found(own, 1, F.lit(0), [rule(F.lit(True), "DUPLICATE_SOURCE_LINK", F.concat(F.lit("source records "), F.array_join(F.transform("person_ids", lambda x: x.cast("string")), ", "), F.lit(" name one item")), wikidata_qid=c("qid"), source_person_ids=c("person_ids"))], council=council, member_label=F.concat("qid", F.lit(" ("), F.size("person_ids").cast("string"), F.lit(" source records)")), person_qid=c("qid"))
    held = _held(statements, body)
    holders = items.join(held.select(c("qid").alias("_h")).distinct(), c("qid") == c("_h"), "left_semi").withColumn("join_id", text.blank_to_null(c("join_id")))
    reported = members.filter(F.size("duplicate_qids") > 0).select(c("person_key").alias("_p")).distinct()
    claims = holders.filter(c("join_id").isNotNull()).groupBy("join_id").agg(F.array_sort(F.collect_set(F.struct("qid", F.coalesce("label", "qid").alias("label")))).alias("own")).filter(F.size("own") > 1)
    claims = claims.join(reported, c("join_id") == c("_p"), "left_anti")
    labels = F.array_join(F.transform("own", lambda x: F.concat(x["label"], F.lit(" ("), x["qid"], F.lit(")"))), ", ")
    orphan = _found(claims, 2, F.lit(0), [rule(F.lit(True), "DUPLICATE_IDENTIFIER", F.concat(F.lit(f"{config.identifier_property} "), c("join_id"), F.lit(" is claimed by "), labels), duplicate_qids=F.transform("own", lambda x: x["qid"]), parliament_id=c("join_id"), biography=config.biography(c("join_id")))], council=council, member_label=labels)
    active = members.filter("active")
    left = holders.join(active.select(c("qid").alias("_q")).filter("_q IS NOT NULL").distinct(), c("qid") == c("_q"), "left_anti")
    left = left.join(active.select(c("person_key").alias("_k")).filter("_k IS NOT NULL").distinct(), c("join_id") == c("_k"), "left_anti")
    first = dedup.top1(held.filter(c("end").isNull()).select(c("qid").alias("s_qid"), c("ord").alias("s_ord"), "statement_id", c("start").alias("s_start")), ["s_qid"], [c("s_ord")])
    several = held.groupBy("qid").agg(F.count("*").alias("n")).select(c("qid").alias("n_qid"), "n")
    number = F.when(c("join_id").rlike(r"^\d+$"), text.id_normal(c("join_id")))
    spells = tenures.filter(F.upper("council") == body["council"].upper()).select(c("person_key").alias("t_key"), c("start").alias("t_start"), c("end").alias("t_end"))
    rows = left.join(first, c("qid") == c("s_qid")).join(several, c("qid") == c("n_qid")).withColumn("number", number)
    rows = rows.join(spells, (c("number") == c("t_key")) & F.lit(config.identifier_verified), "left")
    detail = F.when(c("t_end").isNotNull(), F.concat(F.lit("open on the graph; the source has the seat from "), date_text(c("t_start")), F.lit(" to "), date_text(c("t_end")))).when(c("t_key").isNotNull(), F.concat(F.lit("open on the graph; the source has the seat from "), date_text(c("t_start")), F.lit(" without an end"))).otherwise("open on the graph; the source does not list the person")
    gone = _found(rows, 3, F.lit(0), [rule(F.lit(True), "ADD_END_DATE", detail, statement_id=c("statement_id"), ambiguous_statement=F.when(c("n") > 1, True), parliament_id=c("number"), biography=config.biography(c("number")), start=c("t_start"), end=c("t_end"))], council=council, member_label=F.coalesce("label", "qid"), person_key=c("number"), person_qid=c("qid"))
    return [link, orphan, gone]


def findings(body: dict, members: DataFrame, items: DataFrame, statements: DataFrame, periods: DataFrame, config: Config, today: Column, tenures: DataFrame, conflicts: DataFrame, spans: DataFrame) -> DataFrame:
    """All findings of one chamber. With no members at all the graph's side is not judged: an empty
    list of members is a failed scan, not a chamber that everybody left."""
    own = expected(members, periods, config)
    before, after = item_findings(members, items, config)
    matches = matched(own, statements, config, body)
    of_members = statement_findings(matches, config, body, today).unionByName(after)
    of_members = of_members.unionByName(before) if before is not None else of_members
    disputed = disagreements(members.filter(F.col("qid").isNotNull()), spans, config)
    out = unmatched_findings(members, config).unionByName(stamped(of_members, disputed, config)).unionByName(disputed)
    if not members.isEmpty():
        for part in reverse_findings(members, items, statements, tenures, conflicts, config, body):
            out = out.unionByName(part)
    known = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return out.withColumn("priority", F.coalesce(F.try_element_at(known, F.col("kind")), F.lit(OTHER_PRIORITY)))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("priority", text.folded(F.col("member_label")), "step", "at", "nth", "member_label", "person_qid")


def mechanical(config: Config) -> Column:
    """Whether a finding may be applied without a person looking at it."""
    p = lambda name: F.col(f"payload.{name}")
    kind, terms = F.col("kind"), F.size(F.coalesce(p("terms"), F.array().cast("array<string>"))) > 0
    needs = (
        F.when(kind.isin("ADD_MEMBERSHIP", "ADD_START_DATE"), p("start").isNotNull()).when(kind == "ADD_END_DATE", p("end").isNotNull()).when(kind == "ADD_TERM", terms)
        .when(kind == "ADD_QUALIFIER", p("district").isNotNull() | p("group").isNotNull()).otherwise(False)
    )
    pinned = ~F.coalesce(p("ambiguous_statement"), F.lit(False)) & (terms if config.statement_model == PERIOD else F.lit(True))
    gates = [
        F.col("qid_source") == "identifier", F.col("person_qid").isNotNull(), kind.isin(*MECHANICAL), text.blank_to_null(p("biography")).isNotNull(), text.blank_to_null(p("position")).isNotNull(),
        ~F.coalesce(p("sources_disagree"), F.lit(False)), ~F.coalesce(p("identifier_unverified"), F.lit(False)), needs, ~kind.isin(*QUALIFIER_ONLY) | pinned,
    ]
    out = F.lit(True)
    for gate in gates:
        out = out & F.coalesce(gate, F.lit(False))
    return out


def command(retrieved: Column) -> Column:
    """The edit command of a mechanical finding: item, property and value, qualifiers, reference."""
    p = lambda name: F.col(f"payload.{name}")
    kind = F.col("kind")
    pair = lambda prop, x: F.when(x.isNotNull(), F.concat(F.lit(f"{prop}|"), x))
    terms = F.nullif(F.array_join(F.transform(p("terms"), lambda t: F.concat(F.lit("P2937|"), t)), "|"), F.lit(""))
    start, end = pair("P580", time_literal(p("start"))), pair("P582", time_literal(p("end")))
    district, group = pair("P768", p("district")), pair("P4100", p("group"))
    middle = (
        F.when(kind == "ADD_MEMBERSHIP", F.concat_ws("|", start, end, district, group, terms)).when(kind == "ADD_START_DATE", F.concat_ws("|", terms, start))
        .when(kind == "ADD_END_DATE", F.concat_ws("|", terms, end)).when(kind == "ADD_TERM", terms).otherwise(F.concat_ws("|", terms, district, group))
    )
    return F.concat_ws("|", F.col("person_qid"), F.lit("P39"), p("position"), middle, F.lit("S854"), F.concat(F.lit('"'), p("biography"), F.lit('"')), F.lit("S813"), time_literal(retrieved))


def commands(found: DataFrame, config: Config, retrieved: Column) -> DataFrame:
    """line, kind, person_qid and member_label of the mechanical findings, in the order of the report."""
    return ordered(found.filter(mechanical(config))).select(command(retrieved).alias("line"), "kind", "person_qid", "member_label")
