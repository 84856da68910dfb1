"""Reports of findings: a page for each chamber, a start page, an HTML page, a JSON document and the edit commands.

All files are tables of lines (file, line, and the columns of ``ORDER``) that Spark orders and a writer puts into named
files; nothing but a row a chamber comes to the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.config import Config
from rosterloom.functions import text
from rosterloom.operators.dedup import limit_per_key
from rosterloom.plans import rules
from rosterloom.sources import files

#: Where a line stands in its file.
ORDER = {"part": "int", "chamber": "string", "last": "boolean", "name": "string", "level": "int", "priority": "int", "label": "string", "step": "int", "at": "bigint", "nth": "int"}
#: The counts of a chamber and what a page calls them.
COUNTS = {
    "members": "members in the source", "by_identifier": "matched by identifier", "by_name": "matched by name", "unmatched": "without an item", "mismatched": "identifiers that name somebody else",
    "open_on_graph": "items with an open statement", "findings": "findings", "ready": "ready as edit commands",
}


def hit_rate(members: DataFrame) -> DataFrame:
    """Members, matched by identifier and by name, unmatched, and the share matched by identifier in percent."""
    n = lambda c, name: F.count_if(c).alias(name)
    own = members.agg(F.count("*").alias("members"), n(F.col("qid_source") == "identifier", "by_identifier"), n(F.col("qid_source") == "name", "by_name"), n(F.col("qid").isNull(), "unmatched"))
    return own.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(100 * F.col("by_identifier"), F.col("members")), F.lit(0.0)), 1))


def by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("council", "priority", "kind").agg(F.count("*").alias("n")).orderBy("council", "priority", "kind")


def kind_totals(found: DataFrame) -> DataFrame:
    """Findings of each kind over all councils, the urgent first."""
    return found.groupBy("kind", "priority").agg(F.count("*").alias("n")).orderBy("priority", "kind")


def grouped(found: DataFrame, column: str = "constituency") -> DataFrame:
    """Findings with the group they stand in and its place: groups in folded order, Other last."""
    group = F.coalesce(text.blank_to_null(F.col(column)), F.lit("Other"))
    return found.withColumn("group", group).withColumn("group_place", F.struct((group == "Other").alias("last"), text.folded(group).alias("name")))


def limited(members: DataFrame, n: int) -> DataFrame:
    """The first n members of each council."""
    return limit_per_key(members, ["council"], [F.col("ord")], n)


def open_on_graph(statements: DataFrame, bodies: list[dict]) -> DataFrame:
    """(council, open_on_graph): items with an open statement for the seat of each chamber."""
    spark = statements.sparkSession
    seats = spark.createDataFrame([(b["council"], b["position_qid"]) for b in bodies], "council string, seat string")
    held = statements.filter("end IS NULL").select("position_qid", "qid").distinct()
    return held.join(F.broadcast(seats), F.col("position_qid") == F.col("seat")).groupBy("council").agg(F.count("*").alias("open_on_graph"))


def by_body(members: DataFrame, found: DataFrame, statements: DataFrame | None = None, bodies: list[dict] = (), config: Config | None = None) -> DataFrame:
    """A row for each council: members, matched by identifier and name, unmatched, hit rate, mismatched identifiers, findings; with
    the graph's statements also the items with an open one, with a configuration the findings that are ready."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    wrong = F.size("mismatch_qids") > 0 if "mismatch_qids" in members.columns else F.lit(False)
    own = members.groupBy("council").agg(F.count("*").alias("members"), n(F.col("qid_source") == "identifier", "by_identifier"), n(F.col("qid_source") == "name", "by_name"), n(F.col("qid").isNull(), "unmatched"), n(wrong, "mismatched"))
    counts = found.groupBy("council").agg(F.count("*").alias("findings"), *([n(rules.mechanical(config), "ready")] if config else []))
    rate = F.round(F.coalesce(F.try_divide(100 * F.col("by_identifier"), F.col("members")), F.lit(0.0)), 1)
    own = own.join(counts, "council", "left")
    more = ["findings", *(["ready"] if config else [])]
    if statements is not None:
        own, more = own.join(open_on_graph(statements, bodies), "council", "left"), [*more, "open_on_graph"]
    return own.withColumns({c: F.coalesce(c, F.lit(0)) for c in more} | {"hit_rate": rate})


def file_name(council: Column, label: Column, ending: str = "md") -> Column:
    """A chamber's file: its council and its label in plain letters."""
    return F.concat(council, F.lit("-"), text.slug(text.plain_letters(label)), F.lit(f".{ending}"))


def lines(df: DataFrame, file: Column | str, part: int, line: Column, **place: Column) -> DataFrame:
    """A line for each row; places that aren't given sort first."""
    own = file if isinstance(file, Column) else F.lit(file)
    return df.select(own.alias("file"), line.alias("line"), *[(F.lit(part) if c == "part" else place.get(c, F.lit(None))).cast(k).alias(c) for c, k in ORDER.items()])


def _where(level: int = 1) -> dict[str, Column]:
    """The place of a finding within its chamber."""
    return {"chamber": F.col("council"), "level": F.lit(level), "priority": F.col("priority"), "label": text.folded(F.col("member_label")), "step": F.col("step"), "at": F.col("at"), "nth": F.col("nth")}


def escaped(x: Column) -> Column:
    """Text that an HTML page shows as it is."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return F.coalesce(x, F.lit(""))


def _item(qid: Column, label: Column) -> Column:
    return F.when(qid.isNotNull(), F.concat(F.lit("["), label, F.lit("](https://www.wikidata.org/wiki/"), qid, F.lit(")"))).otherwise(label)


def chamber_lines(chambers: DataFrame, found: DataFrame, config: Config) -> DataFrame:
    """The page of each chamber: counts, findings by kind, and the findings in groups."""
    c = F.col
    at = {"chamber": c("council")}
    head = lines(chambers, c("file"), 0, F.concat(F.lit("# "), "title"), **at)
    counted = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit("- "), c(name).cast("string"), F.lit(f" {said}")).alias("line")) for k, (name, said) in enumerate(COUNTS.items())])
    counts = lines(chambers.select("file", "council", F.explode(counted).alias("x")), c("file"), 1, c("x.line"), level=c("x.k"), **at)
    own = found.join(F.broadcast(chambers.select(c("council").alias("_c"), "file")), c("council") == c("_c"))  # a row a chamber
    kinds = own.groupBy("file", "council", "priority", "kind").agg(F.count("*").alias("n"))
    parts = [head, counts, lines(chambers.filter("findings > 0"), c("file"), 2, F.lit("\n## By kind\n"), level=F.lit(0), **at)]
    parts.append(lines(kinds, c("file"), 2, F.concat(F.lit("- "), "kind", F.lit(": "), c("n").cast("string")), level=F.lit(1), priority=c("priority"), label=c("kind"), **at))
    placed = grouped(own, {"group": "parl_group"}.get(config.group_by, config.group_by))
    group = {"last": c("group_place.last"), "name": c("group_place.name")}
    parts.append(lines(placed.select("file", "council", "group", "group_place").distinct(), c("file"), 3, F.concat(F.lit("\n## "), "group", F.lit("\n")), level=F.lit(0), **group, **at))
    parts.append(lines(placed, c("file"), 3, F.concat(F.lit("- **"), "kind", F.lit("** "), _item(c("person_qid"), c("member_label")), F.lit(": "), "detail"), **_where(), **group))
    return reduce(DataFrame.unionByName, parts)


def start_lines(chambers: DataFrame, found: DataFrame, config: Config, generated: str) -> DataFrame:
    """The start page: a paragraph a chamber with a link to its page, then what was found most urgently."""
    c = F.col
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    total = chambers.agg(F.sum("findings").alias("f"), F.sum("members").alias("m"), F.sum("ready").alias("r"))
    parts = [
        lines(total, "index.md", 0, said("# Roster and graph, ", F.lit(generated), "\n\n", c("m"), " members were compared; ", c("f"), " things to look at, of which ", c("r"), " can be applied with the commands in [commands.txt](commands.txt). All of them: [report.html](report.html), [findings.json](findings.json).\n")),
        lines(chambers, "index.md", 1, said("**[", c("title"), "](", c("file"), ")** (seat ", c("position_qid"), "): ", c("by_identifier"), " of ", c("members"), " members by ", F.lit(config.identifier_property), " (", c("hit_rate"), " %), ", c("by_name"), " by name, ", c("unmatched"), " open; ", c("findings"), " findings.\n"), chamber=c("council")),
        lines(kind_totals(found), "index.md", 2, said(c("priority"), ". ", c("kind"), ", ", c("n"), " times"), priority=c("priority"), label=c("kind")),
    ]
    return reduce(DataFrame.unionByName, parts)


def html_lines(chambers: DataFrame, found: DataFrame, title: str) -> DataFrame:
    """The page of all findings: a section with a table for each chamber."""
    c, safe = F.col, title.replace("&", "&amp;").replace("<", "&lt;")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    qid = F.when(c("person_qid").isNotNull(), F.concat(F.lit('<a href="https://www.wikidata.org/wiki/'), escaped(c("person_qid")), F.lit('">'), escaped(c("person_qid")), F.lit("</a>"))).otherwise("")
    row = F.concat(F.lit('<tr class="p'), c("priority").cast("string"), F.lit('">'), cell(escaped(c("kind"))), cell(escaped(c("member_label"))), cell(qid), cell(escaped(c("detail"))), F.lit("</tr>"))
    one = chambers.limit(1)
    style = "table{border-collapse:collapse}td{padding:.2em .6em;border-bottom:1px solid #ddd}tr.p1{font-weight:bold}"
    head = F.concat(F.lit("<section><h2>"), escaped(c("title")), F.lit("</h2><p>"), c("members").cast("string"), F.lit(" members, "), c("findings").cast("string"), F.lit(" findings</p><table>"))
    parts = [
        lines(one, "report.html", 0, F.lit(f"<!doctype html><html><head><meta charset='utf-8'><title>{safe}</title><style>{style}</style></head><body><h1>{safe}</h1>")),
        lines(chambers, "report.html", 1, head, chamber=c("council"), level=F.lit(0)), lines(found, "report.html", 1, row, **_where()),
        lines(chambers, "report.html", 1, F.lit("</table></section>"), chamber=c("council"), level=F.lit(2)), lines(one, "report.html", 2, F.lit("</body></html>")),
    ]
    return reduce(DataFrame.unionByName, parts)


def as_json(found: DataFrame) -> Column:
    """A finding as JSON; what a kind doesn't carry is left out."""
    return F.to_json(F.struct("kind", "priority", "council", "member_label", "person_qid", "person_key", "qid_source", "constituency", "parl_group", "detail", "payload"), {"dateFormat": "yyyy-MM-dd"})


def json_lines(chambers: DataFrame, found: DataFrame, generated: str) -> DataFrame:
    """One document: totals, and the chambers with their counts and their findings."""
    c = F.col
    total = chambers.agg(F.sum("findings").alias("total_findings"), F.sum("members").alias("total_members"), F.sum("ready").alias("commands")).withColumn("generated", F.lit(generated))
    opened = lambda s, name: F.concat(F.regexp_replace(F.to_json(s), r"\}$", ""), F.lit(f', "{name}": ['))
    # the first row of each list has no comma before it; the order of the findings is that of their places
    first = Window.partitionBy("council").orderBy("priority", text.folded(c("member_label")), "step", "at", "nth", "member_label", "person_qid")
    comma = lambda is_first: F.when(is_first, "").otherwise(",")
    numbered = found.withColumn("_first", F.lag(F.lit(1)).over(first).isNull())
    least = F.broadcast(chambers.agg(F.min("council").alias("_least")))  # one row
    bodies = chambers.join(least)
    parts = [
        lines(total, "findings.json", 0, opened(F.struct("generated", "total_findings", "total_members", "commands"), "chambers")),
        lines(bodies, "findings.json", 1, F.concat(comma(c("council") == c("_least")), opened(F.struct("council", c("title").alias("label"), "position_qid", *COUNTS, "hit_rate"), "found")), chamber=c("council"), level=F.lit(0)),
        lines(numbered, "findings.json", 1, F.concat(comma(c("_first")), as_json(found)), **_where()),
        lines(chambers, "findings.json", 1, F.lit("]}"), chamber=c("council"), level=F.lit(2)), lines(total, "findings.json", 2, F.lit("]}")),
    ]
    return reduce(DataFrame.unionByName, parts)


def command_lines(chambers: DataFrame, found: DataFrame, config: Config, generated: str) -> DataFrame:
    """The edit commands, after lines that say what they are."""
    c = F.col
    total = chambers.agg(F.sum("findings").alias("f"), F.sum("ready").alias("r"))
    head = [f"# Edit commands, one a line, fields separated by |; generated {generated}", f"# Statements are modelled by {config.statement_model}; members matched by {config.identifier_property} only", "# Read the reports first, and try a line before the rest", "#"]
    said = F.concat(F.lit("# "), c("r").cast("string"), F.lit(" of "), c("f").cast("string"), F.lit(" findings can be applied"))
    top = F.posexplode(F.array(*[F.lit(x) for x in head[:2]], said, *[F.lit(x) for x in head[2:]])).alias("k", "line")
    ready = found.filter(rules.mechanical(config))
    place = _where() | {"chamber": F.lit(None)}
    return lines(total.select(top), "commands.txt", 0, c("line"), level=c("k")).unionByName(lines(ready, "commands.txt", 1, rules.command(F.lit(generated[:10]).cast("date")), **place))


def chambers_of(members: DataFrame, found: DataFrame, statements: DataFrame | None, bodies: list[dict], config: Config) -> DataFrame:
    """A row for each configured chamber with its counts, its title and its file."""
    spark = found.sparkSession
    own = spark.createDataFrame([(b["council"], b["label"], b["position_qid"]) for b in bodies], "council string, title string, position_qid string")
    counts = by_body(members, found, statements, bodies, config).withColumnRenamed("council", "_c")
    met = own.join(counts, F.upper("council") == F.upper("_c"), "left").drop("_c")
    zero = {n: F.coalesce(n, F.lit(0)) if n in met.columns else F.lit(0).cast("bigint") for n in COUNTS}
    return met.withColumns(zero | {"hit_rate": F.coalesce("hit_rate", F.lit(0.0)), "file": file_name(F.col("council"), F.col("title"))})


def console(rows: DataFrame) -> str:
    """A small result as JSON, keys in order."""
    return json.dumps([json.loads(x) for x in rows.toJSON().collect()], sort_keys=True, indent=2, ensure_ascii=False)


def write(members: DataFrame, found: DataFrame, statements: DataFrame | None, bodies: list[dict], config: Config, generated: str, path: str) -> None:
    """All files of a report under ``path``; ``found`` is read several times and should be a written table."""
    chambers = chambers_of(members, found, statements, bodies, config)
    chambers = found.sparkSession.createDataFrame(chambers.collect(), chambers.schema)  # a row a chamber
    parts = [chamber_lines(chambers, found, config), start_lines(chambers, found, config, generated), html_lines(chambers, found, "Roster and graph"), json_lines(chambers, found, generated), command_lines(chambers, found, config, generated)]
    files.write(reduce(DataFrame.unionByName, parts), path, *ORDER, "line")
