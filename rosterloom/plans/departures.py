"""People whom the graph still has as sitting and the source doesn't: three sources side by side.

``departures`` has a row a person: the graph's first open statement, the source's historic spell and a second
source's span, with what can be said about them. The verdicts are aggregates over these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.operators import dedup, profile

#: Fewer comparable rows than this decide nothing.
LEAST_COMPARABLE = 5


def departures(body: dict, items: DataFrame, statements: DataFrame, tenures: DataFrame, spans: DataFrame, members: DataFrame) -> DataFrame:
    c = F.col
    held = statements.filter(c("position_qid") == body["position_qid"])
    open_ = dedup.top1(held.filter(c("end").isNull()).select(c("qid").alias("q"), c("ord").alias("o"), "statement_id", c("start").alias("graph_start")), ["q"], [c("o")])
    several = held.groupBy(c("qid").alias("n_q")).agg(F.count("*").alias("n_statements"))
    active = members.filter("active")
    left = items.join(active.select(c("qid").alias("_q")).filter("_q IS NOT NULL").distinct(), c("qid") == c("_q"), "left_anti")
    left = left.join(active.select(text.id_normal(c("person_key")).alias("_k")).filter("_k IS NOT NULL").distinct(), text.id_normal(c("join_id")) == c("_k"), "left_anti")
    spell = tenures.filter(F.upper("council") == body["council"].upper()).select(text.id_normal(c("person_key")).alias("t_k"), c("start").alias("source_start"), c("end").alias("source_end"))
    other = spans.filter(F.upper("council") == body["council"].upper()).select(c("qid").alias("s_q"), c("start").alias("other_start"), c("end").alias("other_end"))
    rows = left.join(open_, c("qid") == c("q")).join(several, c("qid") == c("n_q")).join(spell, text.id_normal(c("join_id")) == c("t_k"), "left").join(other, c("qid") == c("s_q"), "left")
    return rows.select(
        "qid", "label", "join_id", "statement_id", "graph_start", "n_statements", "source_start", "source_end", "other_start", "other_end",
        c("t_k").isNotNull().alias("reachable"), c("source_end").isNotNull().alias("has_date"), (c("source_end").isNotNull() & c("other_end").isNotNull()).alias("comparable"),
        F.coalesce(c("source_end") == c("other_end"), F.lit(False)).alias("agrees"), (c("n_statements") > 1).alias("ambiguous"),
        F.coalesce(c("graph_start") != c("source_start"), F.lit(False)).alias("start_disagrees"), F.coalesce(c("source_end") < c("source_start"), F.lit(False)).alias("reversed"),
    )


def _judged(df: DataFrame, counts: dict[str, Column], ladder) -> DataFrame:
    out = df.agg(*[F.count_if(x).alias(n) if x is not None else F.count("*").alias(n) for n, x in counts.items()])
    return out.withColumn("verdict", profile.verdict(*ladder))


def reach(rows: DataFrame) -> DataFrame:
    """Whether the identifiers of those who left lead back to the source at all."""
    c = F.col
    return _judged(rows, {"people": None, "reachable": c("reachable"), "with_date": c("has_date")}, [(c("people") == 0, profile.INCONCLUSIVE), (c("reachable") == 0, profile.CONTRADICTED)])


def identity(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Whether the source's surname (``names``: person_key, surname) stands in the item's label."""
    c = F.col
    met = rows.join(names.select(text.id_normal(c("person_key")).alias("_k"), "surname"), text.id_normal(c("join_id")) == c("_k"))
    relation = met.withColumn("relation", text.name_relation(c("surname"), c("label")))
    is_ = lambda x: c("relation") == x
    counts = {"people": None, "judged": c("relation").isNotNull(), "near_names": is_("near"), "other_names": is_("different")}
    return _judged(relation, counts, [(c("other_names") > 0, profile.CONTRADICTED), ((c("near_names") > 0) | (c("judged") == 0), profile.INCONCLUSIVE)])


def leaving_dates(rows: DataFrame) -> DataFrame:
    """Whether two sources give the same leaving dates, and no spell ends before it begins."""
    c = F.col
    counts = {"people": None, "comparable": c("comparable"), "agree": c("comparable") & c("agrees"), "reversed_spans": c("reversed")}
    return _judged(rows, counts, [(c("reversed_spans") > 0, profile.CONTRADICTED), (c("comparable") < LEAST_COMPARABLE, profile.INCONCLUSIVE), (c("agree") < c("comparable"), profile.CONTRADICTED)])


def statement_ambiguity(rows: DataFrame) -> DataFrame:
    """Whether the statement to close is known: one a person, and begun when the source says."""
    c = F.col
    both = c("graph_start").isNotNull() & c("source_start").isNotNull()
    counts = {"people": None, "several_statements": c("ambiguous"), "both_starts": both, "starts_differ": both & c("start_disagrees")}
    return _judged(rows, counts, [(c("starts_differ") > 0, profile.CONTRADICTED), (c("people") == 0, profile.INCONCLUSIVE)])


def overall(*judged: DataFrame) -> DataFrame:
    """The worst of several verdicts."""
    out = judged[0].select("verdict")
    for d in judged[1:]:
        out = out.unionByName(d.select("verdict"))
    return profile.worst(out, "verdict")
