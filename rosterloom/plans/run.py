"""A whole run: from a configuration and the tables of a source and of the graph to findings and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.config import Config
from rosterloom.operators import lineage
from rosterloom.plans import report, resolve, rules
from rosterloom.sources import base, factory

Tables = Callable[[str], DataFrame]


@dataclass
class Result:
    members: DataFrame
    findings: DataFrame
    statements: DataFrame


def run(spark: SparkSession, config: Config, source: Tables, graph: Tables, today: Column, limit: int | None = None, spans: DataFrame | None = None) -> Result:
    """``source`` gives the source's tables by name, ``graph`` the tables items, statements and candidates (for names).

    A source that gives no members at all is a failed scan, not a chamber that everybody left: it is an error.
    """
    councils = {b.council: b.group_name or b.label or b.council for b in config.bodies}
    roster = factory.build(spark, config.source, source, councils, today, config.roles)
    members = report.limited(roster.members, limit) if limit else roster.members
    members = lineage.written(members, "roster")  # the source is read once; its stages are counted in this pass
    if members.isEmpty():
        raise ValueError("the source gives no members; nothing is compared" + (f": {roster.watched.verdict}" if roster.watched else ""))
    items, statements = graph("items"), graph("statements")
    members = resolve.by_identifier(members, items, corroborate=not config.identifier_verified)
    members = lineage.written(resolve.by_name(members, graph("candidates")), "members")  # every pass reads them
    other = spans if spans is not None else base.empty(spark, schema.SPANS)
    found = []
    for body in config.bodies:
        own = members.filter(F.upper("council") == body.council.upper())
        found.append(rules.findings(body.row, own, items, statements, roster.periods, config, today, roster.tenures, roster.link_conflicts, other))
    return Result(members, reduce(DataFrame.unionByName, found), statements)


def write(result: Result, config: Config, generated: str, path: str) -> None:
    """All files of a report under ``path``, from findings that are made once and written."""
    found = lineage.written(result.findings, "findings")
    report.write(result.members, found, result.statements, [b.row for b in config.bodies], config, generated, path)
    lineage.removed(found)
