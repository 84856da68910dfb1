"""python -m rosterloom CONFIG SOURCE GRAPH OUT [--limit N] [--today DAY]: a run over tables in Parquet under SOURCE and GRAPH.

SOURCE may be the address of the federal service, or (in one argument, with ``{start}`` and ``{size}``) those of a mandate and a contact index.

``--verify-config`` shows instead what every configured item is on the graph (tables items and instances under GRAPH); it ends with 1 if one isn't
there. ``--validate-periods URL [VOTE ...]`` checks instead the periods of SOURCE against the roll calls of a service; without votes (or
with ``auto``) they are discovered. It ends with 1 if a sitting member voted in a period that nobody assigned to them, or nothing could be compared.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom import config as configuration
from rosterloom.functions import text
from rosterloom.plans import report, run, validate, verdicts
from rosterloom.sources import federal, live


def verify_config(spark: SparkSession, config: configuration.Config, graph: run.Tables) -> int:
    """Every configured item by kind and key, its label and its classes."""
    named = verdicts.configured(config, {b.council: b.position_qid for b in config.bodies})
    if not named:
        print("no items are configured")
        return 0
    described = graph("items").select("qid", "label").join(graph("instances").groupBy("qid").agg(F.array_sort(F.collect_set("label")).alias("instance_of")), "qid", "left")
    rows = verdicts.config_items(spark, named, described).orderBy("kind", "key").collect()  # what a configuration names
    for r in rows:
        print(f"{r['kind']}  {r['key']}  {r['qid']}  " + (f"{r['label']} [{r['instance_of'] or '-'}]" if r["resolves"] else "not on the graph, or without a label"))
    missing = sum(not r["resolves"] for r in rows)
    print(f"{len(rows) - missing} of {len(rows)} items resolve")
    return int(missing > 0)


def validate_periods(spark: SparkSession, config: configuration.Config, source: run.Tables, url: str, votes: list[int], delay: float) -> int:
    """Counts by verdict for each period that a roll call speaks of."""
    rows = source("periods")
    roster = federal.read(source("members"), source("history"), rows, [b.council for b in config.bodies])
    periods = roster.periods.join(federal.period_ids(rows), "number", "left")
    found, failed = validate.from_service(spark, roster.members, periods, url, votes, config.language.upper(), delay)
    counts: dict[int, dict[str, int]] = {}
    for r in found.groupBy("number", "verdict").agg(F.count("*").alias("n")).collect():  # a row a period and verdict
        counts.setdefault(r["number"], {})[r["verdict"]] = r["n"]
    print(json.dumps({"periods": counts, "failed_votes": failed}, indent=2, sort_keys=True))
    for f in failed:
        print(f"the ballots of vote {f['vote']} could not be read: {f['error']}", file=sys.stderr)
    if not counts:
        print("no period could be compared", file=sys.stderr)
    return int(not counts or any(c.get("not_assigned") for c in counts.values()))


def _source(spark: SparkSession, config: configuration.Config, place: str, delay: float) -> run.Tables:
    """Tables in Parquet under a folder, or of services: one address for the federal source, those of mandates and contacts for mandates."""
    if "://" not in place or place.startswith("file:"):
        return lambda name: spark.read.parquet(f"{place}/{name}")
    if config.source == "federal":
        return live.federal(spark, place, [b.council for b in config.bodies], config.language.upper(), delay=delay, agent=config.user_agent)
    if config.source == "mandates":
        return live.mandates(spark, *place.split(), delay=delay, agent=config.user_agent)
    raise ValueError(f"there is no live source for {config.source!r}")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rosterloom")
    for name in ("config", "source", "graph", "out"):
        parser.add_argument(name)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--today", type=dt.date.fromisoformat, default=dt.date.today())
    parser.add_argument("--verify-config", action="store_true")
    parser.add_argument("--validate-periods", nargs="+", metavar=("URL", "VOTE"))
    parser.add_argument("--delay", type=float, default=1.0, help="seconds before each request")
    given = parser.parse_args(arguments)
    config = configuration.load(given.config)
    if "://" in given.source or given.validate_periods:
        if wrong := config.problems():  # a service is asked only by a run that names itself and can work
            parser.error("; ".join(wrong))
    votes = text.vote_ids((given.validate_periods or [])[1:])
    spark = SparkSession.builder.appName("rosterloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables = lambda folder: lambda name: spark.read.parquet(f"{folder}/{name}")
    if given.verify_config:
        return verify_config(spark, config, tables(given.graph))
    if given.validate_periods:
        return validate_periods(spark, config, _source(spark, config, given.source, given.delay), given.validate_periods[0], votes, given.delay)
    result = run.run(spark, config, _source(spark, config, given.source, given.delay), tables(given.graph), F.lit(given.today.isoformat()).cast("date"), given.limit)
    run.write(result, config, given.today.isoformat(), given.out)
    bodies = [b.row for b in config.bodies]
    summary: DataFrame = report.by_body(result.members, result.findings, result.statements, bodies, config)
    print(report.console(summary))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
