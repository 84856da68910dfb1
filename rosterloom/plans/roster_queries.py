"""Whole reconciliations on the standard tables, with their SQL.

Customers with orders are members who sit from their first order on; those without an order since 2000
have left with their last one. Four of five customers have an item, some identifiers belong to
two items, and the items' statements differ from the roster by rules of the customer's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.config import Config
from rosterloom.plans import resolve, rules
from rosterloom.sources.base import as_members, empty, shaped

BODY = {"council": "NR", "label": "chamber", "position_qid": "Q1"}
CONFIG = Config(biography_url="https://example.org/{id}")
TODAY, LEFT_BEFORE = "2001-12-31", "2000-01-01"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("s"), F.max(F.col("o_orderdate").cast("date")).alias("e"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return customers.join(orders, F.col("k") == F.col("o_custkey"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, k = _people(spark, sf_dir), F.col("k")
    left = F.when(F.col("e") < F.lit(LEFT_BEFORE).cast("date"), F.col("e"))
    members = as_members(p, ord=k, person_key=k, council=F.lit("NR"), full_name=F.col("name"), active=left.isNull(), date_joining=F.col("s"), date_leaving=left)
    own = p.filter("k % 5 <> 0")
    null = F.lit(None)
    items = own.select(F.concat(F.lit("Q"), k).alias("qid"), F.col("name").alias("label"), k.alias("join_id")).unionByName(own.filter("k % 7 = 0").select(F.concat(F.lit("Q"), k + 100_000_000).alias("qid"), F.col("name").alias("label"), k.alias("join_id")))
    items = shaped(items.withColumns({"birth_date": null, "identifiers": null, "parties": null, "properties": null, "person_data_known": F.lit(False)}), schema.ITEMS)
    days = (k % 3).cast("int")
    statements = own.select(k.alias("ord"), F.concat(F.lit("S"), k).alias("statement_id"), F.concat(F.lit("Q"), k).alias("qid"), F.lit("Q1").alias("position_qid"), F.when(k % 11 != 0, F.date_add("s", days)).alias("start"), F.when(k % 4 == 0, F.col("e")).alias("end"))
    statements = shaped(statements.withColumns({"districts": null, "groups": null, "terms": null}), schema.STATEMENTS)
    # every pass of the rules reads the resolved members; they are kept in memory or on disk, and made again if lost
    return resolve.by_identifier(members, items).persist(), items, statements


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, items, statements = _parts(spark, sf_dir)
    none = lambda s: empty(spark, s)
    periods = shaped(spark.range(1).select(F.lit(1).alias("number"), F.lit("all").alias("name"), F.lit(None).alias("start"), F.lit(None).alias("end")), schema.PERIODS)
    return rules.findings(BODY, members, items, statements, periods, CONFIG, F.lit(TODAY).cast("date"), none(schema.TENURES), none(schema.LINK_CONFLICTS), none(schema.SPANS))


def roster_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("kind", "priority", "member_label", "step", "person_qid")


def roster_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.commands(_findings(spark, sf_dir), CONFIG, F.lit(TODAY).cast("date")).select("line", "kind")


def roster_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterloom.plans.report import hit_rate

    return hit_rate(_parts(spark, sf_dir)[0])


_BASE = """p AS (SELECT c_custkey AS k, c_name AS name, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
m AS (SELECT *, e < DATE '2000-01-01' AS gone, k % 5 <> 0 AND k % 7 <> 0 AS matched, k % 5 <> 0 AND k % 7 = 0 AS twice,
CASE WHEN k % 11 <> 0 THEN s + (k % 3)::INT END AS ss, CASE WHEN k % 4 = 0 THEN e END AS se FROM p)"""

ORACLES = {
    "roster_findings": f"""WITH {_BASE}, f AS (
SELECT 'DUPLICATE_IDENTIFIER' AS kind, 1 AS priority, name AS member_label, 0 AS step, NULL AS person_qid FROM m WHERE twice
UNION ALL SELECT 'NO_WIKIDATA_ITEM', 5, name, 0, NULL FROM m WHERE k % 5 = 0
UNION ALL SELECT 'REVIEW_ENDED', 1, name, 0, 'Q' || k FROM m WHERE matched AND NOT gone AND se IS NOT NULL
UNION ALL SELECT 'ADD_END_DATE', 2, name, 0, 'Q' || k FROM m WHERE matched AND gone AND se IS NULL
UNION ALL SELECT 'ADD_START_DATE', 3, name, 0, 'Q' || k FROM m WHERE matched AND ss IS NULL
UNION ALL SELECT 'FIX_START_DATE', 2, name, 0, 'Q' || k FROM m WHERE matched AND ss <> s
UNION ALL SELECT 'ADD_END_DATE', 2, name, 3, 'Q' || k FROM m WHERE (matched OR twice) AND gone AND se IS NULL) SELECT * FROM f""",
    "roster_commands": f"""WITH {_BASE}, t AS (SELECT *, '|S854|"https://example.org/' || k || '"|S813|+2001-12-31T00:00:00Z/11' AS ref FROM m WHERE matched)
SELECT 'Q' || k || '|P39|Q1|P582|+' || strftime(e, '%Y-%m-%d') || 'T00:00:00Z/11' || ref AS line, 'ADD_END_DATE' AS kind FROM t WHERE gone AND se IS NULL
UNION ALL SELECT 'Q' || k || '|P39|Q1|P580|+' || strftime(s, '%Y-%m-%d') || 'T00:00:00Z/11' || ref, 'ADD_START_DATE' FROM t WHERE ss IS NULL""",
    "roster_hit_rate": f"""WITH {_BASE} SELECT count(*)::BIGINT AS members, count_if(matched)::BIGINT AS by_identifier, 0::BIGINT AS by_name, count_if(NOT matched)::BIGINT AS unmatched, round(100.0 * count_if(matched)::DOUBLE / count(*), 1) AS hit_rate FROM m""",
}
QUERIES = {f.__name__: f for f in (roster_findings, roster_commands, roster_hit_rate)}
