"""The graph's questions, verdicts and name rules on the standard tables, each with the same query in DuckDB SQL.

A customer is an item, an order a statement for the seat of its priority, a line a qualifier of its
statement; an identifier is the customer's number where rules of that number say it is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.graph import plans as graph
from rosterloom.operators import profile
from rosterloom.plans import resolve, validate, verdicts
from rosterloom.plans.queries import Tables, day

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of ``Tables`` under its name, with its SQL; the graph's tables are known to it."""

    def deco(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        ORACLES[build.__name__] = f"WITH {_GRAPH}{', ' if not sql.startswith('SELECT') else ' '}{sql}"
        return build

    return deco


_GRAPH = """gi AS (SELECT 'Q' || c_custkey AS qid, c_name AS label, c_custkey AS k FROM customer),
gd AS (SELECT qid, 'P1307' AS property, k::VARCHAR AS value FROM gi WHERE k % 3 <> 0 UNION ALL SELECT qid, 'P14527', k::VARCHAR FROM gi WHERE k % 5 = 0),
gs AS (SELECT o_orderkey::VARCHAR AS statement_id, 'Q' || o_custkey AS qid, 'P' || substr(o_orderpriority, 1, 1) AS position_qid, o_orderdate::DATE AS s, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 100 END AS e FROM orders),
gq AS (SELECT l_orderkey::VARCHAR AS statement_id, CASE l_linenumber % 3 WHEN 0 THEN 'P768' WHEN 1 THEN 'P4100' ELSE 'P2937' END AS property, 'Q' || l_suppkey AS value_qid FROM lineitem)"""


def items(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("Q"), "c_custkey").alias("qid"), F.col("c_name").alias("label"), F.col("c_custkey").alias("k"))


def identifiers(t: Tables) -> DataFrame:
    one = lambda where, name: items(t).filter(where).select("qid", F.lit(name).alias("property"), F.col("k").cast("string").alias("value"))
    return one("k % 3 <> 0", "P1307").unionByName(one("k % 5 = 0", "P14527"))


def statements(t: Tables) -> DataFrame:
    d = day("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("statement_id"), F.concat(F.lit("Q"), "o_custkey").alias("qid"), F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("position_qid"),
        F.lit(None).cast("string").alias("rank"), d.alias("start"), F.when(F.col("o_orderstatus") == "F", F.date_add(d, 100)).alias("end"),
    )


def qualifiers(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 3
    return t.lineitem.select(F.col("l_orderkey").cast("string").alias("statement_id"), F.when(n == 0, "P768").when(n == 1, "P4100").otherwise("P2937").alias("property"), F.concat(F.lit("Q"), "l_suppkey").alias("value_qid"))


@query("""f AS (SELECT statement_id, property, string_agg(DISTINCT value_qid, ',' ORDER BY value_qid) AS v FROM gq GROUP BY 1, 2)
SELECT statement_id, qid, s::VARCHAR AS start, e::VARCHAR AS stop, coalesce((SELECT v FROM f WHERE f.statement_id = gs.statement_id AND property = 'P768'), '') AS districts,
coalesce((SELECT v FROM f WHERE f.statement_id = gs.statement_id AND property = 'P2937'), '') AS terms FROM gs WHERE position_qid IN ('P1', 'P2')""")
def graph_seats(t):
    own = graph.seats(statements(t), qualifiers(t), ["P1", "P2"])
    return own.select("statement_id", "qid", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("stop"), F.array_join("districts", ",").alias("districts"), F.array_join("terms", ",").alias("terms"))


@query("""h AS (SELECT qid, bool_or(e IS NULL) AS open FROM gs WHERE position_qid = 'P1' GROUP BY 1),
x AS (SELECT h.qid, open, EXISTS (SELECT 1 FROM gd WHERE gd.qid = h.qid AND property = 'P1307') AS a, EXISTS (SELECT 1 FROM gd WHERE gd.qid = h.qid AND property = 'P14527') AS b FROM h)
SELECT count(*)::BIGINT AS people, count_if(a)::BIGINT AS with_first, count_if(b)::BIGINT AS with_second, count_if(a OR b)::BIGINT AS with_any, count_if(open)::BIGINT AS open_now FROM x""")
def graph_coverage(t):
    holders = statements(t).filter("position_qid = 'P1'").select("qid").distinct()
    ids = identifiers(t)
    known = lambda p, name: ids.filter(F.col("property") == p).select("qid").distinct().withColumn(name, F.lit(True))
    people = graph.open_now(holders.join(known("P1307", "a"), "qid", "left").join(known("P14527", "b"), "qid", "left"), statements(t), ["P1"])
    has = lambda c: F.coalesce(c, F.lit(False))
    return graph.coverage(people, {"with_first": has("a"), "with_second": has("b"), "with_any": has("a") | has("b"), "open_now": F.col("open")})


@query("SELECT count(*)::BIGINT AS gain FROM (SELECT qid FROM gd WHERE property = 'P14527' EXCEPT SELECT qid FROM gd WHERE property = 'P1307')")
def graph_marginal_gain(t):
    return graph.marginal_gain(identifiers(t), "P14527", "P1307")


@query("SELECT value_qid, count(DISTINCT statement_id)::BIGINT AS statements FROM gq WHERE property = 'P768' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def graph_usage(t):
    return graph.usage(qualifiers(t), "P768")


@query("SELECT position_qid, count(DISTINCT qid)::BIGINT AS people FROM gs WHERE qid IN (SELECT qid FROM gd WHERE property = 'P14527') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def graph_positions_held(t):
    return graph.positions_held(statements(t), identifiers(t).filter("property = 'P14527'"))


@query("""p AS (SELECT qid, count(DISTINCT gs.statement_id) AS a, count(DISTINCT value_qid) AS b FROM gs LEFT JOIN gq ON gq.statement_id = gs.statement_id AND property = 'P2937' WHERE position_qid = 'P1' GROUP BY 1)
SELECT a::BIGINT AS statements, b::BIGINT AS terms, count(*)::BIGINT AS people FROM p GROUP BY 1, 2""")
def graph_model_census(t):
    return graph.model_census(statements(t), qualifiers(t), "P1")


@query("""w AS (SELECT DISTINCT 'Q' || (s_suppkey * 20) AS qid FROM supplier),
l AS (SELECT 'Q' || c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS de, upper(c_name) AS en FROM customer WHERE c_custkey % 40 <> 0),
c AS (SELECT qid, string_agg(DISTINCT position_qid, ',' ORDER BY position_qid) AS v FROM gs GROUP BY 1)
SELECT w.qid, coalesce(de, en) AS label, CASE WHEN en IS NOT NULL THEN 'of ' || w.qid END AS description, coalesce(v, '') AS instance_of FROM w LEFT JOIN l USING (qid) LEFT JOIN c USING (qid)""")
def graph_described(t):
    wanted = t.supplier.select(F.concat(F.lit("Q"), F.col("s_suppkey") * 20).alias("qid"))
    own = items(t).filter("k % 40 <> 0")
    labels = own.select("qid", F.lit("en").alias("lang"), F.upper("label").alias("label"), F.concat(F.lit("of "), "qid").alias("description"))
    labels = labels.unionByName(own.select("qid", F.lit("de").alias("lang"), F.when(F.col("k") % 2 == 0, F.col("label")).alias("label"), F.lit(None).cast("string").alias("description")))
    found = graph.described(wanted, labels, statements(t).select("qid", F.col("position_qid").alias("class_label")), ["de", "en"])
    return found.select("qid", "label", "description", F.array_join("instance_of", ",").alias("instance_of"))


@query("SELECT DISTINCT gs.qid, k % 18 AS number FROM gs LEFT JOIN (SELECT qid, k FROM gi WHERE k % 2 = 0) n ON n.qid = gs.qid WHERE position_qid = 'P3'")
def graph_of_class(t):
    return graph.of_class(statements(t).withColumnRenamed("position_qid", "class_qid"), items(t).filter("k % 2 = 0").select("qid", (F.col("k") % 18).alias("number")), "P3")


@query("SELECT DISTINCT a.qid, b.position_qid AS kind, c.value AS container FROM gi a LEFT JOIN (SELECT qid, position_qid FROM gs) b ON b.qid = a.qid LEFT JOIN (SELECT qid, value FROM gd) c ON c.qid = a.qid")
def graph_details(t):
    return graph.with_details(items(t), kind=(statements(t), "position_qid"), container=(identifiers(t), "value"))


@query("SELECT 'P768' AS property, (SELECT min(value_qid) FROM gq WHERE property = 'P768') AS formatter_url, NULL::VARCHAR AS label")
def graph_formatter(t):
    return graph.formatter(qualifiers(t).withColumnRenamed("value_qid", "formatter_url"), items(t).withColumn("lang", F.lit("de")), "P768", "de")


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) // 25 AS batch, s_suppkey AS value FROM supplier")
def graph_batches(t):
    return graph.batches(t.supplier, "s_suppkey", 25).select("batch", F.explode("values").alias("value"))


@query("""n AS (SELECT DISTINCT trim(c_name) AS name, 'Q' || c_custkey AS qid FROM customer WHERE c_custkey % 4 = 0), p AS (SELECT DISTINCT qid, true AS seated FROM gs WHERE position_qid = 'P5'), i AS (SELECT qid, min(value) AS join_id FROM gd WHERE property = 'P1307' GROUP BY 1)
SELECT name, n.qid, coalesce(seated, false) AS has_position, join_id FROM n LEFT JOIN p USING (qid) LEFT JOIN i USING (qid) WHERE seated OR join_id IS NOT NULL""")
def graph_people_search(t):
    names = items(t).select("qid", F.col("label").alias("name"))
    wanted = items(t).filter("k % 4 = 0").select(F.concat(F.lit("  "), "label").alias("name"))
    found = graph.search(names, wanted, items(t).withColumn("birth_date", F.lit(None).cast("date")), statements(t), identifiers(t), ["P5"], "P1307")
    return found.select("name", "qid", "has_position", "join_id")


@query("SELECT DISTINCT 'Q' || o_custkey AS qid, o_orderpriority AS name, o_orderstatus AS origin, CASE WHEN o_orderstatus = 'F' THEN 'de' END AS lang FROM orders WHERE o_orderstatus <> 'O' AND o_custkey % 3 <> 0")
def graph_name_variants(t):
    names = t.orders.select(F.concat(F.lit("Q"), "o_custkey").alias("qid"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("origin"), F.when(F.col("o_orderstatus") == "F", "de").when(F.col("o_orderstatus") == "O", "xx").alias("lang"))
    return graph.name_variants(names, identifiers(t).filter("property = 'P1307'"), ["de", "en"])


@query("SELECT DISTINCT 'Q' || o_custkey AS qid, o_orderpriority AS party_qid FROM orders WHERE o_orderstatus <> 'F'")
def graph_open_parties(t):
    return graph.open_parties(t.orders.select(F.concat(F.lit("Q"), "o_custkey").alias("qid"), F.col("o_orderpriority").alias("party_qid"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("ended")))


_LADDER = "CASE WHEN {} THEN 'INCONCLUSIVE' WHEN {} THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS verdict"


@query(f"""c AS (SELECT count(*)::BIGINT AS n_rows, bool_or(l_partkey = 7) AS in_number, bool_or(l_suppkey = 7) AS in_code FROM lineitem WHERE l_suppkey = 7)
SELECT n_rows, in_number, in_code, CASE WHEN n_rows = 0 THEN 'no such person' WHEN in_number THEN 'l_partkey' WHEN in_code THEN 'l_suppkey' ELSE 'neither' END AS meaning, {_LADDER.format('n_rows = 0', 'NOT in_number')} FROM c""")
def verdict_source_identifier(t):
    return verdicts.source_identifier(t.lineitem.filter("l_suppkey = 7"), 7, "l_partkey", "l_suppkey")


@query(f"c AS (SELECT count(*)::BIGINT AS total, count(e)::BIGINT AS filled FROM gs) SELECT total, filled, {_LADDER.format('total = 0', 'filled < total')} FROM c")
def verdict_count_agreement(t):
    return verdicts.count_agreement(statements(t), "end")


@query("""r AS (SELECT n_nationkey AS k, n_name AS label, count(c_custkey) FILTER (c_acctbal > 9900) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT arg_min(label, CASE WHEN n >= 2 THEN k END) AS winner, 0::BIGINT AS errors, count_if(n < 2)::BIGINT AS empty FROM r""")
def verdict_first_variant(t):
    rich = t.customer.filter("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    tried = t.nation.join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))
    return verdicts.first_variant(tried, "n_nationkey", "n_name", "n", least=2)


@query("""c AS (SELECT count(*)::BIGINT AS people, count_if(k % 3 <> 0)::BIGINT AS linked, count_if(k % 5 = 0)::BIGINT AS with_party FROM gi)
SELECT *, round(100.0::DOUBLE * linked / people, 1) AS linked_share, round(100.0::DOUBLE * with_party / people, 1) AS party_share FROM c""")
def verdict_link_coverage(t):
    k = F.col("k")
    return verdicts.link_coverage(items(t).select(F.when(k % 3 != 0, k).alias("own"), F.when(k % 5 == 0, "x").otherwise(" ").alias("party")), "own", "party")


@query(f"""c AS (SELECT count(*)::BIGINT AS holders, 0::BIGINT AS with_own, count_if(k % 5 = 0)::BIGINT AS with_mirror, count_if(k % 7 = 0)::BIGINT AS with_other, count_if(k % 5 = 0 OR k % 7 = 0)::BIGINT AS with_any FROM gi)
SELECT *, {_LADDER.format('holders = 0', 'with_mirror = 0')}, 'mirror' AS joined_by, CASE WHEN 100 * with_any >= 50 * holders THEN 'most' ELSE 'some' END AS reach FROM c""")
def verdict_graph_reach(t):
    k = F.col("k")
    return verdicts.graph_reach(items(t).select(F.lit(None).cast("string").alias("own"), F.when(k % 5 == 0, k).alias("mirror"), F.when(k % 7 == 0, k).alias("other")), "own", "mirror", "other")


@query("""c AS (SELECT count(DISTINCT qid)::BIGINT AS holders, count(DISTINCT CASE WHEN e IS NULL THEN qid END)::BIGINT AS open_holders, 300::BIGINT AS seats FROM gs WHERE position_qid = 'P1')
SELECT *, CASE WHEN holders = 0 OR open_holders > seats THEN 'CONTRADICTED' WHEN open_holders = 0 THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END AS verdict FROM c""")
def verdict_position_item(t):
    return verdicts.position_item(statements(t), "P1", 300)


@query(f"""a AS (SELECT DISTINCT lower(n_name) AS n FROM nation), b AS (SELECT DISTINCT lower(r_name) AS n FROM region UNION SELECT lower(n_name) FROM nation WHERE n_nationkey < 9),
c AS (SELECT (SELECT count(*) FROM a)::BIGINT AS source_values, (SELECT count(*) FROM a JOIN b USING (n))::BIGINT AS matched, (SELECT count(*) FROM b)::BIGINT AS used, 12::BIGINT AS holders)
SELECT *, {_LADDER.format('holders = 0 OR used = 0', 'matched = 0')} FROM c""")
def verdict_qualifier_readiness(t):
    used = t.region.select(F.upper("r_name").alias("l")).union(t.nation.filter("n_nationkey < 9").select("n_name"))
    return verdicts.qualifier_readiness(t.nation, used, "n_name", "l", 12)


@query("""c AS (SELECT unnest(['c_guid', 'id', 'order_number']) AS column_name, unnest([c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -c_custkey END, NULL]) AS cell FROM customer),
k AS (SELECT column_name, cell, count(*) AS n FROM c GROUP BY 1, 2), o AS (SELECT DISTINCT o_custkey FROM orders),
j AS (SELECT column_name, coalesce(sum(n) FILTER (cell IS NOT NULL), 0)::BIGINT AS filled, count(cell)::BIGINT AS keys, count(o_custkey)::BIGINT AS known FROM k LEFT JOIN o ON o_custkey = cell GROUP BY 1)
SELECT *, CASE WHEN filled = 0 THEN 'INCONCLUSIVE' WHEN known = 0 THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS verdict FROM j""")
def verdict_joinability(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("c_guid"), F.when(k % 3 == 0, -k).alias("id"), F.lit(None).cast("string").alias("order_number"), "c_name", F.col("c_name").alias("paid"))
    return verdicts.joinability(rows, t.orders, "o_custkey")


@query("SELECT count(*)::BIGINT AS members, count_if(c_custkey % 6 = 0)::BIGINT AS covered, 'CONFIRMED' AS verdict, 'place, city' AS columns FROM customer")
def verdict_property_coverage(t):
    return verdicts.property_coverage(t.customer.select(F.when(F.col("c_custkey") % 6 == 0, F.col("c_name")).otherwise(" ").alias("city"), F.lit(None).cast("string").alias("place")), ["place", "town", "city"])


@query(f"""p AS (SELECT min(o_orderdate)::DATE AS a, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE min(o_orderdate)::DATE + CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END END AS b FROM orders GROUP BY o_custkey),
c AS (SELECT count(b)::BIGINT AS pairs, count_if(a = b)::BIGINT AS agree, count_if(a < b)::BIGINT AS ours_earlier, count_if(a > b)::BIGINT AS ours_later, count_if(b IS NOT NULL AND dayofyear(a) = 1)::BIGINT AS first_of_january FROM p)
SELECT *, {_LADDER.format('pairs < 10', 'agree < pairs')} FROM c""")
def verdict_start_dates(t):
    first = t.orders.groupBy("o_custkey").agg(F.min(day("o_orderdate")).alias("a"))
    return verdicts.start_dates(first.withColumn("b", F.when(F.col("o_custkey") % 9 != 0, F.date_add("a", F.when(F.col("o_custkey") % 4 == 0, 1).otherwise(0)))), "a", "b")


@query("SELECT count(*)::BIGINT AS n_rows, count(e)::BIGINT AS filled, CASE WHEN count(e) = 0 THEN 'CONTRADICTED' WHEN count(e) < count(*) THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END AS verdict, true AS present FROM gs")
def verdict_dated_column(t):
    return verdicts.dated_column(statements(t), "end")


@query("SELECT count(DISTINCT qid)::BIGINT AS people, 246::BIGINT AS seats, CASE WHEN count(DISTINCT qid) = 0 THEN 'INCONCLUSIVE' WHEN count(DISTINCT qid) <> 246 THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS verdict FROM gs WHERE position_qid = 'P2'")
def verdict_seat_count(t):
    return verdicts.seat_count(statements(t).filter("position_qid = 'P2'"), "qid", 246)


@query(f"""c AS (SELECT count(*)::BIGINT AS people, count_if(k % 3 <> 0)::BIGINT AS ours, count_if(k % 5 = 0)::BIGINT AS other, count_if(k % 3 <> 0 OR k % 5 = 0)::BIGINT AS either, count_if(k % 3 = 0 AND k % 5 = 0)::BIGINT AS gained FROM gi)
SELECT *, {_LADDER.format('people = 0', 'gained = 0')} FROM c""")
def verdict_identifier_gain(t):
    k = F.col("k")
    return verdicts.identifier_gain(items(t).select(F.when(k % 3 != 0, k.cast("string")).alias("ours"), F.when(k % 5 == 0, k.cast("string")).otherwise("").alias("other")), "ours", "other")


@query(f"""c AS (SELECT count(*)::BIGINT AS people, count_if(k % 3 <> 0 AND k % 8 <> 0)::BIGINT AS agree, count_if(k % 3 <> 0 AND k % 8 = 0)::BIGINT AS differ, count_if(k % 3 = 0)::BIGINT AS absent FROM gi)
SELECT *, {_LADDER.format('agree + differ = 0', 'differ > 0')} FROM c""")
def verdict_identifier_values(t):
    wanted = items(t).select("qid", F.when(F.col("k") % 8 == 0, F.concat(F.lit("9"), "k")).otherwise(F.concat(F.lit("+0"), "k")).alias("value"))
    return verdicts.identifier_values(wanted, identifiers(t).filter("property = 'P1307'"), "qid", "value")


@query("""SELECT position_qid, count(*)::BIGINT AS members, count(DISTINCT s)::BIGINT AS starts, min(s)::VARCHAR AS first_start, max(s)::VARCHAR AS last_start, bool_and(dayofyear(s) = 1) AS all_first_of_january,
0::BIGINT AS undated, count(e)::BIGINT AS with_end FROM gs GROUP BY 1""")
def verdict_tenure_dates(t):
    own = verdicts.tenure_dates(statements(t), "position_qid", "start", "end")
    return own.withColumns({c: F.col(c).cast("string") for c in ("first_start", "last_start")})


@query("""e AS (SELECT p_name, string_agg(DISTINCT v, ',' ORDER BY v) AS held, count(DISTINCT v) AS n, min(d) AS born FROM (SELECT p_name, CASE WHEN p_size > 10 THEN p_brand END AS v, CASE WHEN p_size > 20 THEN DATE '1950-01-01' + p_size END AS d FROM part) GROUP BY 1),
w AS (SELECT p_name, min(p_type) AS v, CASE WHEN min(p_partkey) % 2 = 0 THEN DATE '1950-01-01' + min(p_size) FILTER (p_size > 20) END AS b FROM part GROUP BY 1)
SELECT p_name, v AS value, coalesce(held, '') AS held, CASE WHEN n > 1 THEN 'ambiguous name' WHEN n = 0 THEN 'no value in export' WHEN b IS NULL OR born IS NULL THEN 'undecided' WHEN b <> born THEN 'different person' ELSE 'value differs' END AS reason FROM w JOIN e USING (p_name)""")
def verdict_miss_reasons(t):
    size = F.col("p_size")
    epoch = F.lit("1950-01-01").cast("date")
    export = t.part.select("p_name", F.when(size > 10, F.col("p_brand")).alias("value"), F.when(size > 20, F.date_add(epoch, size)).alias("born"))
    wanted = t.part.groupBy("p_name").agg(F.min("p_type").alias("value"), F.min("p_partkey").alias("k"), F.min(F.when(size > 20, size)).alias("n"))
    wanted = wanted.select("p_name", "value", F.when(F.col("k") % 2 == 0, F.date_add(epoch, F.col("n"))).alias("born"))
    return verdicts.miss_reasons(wanted, export, "p_name", "value", "born").withColumn("held", F.array_join("held", ","))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'P19' WHEN 'P' THEN '?' ELSE 'P106' END AS property, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def findings_by_property(t):
    from rosterloom.plans import rules

    prop = F.when(F.col("o_orderstatus") == "F", "P19").when(F.col("o_orderstatus") == "O", "P106")
    found = t.orders.select(F.when(F.col("o_orderpriority").startswith("1"), "ADD_PERSON_DATA").otherwise("ADD_TERM").alias("kind"), rules.payload(property=prop).alias("payload"))
    return verdicts.findings_by_property(found)


@query("SELECT lower(p_name) AS key, count(*)::BIGINT AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS rows FROM part GROUP BY 1")
def name_index(t):
    own = profile.name_index(t.part, text.folded(F.col("p_name")), "p_partkey")
    return own.select("key", "n", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("rows"))


@query("SELECT count(DISTINCT o_custkey)::BIGINT AS people FROM orders")
def people_count(t):
    return profile.people_count(t.orders, "o_custkey")


@query("SELECT event_type, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 1) AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def ranked_values(t):
    return profile.ranked(t.events, "event_type", 3)


@query("""n AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 18 + 1) || '. Wahlkreis (' || replace(c_mktsegment, 'I', 'Ü') || ' ' || (c_custkey % 7) || '+10)' WHEN 1 THEN 'Wahlkreis Stadt ' || c_mktsegment WHEN 2 THEN 'Kanton ZH' END AS d FROM customer),
w AS (SELECT k, d, list_filter(string_split_regex(lower(strip_accents(coalesce(d, ''))), '[^0-9a-z]+'), lambda x: x <> '') AS t FROM n),
o AS (SELECT k, d, CASE WHEN len(t) > 0 AND regexp_full_match(t[1], '\\d+') AND list_contains(t[1:2], 'wahlkreis') THEN t[2:] ELSE t END AS t FROM w)
SELECT k, nullif(array_to_string(list_sort(list_filter(t, lambda x: x NOT IN ('wahlkreis', 'stadt', 'kreis', 'kanton', 'zh'))), ' '), '') AS district, CASE WHEN d LIKE '%(%' THEN split_part(d, '.', 1)::INT ELSE 99 END AS place,
CASE WHEN d LIKE '%(%' THEN 'Wahlkreis ' || regexp_extract(d, '\\((.*)\\)', 1) || '|' || regexp_extract(d, '\\((.*)\\)', 1) || '|' || d ELSE coalesce(d, '') END AS terms FROM o""".replace("\\\\", "\\"))
def district_names(t):
    k = F.col("c_custkey")
    d = (
        F.when(k % 4 == 0, F.concat((k % 18 + 1).cast("string"), F.lit(". Wahlkreis ("), F.replace("c_mktsegment", F.lit("I"), F.lit("Ü")), F.lit(" "), (k % 7).cast("string"), F.lit("+10)")))
        .when(k % 4 == 1, F.concat(F.lit("Wahlkreis Stadt "), "c_mktsegment")).when(k % 4 == 2, F.lit("Kanton ZH"))
    )
    own = t.customer.select(k.alias("k"), d.alias("d"))
    return own.select("k", F.array_join(text.district_key(F.col("d")), " ").alias("district"), text.district_order(F.col("d")).alias("place"), F.coalesce(F.array_join(text.search_terms(F.col("d")), "|"), F.lit("")).alias("terms"))


@query(r"""n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'XVII  ' || c_mktsegment ELSE c_mktsegment END AS d FROM customer)
SELECT k, nullif(regexp_extract(d, '^([IVXLC]+)\s+', 1), '') AS numeral, trim(regexp_replace(d, '^[IVXLC]+\s+', '')) AS label, CASE WHEN k % 25 BETWEEN 1 AND 18 THEN k % 25 END AS number FROM n""")
def numbered_labels(t):
    k = F.col("c_custkey")
    own = t.customer.select(k.alias("k"), text.numeral_split(F.concat(F.when(k % 3 == 0, "XVII  ").otherwise(""), "c_mktsegment")).alias("s"), text.district_number(F.concat((k % 25).cast("string"), F.lit(".4"))).alias("number"))
    return own.select("k", "s.numeral", "s.label", "number")


def _name_pairs(t: Tables) -> DataFrame:
    """Surnames and labels made of the words of parts: as they are, with marks, doubled letters, compound, one letter off, bare ids."""
    a, b, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 9
    surname = F.when(k == 0, a).when(k == 1, F.concat(a, F.lit("-x"), b)).when(k == 2, F.regexp_replace(a, "a", "ä")).when(k == 3, F.concat(a, F.substring(a, -1, 1))).when(k == 4, F.concat(F.lit("z"), F.substring(a, 2, 50))).when(k == 5, F.lit(" ")).when(k == 6, b).when(k == 7, F.concat(a, F.lit("tt"))).otherwise(F.lit("mno"))
    label = F.when(k == 6, F.concat(F.lit("Q"), "p_size")).when(k == 1, F.concat(F.lit("First "), a)).when(k == 7, F.concat(F.lit("Ann "), F.upper(a))).otherwise(F.concat(F.lit("Jo "), a))
    return t.part.select("p_partkey", surname.alias("surname"), label.alias("label"))


_FOLD = "array_to_string(list_transform(list_filter(range(1, length({0}) + 1), lambda i: i = 1 OR {0}[i] <> {0}[i - 1]), lambda i: {0}[i]), '')"


@query(f"""w AS (SELECT p_partkey, p_partkey % 9 AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size FROM part),
n AS (SELECT p_partkey, CASE k WHEN 0 THEN a WHEN 1 THEN a || '-x' || b WHEN 2 THEN replace(a, 'a', 'ä') WHEN 3 THEN a || right(a, 1) WHEN 4 THEN 'z' || substr(a, 2) WHEN 5 THEN ' ' WHEN 6 THEN b WHEN 7 THEN a || 'tt' ELSE 'mno' END AS surname,
CASE k WHEN 6 THEN 'Q' || p_size WHEN 1 THEN 'First ' || a WHEN 7 THEN 'Ann ' || upper(a) ELSE 'Jo ' || a END AS label FROM w),
l AS (SELECT *, replace(replace(replace(regexp_replace(replace(lower(surname), 'ä', 'a'), '[^a-z]', '', 'g'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u') AS x0, replace(replace(replace(regexp_replace(lower(label), '[^a-z]', '', 'g'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u') AS y0,
list_transform(string_split_regex(lower(replace(surname, 'ä', 'a')), '[-\\s]+'), lambda p: replace(replace(replace(regexp_replace(p, '[^a-z]', '', 'g'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u')) AS xs0, list_transform(string_split_regex(lower(label), '[-\\s]+'), lambda p: replace(replace(replace(regexp_replace(p, '[^a-z]', '', 'g'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u')) AS ys0 FROM n),
f AS (SELECT *, {_FOLD.format('x0')} AS x, {_FOLD.format('y0')} AS y, list_filter(list_transform(xs0, lambda p: {_FOLD.format('p')}), lambda p: p <> '') AS xs, list_filter(list_transform(ys0, lambda p: {_FOLD.format('p')}), lambda p: p <> '') AS ys FROM l)
SELECT p_partkey, CASE WHEN trim(surname) = '' OR regexp_full_match(label, 'Q\\d+') THEN NULL WHEN contains(lower(label), lower(surname)) THEN 'exact' WHEN x <> '' AND contains(y, x) THEN 'variant' WHEN list_has_any(xs, ys) THEN 'variant'
WHEN len(list_filter(range(1, length(y) + 1), lambda i: levenshtein(substr(y, i, length(x)), x) <= 1 OR levenshtein(substr(y, i, length(x) - 1), x) <= 1 OR levenshtein(substr(y, i, length(x) + 1), x) <= 1)) > 0 THEN 'near' ELSE 'different' END AS relation FROM f""")
def name_relations(t):
    return _name_pairs(t).select("p_partkey", text.name_relation(F.col("surname"), F.col("label")).alias("relation"))


@query("""m AS (SELECT c_custkey AS k, c_name AS name, split_part(c_name, '#', 2) AS num, CASE WHEN c_custkey % 2 = 0 THEN DATE '1950-01-01' + (c_custkey % 300)::INT END AS born FROM customer),
i AS (SELECT *, CASE WHEN k % 3 = 0 THEN born + (k % 2)::INT + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END END AS theirs, CASE WHEN k % 7 = 0 THEN 'Q' || k WHEN k % 11 = 0 THEN 'Someone Else' ELSE 'Dr ' || name END AS label FROM m WHERE k % 5 <> 0),
c AS (SELECT m.k, i.k IS NOT NULL AS claimed, CASE WHEN m.born IS NOT NULL AND i.theirs IS NOT NULL THEN m.born = i.theirs ELSE i.label <> 'Q' || i.k AND contains(lower(i.label), lower(m.name)) END AS alike FROM m LEFT JOIN i ON i.k = m.k)
SELECT k::VARCHAR AS person_key, CASE WHEN claimed AND alike THEN 'Q' || k END AS qid, CASE WHEN claimed AND NOT alike THEN 'Q' || k ELSE '' END AS mismatch FROM c""")
def corroborated_identifier(t):
    k, born = F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")))
    members = t.customer.select(k.cast("string").alias("person_key"), F.col("c_name").alias("full_name"), F.col("c_name").alias("last_name"), born.alias("birth_date"))
    theirs = F.when(k % 3 == 0, F.date_add(born, ((k % 2) + F.when(k % 12 == 0, 1).otherwise(0)).cast("int")))
    label = F.when(k % 7 == 0, F.concat(F.lit("Q"), k)).when(k % 11 == 0, "Someone Else").otherwise(F.concat(F.lit("Dr "), "c_name"))
    claims = t.customer.filter("c_custkey % 5 <> 0").select(F.concat(F.lit("Q"), k).alias("qid"), F.concat(F.lit("0"), k).alias("join_id"), theirs.alias("birth_date"), label.alias("label"))
    return resolve.by_identifier(members, claims, corroborate=True).select("person_key", "qid", F.array_join("mismatch_qids", ",").alias("mismatch"))


@query("""p AS (SELECT y AS number, make_date(y, 1, 1) AS ps, make_date(y, 12, 31) AS pe FROM (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders)),
m AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS s, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderdate)::DATE END AS e FROM orders WHERE o_custkey % 4 <> 0 GROUP BY o_custkey),
a AS (SELECT DISTINCT number, k FROM m JOIN p ON s <= pe AND (e IS NULL OR ps <= e)), v AS (SELECT DISTINCT year(o_orderdate)::INT AS number, o_custkey AS k FROM orders WHERE o_orderstatus <> 'P'),
j AS (SELECT coalesce(a.number, v.number) AS number, a.k IS NOT NULL AS assigned, v.k IS NOT NULL AS voted, m.k IS NOT NULL AS sitting, coalesce(p.pe < m.s, false) AS earlier FROM a FULL JOIN v ON a.number = v.number AND a.k = v.k LEFT JOIN m ON m.k = coalesce(a.k, v.k) LEFT JOIN p ON p.number = coalesce(a.number, v.number))
SELECT number, count_if(assigned)::BIGINT AS assigned, count_if(voted)::BIGINT AS voted, count_if(voted AND sitting)::BIGINT AS still_sitting, count_if(voted AND sitting AND earlier)::BIGINT AS earlier_mandate, count_if(voted AND sitting AND NOT assigned AND NOT earlier)::BIGINT AS not_assigned,
count_if(voted AND sitting AND NOT assigned AND NOT earlier) = 0 AS valid FROM j WHERE number IN (SELECT number FROM v) GROUP BY 1""")
def period_validation(t):
    own = t.orders.filter("o_custkey % 4 <> 0").groupBy("o_custkey").agg(F.min(day("o_orderdate")).alias("s"), F.max(day("o_orderdate")).alias("e"))
    members = own.select(F.col("o_custkey").cast("string").alias("person_key"), F.col("s").alias("date_joining"), F.lit(None).cast("date").alias("tenure_start"), F.when(F.col("o_custkey") % 2 == 0, F.col("e")).alias("date_leaving"))
    y = t.orders.select(F.year("o_orderdate").alias("number")).distinct()
    periods = y.select("number", F.make_date("number", F.lit(1), F.lit(1)).alias("start"), F.make_date("number", F.lit(12), F.lit(31)).alias("end"))
    votes = t.orders.filter("o_orderstatus <> 'P'").select(F.year("o_orderdate").alias("number"), F.col("o_custkey").alias("person_key"))
    return validate.validate(members, periods, votes)
