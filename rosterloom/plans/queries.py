"""The relational operators on the standard tables, each with the same query in DuckDB SQL.

The tables hold no roster, so they play its roles: a customer is a person, an order a mandate, a
year a legislative period, a part or supplier an item of the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rosterloom.config import PERIOD, Config
from rosterloom.functions import dates, text
from rosterloom.operators import chains, dedup, intervals, joins, profile
from rosterloom.plans import report, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@contextmanager
def registered() -> Iterator[tuple[dict, dict]]:
    """What ``query`` registers meanwhile, by itself."""
    global QUERIES, ORACLES
    before, QUERIES, ORACLES = (QUERIES, ORACLES), {}, {}
    try:
        yield QUERIES, ORACLES
    finally:
        QUERIES, ORACLES = before


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its name, with its SQL."""

    def deco(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return deco


def day(c: str):
    return F.col(c).cast("date")


def tenures(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min(day("o_orderdate")).alias("s"), F.max(day("o_orderdate")).alias("e"))


def years(t: Tables) -> DataFrame:
    y = t.orders.select(F.year("o_orderdate").alias("number")).distinct()
    return y.select("number", F.make_date("number", F.lit(1), F.lit(1)).alias("ps"), F.make_date("number", F.lit(12), F.lit(31)).alias("pe"))


_TENURE = "t AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1), y AS (SELECT DISTINCT year(o_orderdate)::INT AS number FROM orders), p AS (SELECT number, make_date(number, 1, 1) AS ps, make_date(number, 12, 31) AS pe FROM y)"


@query(f"WITH {_TENURE} SELECT o_custkey, number FROM t JOIN p ON s <= pe AND ps <= e")
def interval_overlap_join(t):
    return intervals.overlap_join(tenures(t), years(t), ("s", "e"), ("ps", "pe"), small=True).select("o_custkey", "number")


@query(f"WITH {_TENURE} SELECT number, count(*)::BIGINT AS members, min(o_custkey) AS first_member, max(o_custkey) AS last_member FROM t JOIN p ON s <= pe AND ps <= e GROUP BY 1")
def interval_overlap_count(t):
    met = intervals.overlap_join(tenures(t), years(t), ("s", "e"), ("ps", "pe"), small=True)
    return met.groupBy("number").agg(F.count("*").alias("members"), F.min("o_custkey").alias("first_member"), F.max("o_custkey").alias("last_member"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + 20 AS e FROM orders),
b AS (SELECT l_orderkey, min(l_shipdate)::DATE AS s2, max(l_shipdate)::DATE AS e2 FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, l_orderkey FROM a JOIN b ON a.s <= b.e2 AND b.s2 <= a.e AND o_orderkey = l_orderkey)
SELECT count(*)::BIGINT AS pairs, sum(o_orderkey)::BIGINT AS keys FROM j""")
def interval_overlap_two_large(t):
    a = t.orders.select("o_orderkey", day("o_orderdate").alias("s"), F.date_add(day("o_orderdate"), 20).alias("e"))
    b = t.lineitem.groupBy("l_orderkey").agg(F.min(day("l_shipdate")).alias("s2"), F.max(day("l_shipdate")).alias("e2"))
    met = a.join(b, (F.col("o_orderkey") == F.col("l_orderkey")) & intervals.covers(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")))
    return met.agg(F.count("*").alias("pairs"), F.sum("o_orderkey").alias("keys"))


@query(f"WITH {_TENURE} SELECT o_custkey, number, greatest(s, ps)::VARCHAR AS clip_start, least(e, pe)::VARCHAR AS clip_end FROM t JOIN p ON s <= pe AND ps <= e")
def interval_clip(t):
    met = intervals.overlap_join(tenures(t), years(t), ("s", "e"), ("ps", "pe"), small=True)
    a, b = intervals.clip(F.col("s"), F.col("e"), F.col("ps"), F.col("pe"))
    return met.select("o_custkey", "number", a.cast("string").alias("clip_start"), b.cast("string").alias("clip_end"))


@query(f"WITH {_TENURE}, o AS (SELECT o_custkey, s, CASE WHEN year(e) < (SELECT max(number) FROM y) THEN e END AS e FROM t) SELECT number, count(*)::BIGINT AS members, count_if(e IS NULL)::BIGINT AS open_members FROM o JOIN p ON s <= pe AND (e IS NULL OR ps <= e) GROUP BY 1")
def interval_open_ended(t):
    newest = years(t).agg(F.max("number").alias("top"))
    own = tenures(t).join(F.broadcast(newest), how="cross").withColumn("e", F.when(F.year("e") < F.col("top"), F.col("e")))
    met = intervals.overlap_join(own, years(t), ("s", "e"), ("ps", "pe"), small=True)
    return met.groupBy("number").agg(F.count("*").alias("members"), F.count_if(F.col("e").isNull()).alias("open_members"))


@query(f"WITH {_TENURE} SELECT number, count(*)::BIGINT AS members FROM t JOIN p ON e <= s AND s >= ps AND s <= pe GROUP BY 1")
def interval_reversed_is_empty(t):
    turned = tenures(t).select("o_custkey", F.col("e").alias("s"), F.col("s").alias("e"))
    return intervals.overlap_join(turned, years(t), ("s", "e"), ("ps", "pe"), small=True).groupBy("number").agg(F.count("*").alias("members"))


@query(f"WITH {_TENURE} SELECT number, ps::VARCHAR AS ps, pe::VARCHAR AS pe FROM p ORDER BY (ps <= DATE '1998-06-15' AND pe >= DATE '1998-06-15') DESC, number DESC LIMIT 1")
def current_period_pick(t):
    p = intervals.current_period(years(t), "number", "ps", "pe", F.lit("1998-06-15").cast("date"))
    return p.select("number", F.col("ps").cast("string").alias("ps"), F.col("pe").cast("string").alias("pe"))


def segments(t: Tables, end=None) -> DataFrame:
    e = F.date_add(day("o_orderdate"), 20)
    return t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", day("o_orderdate").alias("s"), (e if end is None else end(e)).alias("e"))


_RUN = """seg AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS s, {end} AS e FROM orders),
m AS (SELECT *, row_number() OVER w AS k, date_diff('day', lag(e) OVER w, s) AS gap FROM seg WINDOW w AS (PARTITION BY o_custkey ORDER BY s, o_orderkey)),
b AS (SELECT *, CASE WHEN k = 1 OR gap BETWEEN 0 AND 60 THEN 0 ELSE 1 END AS brk FROM m),
r AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM b)"""
_PLAIN_END, _OPEN_END = "o_orderdate::DATE + 20", "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 20 END"


@query(f"WITH {_RUN.format(end=_PLAIN_END)} SELECT o_custkey, min(s)::VARCHAR AS run_start FROM r WHERE later = 0 GROUP BY 1")
def current_run_start(t):
    return chains.current_runs(segments(t), ["o_custkey"], "s", "e", ["o_orderkey"], 60).groupBy("o_custkey").agg(F.min("s").cast("string").alias("run_start"))


def _tenure_rows(df: DataFrame) -> DataFrame:
    return df.select("o_custkey", F.col("tenure_start").cast("string").alias("tenure_start"), F.col("tenure_end").cast("string").alias("tenure_end"), "segments")


_TENURE_SQL = "SELECT o_custkey, min(s)::VARCHAR AS tenure_start, arg_max_null(e, (s, o_orderkey))::VARCHAR AS tenure_end, count(*)::BIGINT AS segments FROM r WHERE later = 0 GROUP BY 1"


@query(f"WITH {_RUN.format(end=_PLAIN_END)} {_TENURE_SQL}")
def latest_tenure(t):
    return _tenure_rows(chains.latest_tenures(segments(t), ["o_custkey"], "s", "e", ["o_orderkey"], 60))


@query(f"WITH {_RUN.format(end=_OPEN_END)} {_TENURE_SQL}")
def open_segment_breaks_run(t):
    return _tenure_rows(chains.latest_tenures(segments(t, lambda e: F.when(F.col("o_orderstatus") != "O", e)), ["o_custkey"], "s", "e", ["o_orderkey"], 60))


@query("SELECT o_custkey, coalesce(max(o_orderdate) FILTER (o_orderstatus = 'O'), max(o_orderdate))::DATE::VARCHAR AS current_start FROM orders GROUP BY 1")
def current_start_open_first(t):
    own = chains.current_start(segments(t), ["o_custkey"], "s", F.col("o_orderstatus") == "O")
    return own.select("o_custkey", F.col("current_start").cast("string").alias("current_start"))


def _dedup_sql(order: str) -> str:
    return f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}, o_orderkey) AS k FROM orders) WHERE k = 1"


@query(_dedup_sql("o_orderdate DESC NULLS LAST"))
def dedup_latest(t):
    return dedup.keep_latest(t.orders, ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(_dedup_sql("o_orderdate ASC NULLS LAST"))
def dedup_earliest(t):
    return dedup.keep_earliest(t.orders, ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(_dedup_sql("(o_orderstatus = 'O') DESC, o_orderdate DESC NULLS LAST"))
def dedup_active_first(t):
    return dedup.keep_active_first(t.orders, ["o_custkey"], F.col("o_orderstatus") == "O", "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_first_dated(t):
    dated = t.orders.withColumn("d", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    return dedup.keep_first_dated(dated, ["o_custkey"], "d", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def distinct_fingerprint(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").dropDuplicates()


_CLAIMS = "c AS (SELECT p_name, p_brand, count(DISTINCT p_partkey) AS claims, min(p_partkey) AS item FROM part GROUP BY 1, 2)"


@query(f"WITH {_CLAIMS} SELECT p_name, p_brand, claims::BIGINT AS claims, CASE WHEN claims = 1 THEN item END::VARCHAR AS item FROM c")
def unique_key_join(t):
    probe = t.part.select("p_name", "p_brand").distinct()
    return joins.unique_key_join(probe, t.part, ["p_name", "p_brand"], "p_partkey").withColumn("item", F.col("item").cast("string"))


@query(f"WITH {_CLAIMS} SELECT p_name, p_brand, claims::BIGINT AS claims FROM c WHERE claims > 1")
def contested_keys(t):
    return joins.collisions(t.part, ["p_name", "p_brand"], "p_partkey")


@query("SELECT p_type, p_size, min(p_brand) AS p_brand FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) = 1")
def unique_or_drop(t):
    return dedup.unique_or_drop(t.part, ["p_type", "p_size"], "p_brand")


@query("""WITH c AS (SELECT DISTINCT p_name, l_suppkey, p_partkey, p_size = s_nationkey AS agrees, p_size > 45 AS contradicts, p_brand = 'Brand#12' AS seated
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey), k AS (SELECT * FROM c WHERE NOT contradicts),
n AS (SELECT p_name, l_suppkey, count(*) AS n, count_if(agrees) AS na, count_if(seated) AS ns, min(p_partkey) FILTER (agrees) AS ia, min(p_partkey) FILTER (seated) AS is_, min(p_partkey) AS i FROM k GROUP BY 1, 2)
SELECT p_name, l_suppkey, CASE WHEN na = 1 THEN ia WHEN na > 1 THEN NULL WHEN ns = 1 THEN is_ WHEN ns = 0 AND n = 1 THEN i END::VARCHAR AS picked, n::BIGINT AS n, na::BIGINT AS n_agree, ns::BIGINT AS n_seated FROM n""")
def corroborated_pick(t):
    # candidates by name: the parts of one name that a supplier has delivered
    met = t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return joins.corroborated_pick(met, ["p_name", "l_suppkey"], "p_partkey", F.col("p_size") == F.col("s_nationkey"), F.col("p_size") > 45, F.col("p_brand") == "Brand#12").withColumn("picked", F.col("picked").cast("string"))


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS g, l_partkey AS m, l_suppkey AS i, max(l_linenumber) AS score FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY m) AS k FROM (SELECT DISTINCT g, m FROM c)),
w AS (SELECT c.*, r.k FROM c JOIN r USING (g, m)),
s(g, k, m, i, taken) AS (
  SELECT g, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT g FROM c)
  UNION ALL
  SELECT g, k, m, i, CASE WHEN i IS NULL THEN taken ELSE list_append(taken, i) END FROM (
    SELECT s.g, w.k, w.m, s.taken, arg_max(w.i, (w.score, -w.i)) FILTER (NOT list_contains(s.taken, w.i)) AS i FROM s JOIN w ON w.g = s.g AND w.k = s.k + 1 GROUP BY s.g, w.k, w.m, s.taken)
)
SELECT g AS l_orderkey, m AS l_partkey, i AS l_suppkey FROM s WHERE i IS NOT NULL""")
def greedy_assign(t):
    wanted = t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.max("l_linenumber").alias("score"))
    wanted = wanted.withColumn("ord", F.col("l_partkey"))
    return joins.greedy_assign(wanted, "l_orderkey", "l_partkey", "ord", "l_suppkey", "score")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders))
AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def reverse_walk_anti(t):
    newest = t.orders.agg(F.max(F.year("o_orderdate")).alias("top"))
    held = t.orders.join(F.broadcast(newest), F.year("o_orderdate") == F.col("top"), "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    items = t.customer.select("c_custkey", F.col("c_custkey").alias("ident"))
    return joins.reverse_walk(items, held, t.supplier.select(F.col("s_suppkey").alias("ident")), "c_custkey", "ident").select("c_custkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = (SELECT min(event_type) FROM events)) AS has_event FROM customer")
def semi_exists_flag(t):
    first = t.events.agg(F.min("event_type").alias("kind"))
    seen = t.events.join(F.broadcast(first), F.col("event_type") == F.col("kind"), "left_semi").select("user_id").distinct()
    return t.customer.join(seen, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.col("user_id").isNotNull().alias("has_event"))


@query("SELECT c_name AS name, 'customer' AS origin FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def tagged_union(t):
    return t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("origin")).unionByName(t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("origin")))


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier")
def population_union_distinct(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_suppkey", "s_nationkey")).distinct()


@query("""SELECT u.user_id, k.event_type, n IS NOT NULL AS present FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) k
LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) c ON c.user_id = u.user_id AND c.event_type = k.event_type""")
def left_presence_matrix(t):
    kinds = t.events.groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # a handful of types
    seen = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return seen.join(F.broadcast(kinds), how="cross").select("user_id", F.explode("kinds").alias("event_type"), "seen").select("user_id", "event_type", F.array_contains("seen", F.col("event_type")).alias("present"))


@query("""SELECT n_nationkey, count(DISTINCT c_custkey)::BIGINT AS customers, count(DISTINCT o_custkey)::BIGINT AS with_orders, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END)::BIGINT AS with_final
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def conditional_distinct_counts(t):
    # one row a customer before the join, so nothing is counted twice and no distinct is needed
    flags = t.orders.groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    own = t.customer.join(flags, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"), F.count("o_custkey").alias("with_orders"), F.count_if(F.col("f") == 1).alias("with_final"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return t.nation.join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", zero("customers"), zero("with_orders"), zero("with_final"))


@query("SELECT n_orders, n_statuses, count(*)::BIGINT AS people FROM (SELECT o_custkey, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(DISTINCT o_orderstatus)::BIGINT AS n_statuses FROM orders GROUP BY 1) GROUP BY 1, 2")
def two_level_histogram(t):
    return t.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.count_distinct("o_orderstatus").alias("n_statuses")).groupBy("n_orders", "n_statuses").agg(F.count("*").alias("people"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def topk_by_distinct_count(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers")).orderBy(F.desc("suppliers"), "l_partkey").limit(25)


@query("SELECT l_orderkey, min(l_linenumber) AS first_line, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1")
def fold_fanout(t):
    own = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("sk"))
    return dedup.fold_fanout(own, ["l_orderkey"], {"first_line": "l_linenumber"}, {"s": "sk"}, "l_linenumber").select("l_orderkey", "first_line", F.array_join("s", ",").alias("suppliers"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def lookup_lateral_top1(t):
    return dedup.top1(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH w AS (SELECT user_id, bool_or(day(ts) <= 7) AS a, bool_or(day(ts) BETWEEN 8 AND 14) AS b FROM events GROUP BY 1)
SELECT count_if(a)::BIGINT AS week_a, count_if(b)::BIGINT AS week_b, count_if(a AND b)::BIGINT AS both_weeks, count_if(a AND NOT b)::BIGINT AS left_off, count_if(b AND NOT a)::BIGINT AS joined FROM w""")
def set_algebra_metrics(t):
    d = F.dayofmonth("ts")
    w = t.events.groupBy("user_id").agg(F.bool_or(d <= 7).alias("a"), F.bool_or(d.between(8, 14)).alias("b"))
    n = lambda x, name: F.count_if(x).alias(name)
    a, b = F.col("a"), F.col("b")
    return w.agg(n(a, "week_a"), n(b, "week_b"), n(a & b, "both_weeks"), n(a & ~b, "left_off"), n(b & ~a, "joined"))


_TWO = """l AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS total, min(l_shipdate)::DATE AS ship FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS ours, total AS theirs, o_orderdate::DATE AS s, ship FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)"""


def two_sources(t: Tables) -> DataFrame:
    theirs = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("theirs"), F.min(day("l_shipdate")).alias("ship"))
    ours = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("ours"), day("o_orderdate").alias("s"), "o_orderstatus")
    return ours.join(theirs, F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query(f"WITH {_TWO} SELECT count(*)::BIGINT AS n, count(theirs)::BIGINT AS joined, count_if(ours = theirs)::BIGINT AS agree, count_if(ours > theirs)::BIGINT AS ours_larger, count_if(ours < theirs)::BIGINT AS theirs_larger FROM j")
def two_source_agreement(t):
    n = lambda x, name: F.count_if(x).alias(name)
    o, h = F.col("ours"), F.col("theirs")
    return two_sources(t).agg(F.count("*").alias("n"), F.count("theirs").alias("joined"), n(o == h, "agree"), n(o > h, "ours_larger"), n(o < h, "theirs_larger"))


@query(f"""WITH {_TWO}, d AS (SELECT o_orderkey, concat_ws('+', CASE WHEN ours <> theirs THEN 'amount' END, CASE WHEN ship < s THEN 'ships_before_order' END, CASE WHEN date_diff('day', s, ship) > 60 THEN 'late' END) AS kinds FROM j)
SELECT kinds, count(*)::BIGINT AS n FROM d GROUP BY 1""")
def disagreement_kinds(t):
    kinds = F.concat_ws("+", F.when(F.col("ours") != F.col("theirs"), "amount"), F.when(F.col("ship") < F.col("s"), "ships_before_order"), F.when(dates.gap_days(F.col("s"), F.col("ship")) > 60, "late"))
    return two_sources(t).groupBy(kinds.alias("kinds")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, 'REVIEW' AS kind, 1 AS priority FROM orders WHERE o_orderstatus = 'P' UNION ALL
SELECT o_orderkey, 'ADD_END', 2 FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT o_orderkey, 'QUALIFIER', 4 FROM orders WHERE o_orderpriority LIKE '1-%')
SELECT kind, priority, o_orderkey, row_number() OVER (ORDER BY priority, o_orderkey, kind)::BIGINT AS seq FROM r""")
def rule_union_ordered(t):
    rule = lambda where, kind, priority: t.orders.filter(where).select(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), "o_orderkey")
    rows = rule("o_orderstatus = 'P'", "REVIEW", 1).unionByName(rule("o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01'", "ADD_END", 2)).unionByName(rule("o_orderpriority LIKE '1-%'", "QUALIFIER", 4))
    return profile.numbered(rows, ["priority", "o_orderkey", "kind"], "seq")


@query(f"WITH {_TWO} SELECT o_orderkey, ours <> theirs AS differs, max(CASE WHEN ours <> theirs THEN 1 ELSE 0 END) OVER (PARTITION BY s)::INT AS day_disputed FROM j")
def stamp_flags(t):
    own = two_sources(t)
    disputed = own.groupBy("s").agg(F.max(F.when(F.col("ours") != F.col("theirs"), 1).otherwise(0)).alias("day_disputed"))
    return own.join(disputed, "s").select("o_orderkey", (F.col("ours") != F.col("theirs")).alias("differs"), "day_disputed")


def command_findings(t: Tables) -> DataFrame:
    """Orders as findings of all kinds: what a kind needs is there or not by rules of the order's number."""
    k, d = F.col("o_orderkey"), day("o_orderdate")
    kinds = F.array(*[F.lit(x) for x in ("ADD_MEMBERSHIP", "ADD_START_DATE", "ADD_END_DATE", "ADD_TERM", "ADD_QUALIFIER", "REVIEW_ENDED", "FIX_START_DATE")])
    p = rules.payload(
        position=F.when(k % 11 != 0, "Q1"), start=F.when(k % 5 != 0, d), end=F.when(k % 3 == 0, F.date_add(d, 9)), terms=F.when(k % 4 < 2, F.array(F.lit("Q80"), F.lit("Q81"))), district=F.when(k % 6 == 0, "Q50"), group=F.when(k % 9 == 0, "Q70"),
        biography=F.when(k % 13 != 0, F.concat(F.lit("https://example.org/"), k)), sources_disagree=F.when(k % 17 == 0, True), identifier_unverified=F.when(k % 19 == 0, True), ambiguous_statement=F.when(k % 8 == 0, True),
    )
    return t.orders.select("o_orderkey", F.try_element_at(kinds, (k % 7 + 1).cast("int")).alias("kind"), F.when(k % 23 != 0, F.concat(F.lit("Q"), "o_custkey")).alias("person_qid"), F.when(k % 29 == 0, "name").otherwise("identifier").alias("qid_source"), p.alias("payload"))


_FOUND = """f AS (SELECT o_orderkey AS k, ['ADD_MEMBERSHIP', 'ADD_START_DATE', 'ADD_END_DATE', 'ADD_TERM', 'ADD_QUALIFIER', 'REVIEW_ENDED', 'FIX_START_DATE'][o_orderkey % 7 + 1] AS kind,
CASE WHEN o_orderkey % 23 <> 0 THEN 'Q' || o_custkey END AS qid, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + 9 END AS e, o_orderkey % 4 < 2 AS termed, o_orderkey % 6 = 0 AS dis, o_orderkey % 9 = 0 AS grp FROM orders),
g AS (SELECT *, k % 29 <> 0 AND qid IS NOT NULL AND k % 13 <> 0 AND k % 11 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND (kind = 'ADD_MEMBERSHIP' OR k % 8 <> 0) AND CASE WHEN kind IN ('ADD_MEMBERSHIP', 'ADD_START_DATE') THEN s IS NOT NULL WHEN kind = 'ADD_END_DATE' THEN e IS NOT NULL WHEN kind = 'ADD_TERM' THEN termed WHEN kind = 'ADD_QUALIFIER' THEN dis OR grp ELSE false END AS tenure FROM f)"""


@query(f"WITH {_FOUND} SELECT k AS o_orderkey, tenure AS mechanical, tenure AND (kind = 'ADD_MEMBERSHIP' OR termed) AS mechanical_by_period FROM g")
def gate_mechanical(t):
    found = command_findings(t)
    return found.select("o_orderkey", rules.mechanical(Config()).alias("mechanical"), rules.mechanical(Config(statement_model=PERIOD)).alias("mechanical_by_period"))


@query(f"""WITH {_FOUND}, p AS (SELECT *, 'P580|+' || strftime(s, '%Y-%m-%d') || 'T00:00:00Z/11' AS ps, 'P582|+' || strftime(e, '%Y-%m-%d') || 'T00:00:00Z/11' AS pe, CASE WHEN termed THEN 'P2937|Q80|P2937|Q81' END AS pt, CASE WHEN dis THEN 'P768|Q50' END AS pd, CASE WHEN grp THEN 'P4100|Q70' END AS pg FROM g WHERE tenure)
SELECT k AS o_orderkey, concat_ws('|', qid, 'P39', 'Q1', CASE kind WHEN 'ADD_MEMBERSHIP' THEN concat_ws('|', ps, pe, pd, pg, pt) WHEN 'ADD_START_DATE' THEN concat_ws('|', pt, ps) WHEN 'ADD_END_DATE' THEN concat_ws('|', pt, pe) WHEN 'ADD_TERM' THEN pt ELSE concat_ws('|', pt, pd, pg) END, 'S854', '"https://example.org/' || k || '"', 'S813', '+2026-01-02T00:00:00Z/11') AS line FROM p""")
def render_lines(t):
    return command_findings(t).filter(rules.mechanical(Config())).select("o_orderkey", rules.command(F.lit("2026-01-02").cast("date")).alias("line"))


@query("""SELECT 'doc_id' AS column_name, count(doc_id)::BIGINT AS filled FROM documents UNION ALL SELECT 'text', count(nullif(trim(text, ' '), ''))::BIGINT FROM documents
UNION ALL SELECT 'lang', count(nullif(trim(lang, ' '), ''))::BIGINT FROM documents UNION ALL SELECT 'source', count(nullif(trim(source, ' '), ''))::BIGINT FROM documents UNION ALL SELECT 'n_chars', count(n_chars)::BIGINT FROM documents""")
def coverage_profile(t):
    return profile.column_coverage(t.documents)


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def histogram_topn(t):
    return profile.histogram(t.events, "event_type", 12)


@query("""SELECT count(*)::BIGINT AS n_rows, count_if(o_orderdate IS NOT NULL)::BIGINT AS dated, count_if(o_orderdate IS NOT NULL AND o_orderstatus = 'O')::BIGINT AS open_rows,
count_if(o_orderdate IS NOT NULL AND o_orderstatus = 'O' AND o_totalprice > 1000)::BIGINT AS large FROM orders""")
def stage_funnel(t):
    return profile.funnel(t.orders, [("dated", F.col("o_orderdate").isNotNull()), ("open_rows", F.col("o_orderstatus") == "O"), ("large", F.col("o_totalprice") > 1000)])


@query("""WITH k AS (SELECT p_name, p_brand, list(DISTINCT p_type) AS types FROM part GROUP BY 1, 2),
n AS (SELECT p_name, count(*) AS keys FROM k GROUP BY 1), o AS (SELECT p_name FROM (SELECT p_name, p_type, count(DISTINCT p_brand) AS c FROM part GROUP BY 1, 2) GROUP BY 1 HAVING max(c) > 1)
SELECT n.p_name, keys::BIGINT AS keys, CASE WHEN keys = 1 THEN 'one' WHEN o.p_name IS NULL THEN 'namesakes' ELSE 'split' END AS quality FROM n LEFT JOIN o USING (p_name)""")
def key_quality(t):
    return profile.key_quality(t.part, "p_name", "p_brand", "p_type")


_VERDICT = "CASE WHEN n < 10 THEN 'INCONCLUSIVE' WHEN bad * 20 > n THEN 'CONTRADICTED' ELSE 'CONFIRMED' END"


@query(f"WITH v AS (SELECT source, count(*) AS n, count_if(quality = 0) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, n::BIGINT AS n, bad::BIGINT AS bad, {_VERDICT} AS verdict FROM v")
def verdict_ladder(t):
    return _verdicts(t)


def _verdicts(t: Tables) -> DataFrame:
    v = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("bad"))
    return v.withColumn("verdict", profile.verdict((F.col("n") < 10, profile.INCONCLUSIVE), (F.col("bad") * 20 > F.col("n"), profile.CONTRADICTED)))


@query(f"WITH v AS (SELECT source, count(*) AS n, count_if(quality = 0) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT {_VERDICT} AS verdict FROM v) SELECT CASE max(CASE verdict WHEN 'CONTRADICTED' THEN 2 WHEN 'INCONCLUSIVE' THEN 1 ELSE 0 END) WHEN 2 THEN 'CONTRADICTED' WHEN 1 THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END AS verdict FROM w")
def worst_verdict(t):
    return profile.worst(_verdicts(t), "verdict")


@query("""SELECT 's_suppkey' AS column_name, count(DISTINCT s_suppkey)::BIGINT AS people FROM supplier WHERE s_suppkey::VARCHAR = s_nationkey::VARCHAR HAVING count(*) > 0
UNION ALL SELECT 's_nationkey', count(DISTINCT s_suppkey)::BIGINT FROM supplier HAVING count(*) > 0""")
def column_hunt(t):
    wanted = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("wanted"))
    return joins.column_hunt(t.supplier.withColumn("key_text", F.col("s_suppkey")), "s_suppkey", wanted, "wanted", ["key_text", "s_nationkey", "s_name"]).select(F.when(F.col("column_name") == "key_text", "s_suppkey").otherwise(F.col("column_name")).alias("column_name"), "people")


@query("""WITH a AS (SELECT r_regionkey AS rk, min(n_nationkey) AS k FROM region JOIN nation ON n_nationkey = r_regionkey GROUP BY 1),
b AS (SELECT r_regionkey AS rk, min(n_nationkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) = 1)
SELECT r_regionkey, CASE WHEN a.k IS NULL AND b.k IS NULL THEN NULL WHEN a.k <> b.k THEN NULL ELSE coalesce(a.k, b.k) END AS n_nationkey,
CASE WHEN a.k IS NULL AND b.k IS NULL THEN 'unmatched' WHEN a.k <> b.k THEN 'conflict' ELSE 'matched' END AS verdict FROM region LEFT JOIN a ON a.rk = r_regionkey LEFT JOIN b ON b.rk = r_regionkey""")
def two_signal_align(t):
    left = t.region.select("r_regionkey", F.col("r_regionkey").alias("s1"), F.col("r_regionkey").alias("s2"))
    right = t.nation.select("n_nationkey", F.col("n_nationkey").alias("t1"), F.col("n_regionkey").alias("t2"))
    return joins.two_signal_align(left, right, "r_regionkey", "n_nationkey", ("s1", "t1"), ("s2", "t2"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT a.w AS left_word, b.w AS right_word FROM w a JOIN w b ON a.w < b.w AND levenshtein(a.w, b.w) <= 1""")
def near_name(t):
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    keyed = words.select("w", F.explode(text.one_edit_keys(F.col("w"))).alias("key"))
    met = keyed.withColumnRenamed("w", "left_word").join(keyed.withColumnRenamed("w", "right_word"), "key").filter("left_word < right_word")
    return met.select("left_word", "right_word").distinct().filter(text.within_one_edit(F.col("left_word"), F.col("right_word")))


_LETTERS = r"regexp_replace(strip_accents(replace(replace(replace(replace(lower(regexp_replace(raw, '\([^)]*\)', ' ', 'g')), 'ä', 'a'), 'ö', 'o'), 'ü', 'u'), 'ß', 'ss')), '[^a-z]', '', 'g')"


@query(f"""WITH n AS (SELECT doc_id, split_part(text, ' ', 1) || ' (x) ' || lang AS raw FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, replace(replace(replace({_LETTERS}, 'ae', 'a'), 'oe', 'o'), 'ue', 'u') AS x FROM n)
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, length(x) + 1), lambda i: i = 1 OR x[i] <> x[i - 1]), lambda i: x[i]), '') AS letters FROM l""")
def fold_name(t):
    return t.documents.filter("text IS NOT NULL").select("doc_id", text.surname_fold(F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" (x) "), "lang")).alias("letters"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(string_split_regex(lower(p_name), '\\W+'), lambda x: x <> '')), ' ') AS name_key FROM part")
def name_key(t):
    return t.part.select("p_partkey", text.name_key(F.col("p_name")).alias("name_key"))


@query(r"""WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' (AB), ' || c_name || ' (CD)' WHEN 1 THEN c_mktsegment || ', ' || c_name || ' (CD)' WHEN 2 THEN ' ; ' || c_mktsegment || ';;' ELSE c_name || ' ; X (ZH),Y (BE)' END AS x FROM customer),
p AS (SELECT k, x, list_filter(list_transform(string_split(x, ';'), lambda y: trim(y, ' ')), lambda y: y <> '') AS parts FROM r)
SELECT k, len(parts)::BIGINT AS parts, array_to_string(flatten(list_transform(parts, lambda y: CASE WHEN contains(y, ',') AND len(list_filter(string_split(y, ','), lambda z: NOT regexp_full_match(trim(z, ' '), '.+\([A-Z]{2}\)'))) = 0 THEN list_transform(string_split(y, ','), lambda z: trim(z, ' ')) ELSE [y] END)), '|') AS places FROM p""".replace("\\\\", "\\"))
def split_rules(t):
    k, seg, name = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")
    x = F.when(k % 4 == 0, F.concat(seg, F.lit(" (AB), "), name, F.lit(" (CD)"))).when(k % 4 == 1, F.concat(seg, F.lit(", "), name, F.lit(" (CD)"))).when(k % 4 == 2, F.concat(F.lit(" ; "), seg, F.lit(";;"))).otherwise(F.concat(name, F.lit(" ; X (ZH),Y (BE)")))
    own = t.customer.select(k.alias("k"), x.alias("x"))
    return own.select("k", F.size(text.split_list(F.col("x"))).cast("bigint").alias("parts"), F.array_join(text.origin_places(F.col("x")), "|").alias("places"))


@query(r"""WITH s AS (SELECT o_orderkey AS k, o_orderdate AS d, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' WHEN 4 THEN strftime(o_orderdate, '%Y') || '-02-30' WHEN 5 THEN '1753-01-01T00:00:00' WHEN 6 THEN strftime(o_orderdate, '%Y%m%d') ELSE '9999-12-31' END AS raw FROM orders),
i AS (SELECT *, CASE WHEN regexp_matches(raw, '^\d{4}-\d{2}-\d{2}([T ].*)?$') THEN try_cast(substr(raw, 1, 10) AS DATE) END AS iso FROM s),
c AS (SELECT *, coalesce(iso, CASE WHEN regexp_full_match(raw, '\d{8}') THEN try_cast(substr(raw, 1, 4) || '-' || substr(raw, 5, 2) || '-' || substr(raw, 7, 2) AS DATE) END) AS compact FROM i)
SELECT k AS o_orderkey, raw, iso::VARCHAR AS parsed, CASE WHEN iso > DATE '1753-01-01' THEN iso END::VARCHAR AS federal, compact::VARCHAR AS compact, CASE WHEN compact < DATE '2900-01-01' THEN compact END::VARCHAR AS stop,
CASE WHEN k % 3 <> 0 THEN try_cast(strftime(d, '%Y') || '-' || lpad((k % 14)::VARCHAR, 2, '0') || '-' || lpad((k % 33)::VARCHAR, 2, '0') AS DATE) END::VARCHAR AS composed, CASE WHEN year(d) BETWEEN 1850 AND 1998 THEN year(d)::INT END AS plausible FROM c""".replace("\\\\", "\\"))
def date_guard(t):
    k, f = F.col("o_orderkey") % 8, lambda p: F.date_format("o_orderdate", p)
    raw = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy-MM")).when(k == 2, f("yyyy")).when(k == 3, F.concat(f("yyyy-MM-dd"), F.lit("T00:00:00"))).when(k == 4, F.concat(f("yyyy"), F.lit("-02-30"))).when(k == 5, "1753-01-01T00:00:00").when(k == 6, f("yyyyMMdd")).otherwise("9999-12-31")
    x, n = F.col("raw"), F.col("o_orderkey")
    made = {"parsed": dates.iso_date(x), "federal": dates.federal_date(x), "compact": dates.compact_date(x), "stop": dates.open_end(x), "composed": dates.composed_date(F.col("y"), F.when(n % 3 != 0, n % 14), n % 33)}
    own = t.orders.select("o_orderkey", raw.alias("raw"), f("yyyy").alias("y"))
    return own.select("o_orderkey", "raw", *[c.cast("string").alias(name) for name, c in made.items()], dates.plausible_year(F.col("y"), 1998).alias("plausible"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '1.5' ELSE c_custkey::VARCHAR END AS ident FROM customer")
def id_normalise(t):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.lit(" 1.5 ")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" +00"), "c_custkey")).otherwise(F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return t.customer.select("c_custkey", text.id_normal(raw).alias("ident"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(r"SELECT page_id, nullif(regexp_extract(url, '/(\d+)', 1), '') AS ident FROM pages")
def url_id_extract(t):
    return t.pages.select("page_id", F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).alias("ident"))


@query(r"SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def html_fields(t):
    get = lambda p, name: F.nullif(F.regexp_extract("html", p, 1), F.lit("")).alias(name)
    return t.pages.select("page_id", get('<html lang="([^"]*)"', "lang"), get("<title>([^<]*)</title>", "title"))


@query("""WITH g AS (SELECT CASE WHEN c_nationkey % 4 = 0 THEN 'Other' ELSE n_name END AS grp, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT grp, count(*)::BIGINT AS n FROM g GROUP BY 1) SELECT grp, n, row_number() OVER (ORDER BY grp = 'Other', lower(grp))::BIGINT AS pos FROM c""")
def group_other_last(t):
    found = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).select(F.when(F.col("c_nationkey") % 4 != 0, F.col("n_name")).alias("constituency"))
    groups = report.grouped(found).groupBy("group", "group_place").agg(F.count("*").alias("n"))
    return groups.select(F.col("group").alias("grp"), "n", F.row_number().over(Window.orderBy("group_place")).cast("bigint").alias("pos"))  # a row a group


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def limit_per_group(t):
    return dedup.limit_per_key(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey")
