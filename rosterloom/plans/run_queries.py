"""What a run and its probes do at size, on the standard tables, each with its SQL: two large sides of intervals, lookups by
period, names settled in order, people who left in three sources, labels and pairs of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.config import Config
from rosterloom.functions import text
from rosterloom.operators import dedup, intervals, profile
from rosterloom.plans import departures, resolve, rules, verdicts
from rosterloom.plans.queries import Tables, day, query, registered
from rosterloom.plans.roster_queries import BODY, TODAY
from rosterloom.sources.base import as_members, empty, shaped

with registered() as (QUERIES, ORACLES):

    @query("""WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS s, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + CASE WHEN o_orderkey % 500 = 0 THEN 700 ELSE 2 END ELSE o_orderdate::DATE END AS e FROM orders),
b AS (SELECT l_orderkey, l_shipdate::DATE AS s2, l_shipdate::DATE + (l_linenumber % 4)::INT AS e2 FROM lineitem WHERE l_quantity <= 25)
SELECT year(s)::INT AS y, count(*)::BIGINT AS pairs, sum(o_orderkey)::BIGINT AS lefts, sum(l_orderkey)::BIGINT AS rights, count_if(s2 < s)::BIGINT AS begun_before FROM a JOIN b ON s <= e2 AND s2 <= e GROUP BY 1""")
    def interval_overlap_sweep(t):
        long = F.when(F.col("o_orderkey") % 500 == 0, 700).otherwise(2)
        a = t.orders.select("o_orderkey", day("o_orderdate").alias("s"), F.when(F.col("o_orderstatus") != "P", F.date_add(day("o_orderdate"), long)).otherwise(day("o_orderdate")).alias("e"))
        b = t.lineitem.filter("l_quantity <= 25").select("l_orderkey", day("l_shipdate").alias("s2"), F.date_add(day("l_shipdate"), (F.col("l_linenumber") % 4).cast("int")).alias("e2"))
        # rows of the same days meet the same rows: each interval is swept once, with the number and the sum of its rows, as pairs grow with the square of a day's rows
        a = a.groupBy("s", "e").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        b = b.filter("e2 IS NOT NULL").groupBy("s2", "e2").agg(F.count("*").alias("n2"), F.sum("l_orderkey").alias("keys2"))
        met = intervals.overlap_join(a, b, ("s", "e"), ("s2", "e2"))
        pairs = F.col("n") * F.col("n2")
        return met.groupBy(F.year("s").alias("y")).agg(
            F.sum(pairs).alias("pairs"), F.sum(F.col("keys") * F.col("n2")).alias("lefts"), F.sum(F.col("keys2") * F.col("n")).alias("rights"), F.sum(F.when(F.col("s2") < F.col("s"), pairs).otherwise(0)).alias("begun_before"),
        )

    @query("""WITH p AS (SELECT DISTINCT date_trunc('month', ts)::DATE + (user_id % 40)::INT AS d FROM events), v AS (SELECT ts::DATE AS d, ts, event_id FROM events WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS k FROM v) SELECT p.d::VARCHAR AS period, r.event_id AS vote_id FROM p JOIN r ON r.d = p.d AND k = 1""")
    def lateral_first_vote(t):
        periods = t.events.select(F.date_add(F.trunc("ts", "month"), (F.col("user_id") % 40).cast("int")).alias("d")).distinct()
        votes = t.events.filter("event_type = 'purchase'").select(day("ts").alias("vd"), "ts", "event_id")
        return dedup.first_of_each(periods, votes, "d", "vd", ["ts", "event_id"]).select(F.col("d").cast("string").alias("period"), F.col("event_id").alias("vote_id"))

    _LADDER = "CASE WHEN count_if(agrees) = 1 THEN min(q) FILTER (agrees) WHEN count_if(agrees) > 1 THEN NULL WHEN count_if(seated) = 1 THEN min(q) FILTER (seated) WHEN count_if(seated) = 0 AND count(q) = 1 THEN min(q) END"

    @query(f"""WITH RECURSIVE m AS (SELECT c_custkey AS ord, row_number() OVER (ORDER BY c_custkey) AS k, c_custkey % 125 AS nm, CASE WHEN c_custkey % 3 = 0 THEN DATE '1970-01-01' + (c_custkey % 7)::INT END AS born FROM customer),
i AS (SELECT 'Q' || p_partkey AS q, unnest([p_partkey % 125, p_partkey * 7 % 125]) AS nm, CASE WHEN p_size % 4 = 0 THEN DATE '1970-01-01' + (p_size % 7)::INT END AS b, p_brand LIKE '%1' AS seated FROM part WHERE p_size <= 5),
c AS (SELECT DISTINCT k, q, seated, coalesce(b = born, false) AS agrees FROM m JOIN i USING (nm) WHERE b IS NULL OR born IS NULL OR b = born),
s(k, ord, pick, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[]
  UNION ALL SELECT k, ord, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM (
    SELECT m.k, m.ord, s.taken, {_LADDER.replace('agrees', 'c.agrees').replace('seated', 'c.seated').replace('(q)', '(c.q)')} AS pick
    FROM s JOIN m ON m.k = s.k + 1 LEFT JOIN c ON c.k = m.k AND NOT list_contains(s.taken, c.q) GROUP BY m.k, m.ord, s.taken)
) SELECT ord, pick AS qid FROM s WHERE pick IS NOT NULL""")
    def resolve_names(t):
        k, p = F.col("c_custkey"), F.col("p_partkey")
        epoch = F.lit("1970-01-01").cast("date")
        name = lambda x: F.concat(F.lit("Ann N"), x)
        people = t.customer.select(
            k.alias("ord"), name(k % 125).alias("full_name"), F.when(k % 3 == 0, F.date_add(epoch, (k % 7).cast("int"))).alias("birth_date"), F.lit(None).cast("string").alias("qid"), F.lit(None).cast("string").alias("qid_source"),
        )
        items = t.part.filter("p_size <= 5").select(
            F.explode(F.array(p % 125, p * 7 % 125)).alias("n"), F.concat(F.lit("Q"), p).alias("qid"), F.when(F.col("p_size") % 4 == 0, F.date_add(epoch, (F.col("p_size") % 7).cast("int"))).alias("birth_date"), F.col("p_brand").endswith("1").alias("has_position"),
        )
        return resolve.by_name(people, items.withColumn("name", name(F.col("n")))).filter("qid IS NOT NULL").select("ord", "qid")

    def _left(t: Tables):
        """The departures of the chamber of all customers: an item each, an open statement for three of four, a spell in the source
        for all but those divisible by seven, and a second source that differs for some."""
        k = F.col("k")
        own = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min(day("o_orderdate")).alias("s"), F.max(day("o_orderdate")).alias("e"))
        people = own.join(t.customer.select(F.col("c_custkey").alias("_c"), F.col("c_name").alias("name")), k == F.col("_c"))
        null, qid = F.lit(None), F.concat(F.lit("Q"), k)
        items = shaped(people.select(qid.alias("qid"), F.concat(F.lit("Ann "), F.when(k % 10 == 0, F.lit("Somebody")).otherwise(F.col("name"))).alias("label"), F.concat(F.lit("0"), k).alias("join_id"), null.alias("birth_date"), null.alias("identifiers"), null.alias("parties"), null.alias("properties"), F.lit(False).alias("person_data_known")), schema.ITEMS)
        spells = people.select(F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"), "*")
        statements = shaped(spells.select(k.alias("ord"), F.concat_ws("-", k, "n").alias("statement_id"), qid.alias("qid"), F.lit("Q1").alias("position_qid"), F.when(k % 6 != 0, F.date_add("s", (k % 2).cast("int"))).alias("start"), F.when((k % 4 == 0) | (F.col("n") == 1), F.col("e")).alias("end"), null.alias("districts"), null.alias("groups"), null.alias("terms")), schema.STATEMENTS)
        tenures = shaped(people.filter("k % 7 <> 0").select(k.alias("person_key"), F.lit("NR").alias("council"), F.col("s").alias("start"), F.when(k % 9 != 0, F.col("e")).alias("end")), schema.TENURES)
        spans = shaped(people.filter("k % 3 <> 0").select(qid.alias("qid"), F.lit("nr").alias("council"), F.col("s").alias("start"), F.date_add("e", F.when(k % 8 == 1, 1).otherwise(0)).alias("end"), F.array(k).alias("person_ids")), schema.SPANS)
        members = as_members(people.filter("k % 11 = 0"), ord=k, person_key=k, council=F.lit("NR"), full_name=F.col("name"), active=F.lit(True), date_joining=F.col("s")).withColumn("qid", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("Q"), "ord")))
        return people, items, statements, tenures, spans, members

    def _departures(t: Tables):
        people, items, statements, tenures, spans, members = _left(t)
        return departures.departures(BODY, items, statements, tenures, spans, members)

    _GONE = """p AS (SELECT o_custkey AS k, c_name AS name, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
d AS (SELECT *, k % 7 <> 0 AS reachable, k % 7 <> 0 AND k % 9 <> 0 AS dated, k % 3 <> 0 AS other, e + CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END AS oe, CASE WHEN k % 6 <> 0 THEN s + (k % 2)::INT END AS gs FROM p WHERE k % 4 <> 0 AND k % 11 <> 0)"""
    _SAID = "CASE WHEN {bad} THEN 'CONTRADICTED' WHEN {open} THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END AS verdict"

    @query(f"WITH {_GONE}, n AS (SELECT count(*)::BIGINT AS people, count_if(reachable)::BIGINT AS reachable, count_if(dated)::BIGINT AS with_date FROM d) SELECT *, {_SAID.format(bad='people > 0 AND reachable = 0', open='people = 0')} FROM n")
    def departures_reach(t):
        return departures.reach(_departures(t))

    @query(f"""WITH {_GONE}, j AS (SELECT k % 10 = 0 AS odd, s FROM d WHERE reachable), n AS (SELECT count(*)::BIGINT AS people, count(*)::BIGINT AS judged, 0::BIGINT AS near_names, count_if(odd)::BIGINT AS other_names FROM j)
SELECT *, {_SAID.format(bad='other_names > 0', open='judged = 0')} FROM n""")
    def departures_identity(t):
        names = t.customer.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("string").alias("person_key"), F.col("c_name").alias("surname"))
        return departures.identity(_departures(t), names)

    @query(f"""WITH {_GONE}, n AS (SELECT count(*)::BIGINT AS people, count_if(dated AND other)::BIGINT AS comparable, count_if(dated AND other AND e = oe)::BIGINT AS agree, 0::BIGINT AS reversed_spans FROM d)
SELECT *, CASE WHEN comparable < 5 THEN 'INCONCLUSIVE' WHEN agree < comparable THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS verdict FROM n""")
    def departures_dates(t):
        return departures.leaving_dates(_departures(t))

    @query(f"""WITH {_GONE}, n AS (SELECT count(*)::BIGINT AS people, count_if(k % 5 = 0)::BIGINT AS several_statements, count_if(reachable AND gs IS NOT NULL)::BIGINT AS both_starts, count_if(reachable AND gs <> s)::BIGINT AS starts_differ FROM d)
SELECT *, {_SAID.format(bad='starts_differ > 0', open='people = 0')} FROM n""")
    def departures_statements(t):
        return departures.statement_ambiguity(_departures(t))

    @query(f"""WITH {_GONE} SELECT 'ADD_END_DATE' AS kind, 'Ann ' || CASE WHEN k % 10 = 0 THEN 'Somebody' ELSE name END AS member_label, 'Q' || k AS person_qid, CASE WHEN k % 5 = 0 THEN true END AS ambiguous,
CASE WHEN reachable THEN s END::VARCHAR AS start, CASE WHEN dated THEN e END::VARCHAR AS stop,
CASE WHEN dated THEN 'open on the graph; the source has the seat from ' || s || ' to ' || e WHEN reachable THEN 'open on the graph; the source has the seat from ' || s || ' without an end' ELSE 'open on the graph; the source does not list the person' END AS detail FROM d""")
    def roster_departed(t):
        people, items, statements, tenures, spans, members = _left(t)
        members = members.withColumn("duplicate_qids", F.array().cast("array<string>")).withColumn("qid_source", F.when(F.col("qid").isNotNull(), "identifier"))
        members = members.withColumn("qid", F.coalesce("qid", F.concat(F.lit("Q"), "ord")))
        items = items.withColumn("join_id", text.id_normal(F.col("join_id")))
        _, _, gone = rules.reverse_findings(members, items, statements, tenures, empty(t.spark, schema.LINK_CONFLICTS), Config(biography_url="https://example.org/{id}"), BODY)
        return gone.select("kind", "member_label", "person_qid", F.col("payload.ambiguous_statement").alias("ambiguous"), F.col("payload.start").cast("string").alias("start"), F.col("payload.end").cast("string").alias("stop"), "detail")

    @query("""WITH m AS (SELECT c_custkey AS k, c_name AS name, min(o_orderdate)::DATE AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT 'ADD_IDENTIFIER' AS kind, name AS member_label, 'add P1307 ' || k || ' (matched by name: confirm the person)' AS detail, true AS unverified FROM m WHERE k % 4 = 0 AND k % 8 <> 0
UNION ALL SELECT 'ADD_MEMBERSHIP', name, 'no statement for this seat; held since ' || s || CASE WHEN k % 4 = 0 THEN ' (matched by name: confirm the person)' ELSE '' END, true FROM m WHERE k % 4 < 2
UNION ALL SELECT 'NO_WIKIDATA_ITEM', name, 'no item was found by identifier or by name', NULL FROM m WHERE k % 4 >= 2""")
    def roster_unverified(t):
        k = F.col("k")
        people = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min(day("o_orderdate")).alias("s")).join(t.customer, k == F.col("c_custkey"))
        members = as_members(people, ord=k, person_key=k, council=F.lit("NR"), full_name=F.col("c_name"), active=F.lit(True), date_joining=F.col("s")).withColumn("duplicate_qids", F.array().cast("array<string>"))
        known = F.col("ord") % 4 < 2
        members = members.withColumns({"qid": F.when(known, F.concat(F.lit("Q"), "ord")), "qid_source": F.when(F.col("ord") % 4 == 0, "name").when(known, "identifier")})
        null = F.lit(None)
        items = shaped(people.filter("k % 4 < 2").select(F.concat(F.lit("Q"), k).alias("qid"), F.col("c_name").alias("label"), F.when((k % 4 == 1) | (k % 8 == 0), k).alias("join_id"), null.alias("birth_date"), null.alias("identifiers"), null.alias("parties"), null.alias("properties"), F.lit(False).alias("person_data_known")), schema.ITEMS)
        none = lambda s: empty(t.spark, s)
        config = Config(biography_url="https://example.org/{id}", identifier_verified=False)
        periods = shaped(t.spark.range(1).select(F.lit(1).alias("number"), F.lit("all").alias("name"), null.alias("start"), null.alias("end")), schema.PERIODS)
        found = rules.findings(BODY, members, items, none(schema.STATEMENTS), periods, config, F.lit(TODAY).cast("date"), none(schema.TENURES), none(schema.LINK_CONFLICTS), none(schema.SPANS))
        return found.select("kind", "member_label", "detail", F.col("payload.identifier_unverified").alias("unverified"))

    @query("""WITH u AS (SELECT DISTINCT p_name AS label FROM part), s AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN 'IV ' || p_name ELSE 'no ' || p_name END AS name FROM part WHERE p_size <= 40 AND p_name NOT LIKE 'a%'),
m AS (SELECT name, CASE WHEN name LIKE 'no %' THEN NULL WHEN name LIKE 'IV %' THEN substr(name, 4) ELSE lower(name) END AS label, CASE WHEN name LIKE 'no %' THEN 'unmatched' WHEN name LIKE 'IV %' THEN 'numeral' ELSE 'exact' END AS how FROM s)
SELECT * FROM m UNION ALL SELECT NULL, label, 'unused' FROM u WHERE label NOT IN (SELECT label FROM m WHERE label IS NOT NULL)""")
    def verdict_labels(t):
        size, name = F.col("p_size"), F.col("p_name")
        own = t.part.filter(~name.startswith("a") & (size <= 40)).select(F.when(size % 3 == 0, F.upper(name)).when(size % 3 == 1, F.concat(F.lit("IV "), name)).otherwise(F.concat(F.lit("no "), name)).alias("n"))
        return verdicts.labels(own, t.part, "n", "p_name")

    @query("""WITH p AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1)
SELECT 'Q' || k AS qid, s::VARCHAR AS ours, CASE WHEN k % 4 <> 0 AND k % 6 <> 0 THEN s + (k % 2)::INT END::VARCHAR AS graph, CASE WHEN k % 3 <> 0 THEN s END::VARCHAR AS other FROM p WHERE k % 11 = 0""")
    def verdict_same_source(t):
        people, items, statements, tenures, spans, members = _left(t)
        met = verdicts.same_source_pairs(members, items, statements, spans)
        return met.select("qid", *[F.col(c).cast("string").alias(c) for c in ("ours", "graph", "other")])

    @query("""WITH e AS (SELECT user_id % 60 AS source, value > 20 AS a, event_type <> 'view' AND user_id % 60 <> 7 AS b, user_id % 60 NOT IN (11, 13) AS c FROM events),
n AS (SELECT source, count(*)::BIGINT AS n_rows, count_if(a)::BIGINT AS active, count_if(a AND b)::BIGINT AS person_number, count_if(a AND b AND c)::BIGINT AS council FROM e GROUP BY 1)
SELECT *, CASE WHEN active = 0 THEN 'active' WHEN person_number = 0 THEN 'person_number' WHEN council = 0 THEN 'council' END AS emptied_by FROM n""")
    def fetch_stages(t):
        source = F.col("user_id") % 60
        stages = [("active", F.col("value") > 20), ("person_number", (F.col("event_type") != "view") & (source != 7)), ("council", ~source.isin(11, 13))]
        return profile.stage_verdicts(t.events.withColumn("source", source), ["source"], stages)

    @query("""WITH x AS (SELECT p_name AS name, p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS v FROM part), e AS (SELECT name, list_distinct(list(v) FILTER (v IS NOT NULL)) AS held FROM x GROUP BY 1),
w AS (SELECT DISTINCT name, k % 40 AS v FROM x WHERE k % 3 = 0), m AS (SELECT w.*, held FROM w JOIN e USING (name) WHERE NOT list_contains(held, v)),
n AS (SELECT count_if(len(held) = 1)::BIGINT AS undecided, count_if(len(held) <> 1)::BIGINT AS artefacts, (SELECT count(*) FROM w)::BIGINT AS matched FROM m)
SELECT 0::BIGINT AS differ, artefacts, undecided, matched, matched - artefacts - undecided AS agree, CASE WHEN undecided > 0 THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END AS verdict FROM n""")
    def verdict_misses(t):
        k, v = F.col("p_partkey"), F.col("p_size")
        export = t.part.select(F.col("p_name").alias("name"), F.when(v % 4 != 0, v).alias("v"))
        wanted = t.part.filter(k % 3 == 0).select(F.col("p_name").alias("name"), (k % 40).cast("int").alias("v")).distinct()
        total = wanted.agg(F.count("*").alias("matched")).first()["matched"]
        return verdicts.miss_verdict(verdicts.miss_reasons(wanted, export, "name", "v"), F.lit(total))

    @query("""WITH d AS (SELECT *, row_number() OVER () AS pos FROM pages) SELECT 'page_id' AS column_name, count(page_id)::BIGINT AS filled, arg_min(page_id::VARCHAR, pos) AS first FROM d
UNION ALL SELECT 'url', count(nullif(trim(url, ' '), ''))::BIGINT, arg_min(nullif(trim(url, ' '), ''), pos) FILTER (nullif(trim(url, ' '), '') IS NOT NULL) FROM d""")
    def column_samples(t):
        return profile.column_samples(t.pages, ["page_id", "url"], profile.in_files())

    @query("""SELECT p_partkey AS k, format('id={}', p_partkey) || CASE WHEN p_size % 3 <> 0 THEN ', body_key=' || chr(39) || p_brand || chr(39) ELSE '' END
|| CASE WHEN p_size % 2 = 0 THEN ', name_de=' || chr(39) || p_name ELSE ', title=' || chr(39) || p_type END || chr(39) AS line FROM part""")
    def described_rows(t):
        size = F.col("p_size")
        line = verdicts.described(F.col("p_partkey"), F.when(size % 3 != 0, F.col("p_brand")), ("name_de", F.when(size % 2 == 0, F.col("p_name")).otherwise(" ")), ("title", F.col("p_type")))
        return t.part.select(F.col("p_partkey").alias("k"), line.alias("line"))
