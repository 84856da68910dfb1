import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.config import Config
from rosterloom.graph import plans
from rosterloom.plans import report, rules, validate
from rosterloom.sources import files
from rosterloom.sources.base import as_members

D = dt.date


def findings(spark):
    row = lambda kind, label, group: spark.range(1).select(F.lit(kind).alias("kind"), F.lit("NR").alias("council"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("nth"), F.lit(label).alias("member_label"), F.lit("1").alias("person_key"), F.lit("Q5").alias("person_qid"), F.lit("identifier").alias("qid_source"), F.lit(group).cast("string").alias("constituency"), F.lit(None).cast("string").alias("parl_group"), F.lit("<why>").alias("detail"), rules.payload(position="Q1", start=F.lit("2020-01-02").cast("date"), biography="https://b/1").alias("payload"))
    known = schema.PRIORITY
    out = None
    for kind, label, group in (("ADD_START_DATE", "b", None), ("REVIEW_ENDED", "C", "zug"), ("ADD_START_DATE", "A", "Bern")):
        one = row(kind, label, group).withColumn("priority", F.lit(known[kind]))
        out = one if out is None else out.unionByName(one)
    return out


def test_reports(spark, tmp_path):
    found = findings(spark)
    assert [(r["kind"], r["n"]) for r in report.by_kind(found).collect()] == [("REVIEW_ENDED", 1), ("ADD_START_DATE", 2)]
    members = spark.createDataFrame([("NR", "identifier", "Q5"), ("NR", None, None)], "council string, qid_source string, qid string")
    statements = spark.createDataFrame([("Q5", "Q1", None), ("Q6", "Q1", None), ("Q7", "Q1", D(2020, 1, 1)), ("Q8", "Q9", None)], "qid string, position_qid string, end date")
    bodies = [dict(council="NR", label="Zürcher Rat & <Co>}", position_qid="Q1"), dict(council="SR", label="Empty", position_qid="Q2")]
    report.write(members, found, statements, bodies, Config(), "2022-01-01", str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["NR-zurcher-rat-co.md", "SR-empty.md", "commands.txt", "findings.json", "index.md", "report.html"]
    page = (tmp_path / "NR-zurcher-rat-co.md").read_text().splitlines()
    at = [page.index(x) for x in ("# Zürcher Rat & <Co>}", "- 2 members in the source", "- 2 items with an open statement", "- 2 ready as edit commands", "## By kind", "- REVIEW_ENDED: 1", "- ADD_START_DATE: 2", "## Bern", "- **ADD_START_DATE** [A](https://www.wikidata.org/wiki/Q5): <why>", "## zug", "## Other", "- **ADD_START_DATE** [b](https://www.wikidata.org/wiki/Q5): <why>")]
    assert at == sorted(at)
    index = (tmp_path / "index.md").read_text()
    links = re.findall(r"\]\(([^)]*)\)", index)
    assert len(links) == 5 and all((tmp_path / x).exists() for x in links) and "3. ADD_START_DATE, 2 times" in index
    document = json.loads((tmp_path / "findings.json").read_text())
    assert document["total_findings"] == 3 and [(c["council"], len(c["found"])) for c in document["chambers"]] == [("NR", 3), ("SR", 0)]
    first = document["chambers"][0]["found"][0]
    assert first["kind"] == "REVIEW_ENDED" and first["payload"]["start"] == "2020-01-02" and "end" not in first["payload"] and document["chambers"][0]["open_on_graph"] == 2
    html = (tmp_path / "report.html").read_text()
    assert html.count("<tr ") == 3 and "<td>&lt;why&gt;</td>" in html and "<h2>Zürcher Rat &amp; &lt;Co&gt;}</h2>" in html and html.index(">C<") < html.index(">A<")
    commands = (tmp_path / "commands.txt").read_text().splitlines()
    assert [x.startswith("#") for x in commands] == [True] * 5 + [False] * 2 and commands[2] == "# 2 of 3 findings can be applied"


def test_files_come_whole_or_not_at_all(spark, tmp_path):
    lines = spark.range(3000).select((F.col("id") % 7).cast("string").alias("file"), F.concat(F.lit("n"), "id").alias("line"), F.col("id").alias("at"))
    files.write(lines, str(tmp_path), "at")
    assert sorted(p.name for p in tmp_path.iterdir()) == [str(k) for k in range(7)]
    assert (tmp_path / "3").read_text().splitlines() == [f"n{k}" for k in range(3, 3000, 7)]
    broken = lines.withColumn("line", F.when(F.col("at") == 2500, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception):
        files.write(broken, str(tmp_path / "b"), "at")
    assert not (tmp_path / "b").exists() or not list((tmp_path / "b").iterdir())
    with pytest.raises(Exception, match="two tasks wrote one file"):
        scattered = lines.select("file", "line").repartition(3)
        scattered.sortWithinPartitions("file").write.format("named_files").mode("append").option("path", str(tmp_path / "c")).save()


def test_validation(spark):
    rows = spark.createDataFrame([(1, "1", D(2019, 12, 2), None), (2, "2", D(2021, 1, 1), None), (3, "3", D(2024, 1, 1), None), (4, "4", None, None)], "ord long, k string, s date, e date")
    members = as_members(rows, ord=F.col("ord"), person_key=F.col("k"), date_joining=F.col("s"), date_leaving=F.col("e"))
    periods = spark.createDataFrame([(51, "a", D(2019, 12, 2), D(2023, 12, 3)), (52, "b", D(2023, 12, 4), None)], schema.PERIODS)
    votes = spark.createDataFrame([(51, 1), (51, 3), (51, 9), (51, 4)], "number int, person_key long")
    (row,) = validate.validate(members, periods, votes).collect()
    assert row.asDict() == {"number": 51, "assigned": 2, "voted": 4, "still_sitting": 3, "earlier_mandate": 1, "not_assigned": 1, "valid": False}


def test_graph_plans(spark):
    statements = spark.createDataFrame([("s1", "Q1", "QP", "normal", D(2020, 1, 1), None), ("s2", "Q2", "QP", "deprecated", None, None), ("s3", "Q3", "QX", "normal", None, None), ("s4", "Q1", "QP", "normal", None, D(2019, 1, 1))], "statement_id string, qid string, position_qid string, rank string, start date, end date")
    qualifiers = spark.createDataFrame([("s1", "P768", "D1"), ("s1", "P2937", "T2"), ("s1", "P2937", "T1"), ("s4", "P2937", "T1")], "statement_id string, property string, value_qid string")
    held = {r["statement_id"]: r for r in plans.seats(statements, qualifiers, ["QP"]).collect()}
    assert set(held) == {"s1", "s4"} and held["s1"]["terms"] == ["T1", "T2"] and held["s1"]["groups"] == []
    items = spark.createDataFrame([("Q1", "One", None, None), ("Q2", "Two", None, None), ("Q9", "Nine", None, None)], "qid string, label string, birth_date date, death_date date")
    ids = spark.createDataFrame([("Q1", "P1307", "7"), ("Q2", "P999", "x"), ("Q9", "P1307", "8")], "qid string, property string, value string")
    props = spark.createDataFrame([("Q1", "P19"), ("Q1", "P21")], "qid string, property string")
    parties = spark.createDataFrame([("Q1", "QA", False), ("Q1", "QB", True)], "qid string, party_qid string, ended boolean")
    people = {r["qid"]: r for r in plans.people(items, ids, props, parties, statements.filter("qid = 'Q1'"), "P1307", ["P19"]).collect()}
    assert people["Q1"]["parties"] == ["QA"] and people["Q1"]["properties"] == ["P19"] and people["Q1"]["join_id"] == "7"
    assert [people[q]["person_data_known"] for q in ("Q1", "Q2", "Q9")] == [True, False, True]
    names = spark.createDataFrame([("Q1", "Ann Lee", "label", "de"), ("Q2", "Ann Lee", "alias", "en"), ("Q9", "Ann  Lee", "alias", None)], "qid string, name string, origin string, lang string")
    wanted = spark.createDataFrame([("Ann Lee",)], "name string")
    got = {r["qid"]: r["has_position"] for r in plans.search(names, wanted, items, statements, ids, ["QP"], "P1307").collect()}
    assert got == {"Q1": True, "Q2": True, "Q9": False}
    assert plans.marginal_gain(ids, "P999", "P1307").first()["gain"] == 1
    assert [tuple(r) for r in plans.model_census(statements, qualifiers, "QP").collect()] == [(1, 0, 1), (2, 2, 1)]
    assert [tuple(r) for r in plans.usage(qualifiers, "P2937").collect()] == [("T1", 2), ("T2", 1)]
    assert plans.name_variants(names, items, ["de"]).count() == 2
    assert [tuple(r) for r in plans.positions_held(statements, items).collect()] == [("QP", 2)]
