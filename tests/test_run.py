import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rosterloom import __main__ as command
from rosterloom import schema
from rosterloom.config import Body, Config
from rosterloom.plans import report, run
from rosterloom.sources import factory, scans
from tests.test_rules import frame, held, item

D = dt.date
CONFIG = Config(source="directory", bodies=(Body("NR", "Q1", "Zürcher Rat", "The Council"),), biography_url="https://example.org/{id}", identifier_verified=False)


def tables(spark):
    strings = lambda rows: spark.createDataFrame(rows)
    source = {
        "groups": strings([dict(id=5, name_de="the  council"), dict(id=6, name_de="The Council of Elders")]),
        "memberships": strings([dict(person_id=p, group_id=5, begin_date="2020-01-10", end_date="", role_name_de="Member") for p in (1, 2, 3)]),
        "persons": strings([dict(id=k, firstname=f, lastname=l, fullname="", electoral_district_de="", party_de="", birthday=b) for k, f, l, b in ((1, "Ann", "Lee", "1970-01-01"), (2, "Bo", "Ray", ""), (3, "Cy", "Fox", ""))]),
    }
    graph = {
        "items": frame(spark, [item("Q10", "1", birth_date=D(1970, 1, 1)), item("Q20", "2", label="Somebody Else"), item("Q30", "8", label="Cy Fox")], schema.ITEMS),
        "statements": frame(spark, [held("Q10", start=D(2020, 1, 11))], schema.STATEMENTS),
        "candidates": spark.createDataFrame([("Cy Fox", "Q30", None, True), ("Bo Ray", "Q20", D(1950, 1, 1), False), ("Bo Ray", "Q21", None, False)], "name string, qid string, birth_date date, has_position boolean"),
    }
    return source, graph


def test_from_tables_to_reports(spark, tmp_path):
    source, graph = tables(spark)
    result = run.run(spark, CONFIG, source.get, graph.get, F.lit("2022-06-01").cast("date"))
    who = {r["full_name"]: (r["qid"], r["qid_source"], r["mismatch_qids"]) for r in result.members.collect()}
    assert who["Ann Lee"] == ("Q10", "identifier", []) and who["Cy Fox"][:2] == ("Q30", "name") and who["Bo Ray"] == (None, None, ["Q20"])
    kinds = sorted((r["kind"], r["member_label"]) for r in result.findings.collect())
    assert ("FIX_START_DATE", "Ann Lee") in kinds and ("ADD_MEMBERSHIP", "Cy Fox") in kinds and ("NO_WIKIDATA_ITEM", "Bo Ray") in kinds
    run.write(result, CONFIG, "2022-06-01", str(tmp_path))
    index = (tmp_path / "index.md").read_text()
    assert "**[Zürcher Rat](NR-zurcher-rat.md)** (seat Q1): 1 of 3 members by P1307 (33.3 %), 1 by name, 1 open" in index and "2. FIX_START_DATE, 1 times" in index
    assert (tmp_path / "report.html").read_text().count("<tr ") == len(kinds) and (tmp_path / "NR-zurcher-rat.md").exists()
    (row,) = json.loads(report.console(report.by_body(result.members, result.findings, result.statements, [b.row for b in CONFIG.bodies], CONFIG)))
    assert row["mismatched"] == 1 and row["findings"] == len(kinds) and row["open_on_graph"] == 1 and list(row) == sorted(row)


def test_command_and_empty_source(spark, tmp_path, capsys):
    source, graph = tables(spark)
    for name, df in source.items():
        df.write.parquet(f"{tmp_path}/s/{name}")
    for name, df in graph.items():
        df.write.parquet(f"{tmp_path}/g/{name}")
    (tmp_path / "c.yaml").write_text("source: directory\nbodies:\n  - {council: NR, position_qid: Q1, group_name: The Council}\nbiography_url: 'https://example.org/{id}'\n")
    assert command.main([str(tmp_path / "c.yaml"), f"{tmp_path}/s", f"{tmp_path}/g", f"{tmp_path}/out", "--today", "2022-06-01", "--limit", "2"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["members"] == 2
    spark.createDataFrame([("Q1", "seat")], "qid string, label string").write.parquet(f"{tmp_path}/g/instances")
    arguments = [str(tmp_path / "c.yaml"), f"{tmp_path}/s", f"{tmp_path}/g", f"{tmp_path}/out", "--verify-config"]
    assert command.main(arguments) == 1 and "NR  Q1  not on the graph" in capsys.readouterr().out
    frame(spark, [item("Q1", None, label="Member of the council")], schema.ITEMS).write.parquet(f"{tmp_path}/h/items")
    spark.createDataFrame([("Q1", "seat")], "qid string, label string").write.parquet(f"{tmp_path}/h/instances")
    assert command.main([*arguments[:2], f"{tmp_path}/h", *arguments[3:]]) == 0 and "Member of the council [seat]" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no members"):
        run.run(spark, CONFIG, (source | {"memberships": source["memberships"].limit(0)}).get, graph.get, F.lit("2022-06-01").cast("date"))
    with pytest.raises(ValueError, match="source is"):
        factory.build(spark, "other", source.get, {}, F.current_date())


@pytest.mark.parametrize("wrong", [dict(group_by="x"), dict(bodies=[dict(council="", position_qid="Q1")]), dict(bodies=[dict(council="N", position_qid="X1")]), dict(bodies=[dict(council="N", position_qid="Q1"), dict(council="n", position_qid="Q2")]), dict(other_identifiers=["P1307"]), dict(biography_url="https://x/"), dict(constituencies={" ": "Q1"}), dict(person_data=[dict(property_id="P1", label="a", column="b")] * 2), dict(nothing=1)])
def test_configurations_that_cannot_be_used(wrong):
    with pytest.raises(ValueError):
        Config.of(wrong)


def test_configurations_that_no_service_should_see():
    good = dict(bodies=[dict(council="NR", position_qid="Q1")], user_agent="roster check (mailto:a@b.ch)")
    assert Config.of(good).problems() == []
    enrich = dict(source="directory", body_key="CHE", groups={"NR": 1})
    assert Config.of(good | {"enrich": enrich}).problems() == []
    no_ids = dict(identifier_from_source=False, identifier_verified=False)
    wrong = [
        (dict(bodies=[]), "no chamber"), (no_ids | dict(source="other"), "source is"), (no_ids | dict(source="mandates"), "exact name"), (no_ids | dict(source="directory"), "body_key"),
        (dict(source="directory", body_key="ZH"), "gives no value"), (dict(identifier_from_source=False), "identifier_verified"), (dict(user_agent=" "), "name who asks"),
        (dict(user_agent="Example bot https://x.ch"), "placeholder"), (dict(user_agent="somebody"), "no address"), (dict(enrich=enrich | {"source": "register"}), "only a directory"),
        (dict(enrich=enrich | {"groups": {}}), "no council's group"), (dict(enrich=enrich | {"groups": {"SR": 2}}), "bodies hasn't"), (no_ids | dict(source="directory", body_key="CHE", enrich=enrich), "always agree"),
    ]
    for change, said in wrong:
        (problem,) = Config.of(good | change).problems()
        assert said in problem
    for change in (dict(enrich=[1]), dict(bodies={"a": 1}), dict(parties=["x"]), dict(roles="Mitglied")):
        with pytest.raises(ValueError, match="has to be"):
            Config.of(good | change)


def test_scans(spark):
    source, _ = tables(spark)
    made = []
    kept = scans.Scans()
    for _ in range(2):
        kept.get(("persons",), lambda: made.append(1) or source["persons"])
    kept.close()
    assert made == [1]
    assert [r["id"] for r in scans.head(source["persons"], 5, lastname="Ray").collect()] == [2]
    assert [r["name_de"] for r in scans.near_misses(source["groups"], "name_de", "the council").collect()] == ["The Council of Elders"]
    assert scans.trace(source["persons"], source["memberships"], source["groups"].withColumnRenamed("name_de", "name"), 2).count() == 2
    assert scans.sample_columns(None) is None and "id" in scans.sample_columns(source["groups"])
