import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.config import PERIOD, Check, Config
from rosterloom.plans import resolve, rules

D = dt.date
BODY = {"council": "NR", "label": "Lower House", "position_qid": "Q1"}
CONFIG = dict(
    biography_url="https://example.org/bio/{id}", other_identifiers=("P999",), constituencies={"North  Side": "Q50", "South": "Q51"}, parties={"AB": "Q60"}, parl_groups={"G": "Q70"},
    terms={50: "Q80", 51: "Q81"}, person_data=(Check("P19", "place of birth", "place_of_birth"), Check("P1971", "number of children", "number_of_children"), Check("P106", "occupation", "occupations")),
)
def day(text="2022-06-01"):
    return F.lit(text).cast("date")


def member(ord_, key, name, **x):
    base = dict(ord=ord_, person_key=key, council="NR", full_name=name, active=True, date_joining=D(2020, 1, 10), date_leaving=None, tenure_start=None, constituency=None, parl_group=None, party=None, birth_date=None, place_of_birth=None, website=None, places_of_origin=None, occupations=None, number_of_children=None)
    return base | x


def frame(spark, rows, ddl):
    names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", ddl)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def run(spark, members, items=(), statements=(), spans=(), conflicts=(), tenures=(), **options):
    config = Config.of(CONFIG | options)
    periods = [dict(number=50, start=D(2015, 11, 30), end=D(2019, 12, 1)), dict(number=51, start=D(2019, 12, 2), end=D(2023, 12, 3)), dict(number=52, start=D(2023, 12, 4), end=None)]
    m = resolve.by_identifier(frame(spark, members, schema.MEMBERS), frame(spark, items, schema.ITEMS))
    found = rules.findings(BODY, m, frame(spark, items, schema.ITEMS), frame(spark, statements, schema.STATEMENTS), frame(spark, periods, schema.PERIODS), config, day(), frame(spark, tenures, schema.TENURES), frame(spark, conflicts, schema.LINK_CONFLICTS), frame(spark, spans, schema.SPANS)).cache()
    return found, config


def kinds(found, who=None):
    return [r["kind"] for r in rules.ordered(found).collect() if who is None or r["person_qid"] == who]


def item(qid, join_id, **x):
    return dict(qid=qid, label=f"L{qid}", join_id=join_id, identifiers={"P999": "x"}, parties=["Q60"], properties=["P19", "P1971", "P106"], person_data_known=True) | x


def held(qid, n=0, **x):
    return dict(ord=n, statement_id=f"{qid}-{n}", qid=qid, position_qid="Q1", start=D(2020, 1, 10), end=None, districts=["Q50"], groups=["Q70"], terms=["Q81"]) | x


def test_nothing_to_say(spark):
    found, _ = run(spark, [member(1, "007", "A B", constituency="north side", parl_group="G", party="AB")], [item("Q100", "7")], [held("Q100")])
    assert found.collect() == []


@pytest.mark.parametrize(
    "change, statement, kind",
    [
        ({}, None, "ADD_MEMBERSHIP"),
        ({}, dict(end=D(2022, 5, 1)), "REVIEW_ENDED"),
        ({}, dict(end=D(2022, 7, 1)), None),
        (dict(date_leaving=D(2021, 3, 1)), {}, "ADD_END_DATE"),
        ({}, dict(start=None), "ADD_START_DATE"),
        ({}, dict(start=D(2020, 1, 11)), "FIX_START_DATE"),
        (dict(tenure_start=D(2018, 1, 1)), dict(start=D(2018, 1, 1)), "ADD_TERM"),
        (dict(constituency=" SOUTH "), {}, "ADD_QUALIFIER"),
        (dict(constituency="Elsewhere"), {}, None),
    ],
)
def test_statement_rules(spark, change, statement, kind):
    found, config = run(spark, [member(1, "7", "A B", **change)], [item("Q100", "7")], [] if statement is None else [held("Q100", **statement)])
    assert kinds(found) == ([kind] if kind else [])
    lines = [r["line"] for r in rules.commands(found, config, day("2022-06-02")).collect()]
    tail = '|S854|"https://example.org/bio/7"|S813|+2022-06-02T00:00:00Z/11'
    want = {
        "ADD_MEMBERSHIP": "Q100|P39|Q1|P580|+2020-01-10T00:00:00Z/11|P2937|Q81", "ADD_END_DATE": "Q100|P39|Q1|P2937|Q81|P582|+2021-03-01T00:00:00Z/11",
        "ADD_START_DATE": "Q100|P39|Q1|P2937|Q81|P580|+2020-01-10T00:00:00Z/11", "ADD_TERM": "Q100|P39|Q1|P2937|Q80", "ADD_QUALIFIER": "Q100|P39|Q1|P2937|Q81|P768|Q51",
    }
    assert lines == ([want[kind] + tail] if kind in want else [])


def test_gates(spark):
    two = [held("Q100", 0, start=None), held("Q100", 1, end=D(2010, 1, 1), start=D(2009, 1, 1))]
    found, config = run(spark, [member(1, "7", "A B")], [item("Q100", "7")], two)
    assert kinds(found) == ["ADD_START_DATE"] and rules.commands(found, config, day()).count() == 0
    found, config = run(spark, [member(1, "7", "A B")], [item("Q100", "7")], [held("Q100", start=None)], identifier_verified=False)
    assert found.first()["payload"]["identifier_unverified"] and rules.commands(found, config, day()).count() == 0
    span = [dict(qid="Q100", council="nr", start=D(2020, 1, 12), end=None, person_ids=[5])]
    found, config = run(spark, [member(1, "7", "A B")], [item("Q100", "7")], [held("Q100", start=None)], spans=span)
    assert kinds(found) == ["SOURCES_DISAGREE", "ADD_START_DATE"] and rules.commands(found, config, day()).count() == 0
    assert [r["payload"]["sources_disagree"] for r in found.collect()] == [True, True]


def test_people_and_items(spark):
    members = [member(1, "7", "A B", place_of_birth=" Town ", number_of_children=0, occupations=["x", " "], party="AB"), member(2, "8", "C D"), member(3, "9", "E F")]
    items = [item("Q100", "7", identifiers={}, parties=[], properties=[]), item("Q101", "8"), item("Q102", "08")]
    found, _ = run(spark, members, items, [held("Q100", districts=[], groups=[])])
    assert kinds(found, "Q100") == ["REVIEW_PARTY", "MISSING_IDENTIFIER", "ADD_PERSON_DATA", "ADD_PERSON_DATA"]
    assert [(r["kind"], r["member_label"]) for r in rules.ordered(found.filter("person_qid IS NULL")).collect()] == [("DUPLICATE_IDENTIFIER", "C D"), ("NO_WIKIDATA_ITEM", "E F")]


def test_reverse_walk(spark):
    items = [item("Q100", "7"), item("Q200", "20"), item("Q201", "21"), item("Q202", "22"), item("Q203", "22"), item("Q204", None), item("Q205", "8")]
    statements = [held("Q100"), held("Q200"), held("Q201", end=D(2001, 1, 1)), held("Q202", end=D(2001, 1, 1)), held("Q203", end=D(2001, 1, 1)), held("Q204", 0), held("Q204", 1, end=D(1999, 1, 1)), held("Q205")]
    tenures = [dict(person_key="20", council="NR", start=D(2010, 1, 1), end=D(2014, 1, 1))]
    conflicts = [dict(council="NR", qid="Q300", person_ids=[1, 2]), dict(council="SR", qid="Q301", person_ids=[3, 4])]
    found, config = run(spark, [member(1, "7", "A B"), member(2, "8", "C D", active=True)], items, statements, tenures=tenures, conflicts=conflicts)
    rows = {(r["kind"], r["person_qid"]): r for r in found.collect()}
    assert set(rows) == {("ADD_END_DATE", "Q200"), ("ADD_END_DATE", "Q204"), ("DUPLICATE_IDENTIFIER", None), ("DUPLICATE_SOURCE_LINK", "Q300")}
    assert rows["ADD_END_DATE", "Q200"]["payload"]["end"] == D(2014, 1, 1) and rows["ADD_END_DATE", "Q204"]["payload"]["ambiguous_statement"]
    assert rows["DUPLICATE_IDENTIFIER", None]["payload"]["duplicate_qids"] == ["Q202", "Q203"]
    assert rules.commands(found, config, day()).count() == 0
    assert run(spark, [], items, statements, conflicts=conflicts)[0].count() == 0


def test_period_model_consumes_statements(spark):
    m = [member(1, "7", "A B", date_joining=D(2016, 1, 1))]
    statements = [held("Q100", 0, start=D(2016, 1, 1), end=D(2019, 12, 1), terms=["Q80"]), held("Q100", 1, start=D(2019, 12, 2), terms=[])]
    found, config = run(spark, m, [item("Q100", "7")], statements, statement_model=PERIOD)
    # the running period has an end, so its open statement lacks one; the next period has no statement yet
    assert kinds(found) == ["ADD_END_DATE", "ADD_MEMBERSHIP", "ADD_TERM"]
    assert {r["payload"]["statement_id"] for r in found.collect()} == {"Q100-1", None}
    found, _ = run(spark, m, [item("Q100", "7")], statements[:1], statement_model=PERIOD)
    assert sorted(r["payload"]["start"] for r in found.collect()) == [D(2019, 12, 2), D(2023, 12, 4)]


def test_names(spark):
    members = [member(1, "1", "Ann Lee", birth_date=D(1970, 1, 1)), member(2, "2", "Ann  LEE"), member(3, "3", "Bo Ek"), member(4, "4", "Solo"), member(5, "5", "Cy Ode"), member(6, "6", "Cy Ode")]
    m = resolve.by_identifier(frame(spark, members, schema.MEMBERS), frame(spark, [], schema.ITEMS))
    names = [("Ann Lee", "Q1", D(1970, 1, 1), False), ("Ann Lee", "Q2", D(1980, 1, 1), True), ("Bo Ek", "Q3", None, False), ("Bo Ek", "Q4", None, False), ("Solo", "Q5", None, True), ("Cy Ode", "Q6", None, True)]
    out = resolve.by_name(m, spark.createDataFrame(names, "name string, qid string, birth_date date, has_position boolean"))
    assert {r["ord"]: (r["qid"], r["qid_source"]) for r in out.collect()} == {1: ("Q1", "name"), 2: ("Q2", "name"), 3: (None, None), 4: (None, None), 5: ("Q6", "name"), 6: (None, None)}
    assert [r["name"] for r in resolve.unresolved_names(out).collect()] == ["Bo Ek", "Solo", "Cy Ode"]


def test_configuration_errors():
    for bad in ({"parties": {"A": "P1"}}, {"identifier_property": "Q1"}, {"statement_model": "x"}, {"terms": {"1": "Q1"}}, {"unknown": 1}):
        with pytest.raises(ValueError):
            Config.of(bad)
