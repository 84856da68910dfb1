import datetime as dt

from rosterloom import schema
from rosterloom.plans import departures as d
from tests.test_rules import BODY, frame, held, item, member

D = dt.date


def test_departures_and_verdicts(spark):
    items = [item(f"Q{k}", f"0{k}", label=f"Ann Name{k}") for k in range(1, 9)] + [item("Q90", None)]
    statements = [held(f"Q{k}", 0, start=D(2010, 1, 1)) for k in range(1, 9)] + [held("Q90"), held("Q8", 1, end=D(2001, 1, 1))]
    tenures = [dict(person_key=str(k), council="NR", start=D(2010, 1, 1), end=D(2015, 1, k)) for k in range(2, 9)]
    spans = [dict(qid=f"Q{k}", council="nr", start=None, end=D(2015, 1, k), person_ids=[k]) for k in range(2, 9)]
    members = [dict(member(1, "1", "Ann Name1"), qid="Q1")]
    seats = frame(spark, members, schema.MEMBERS + ", qid string")
    parts = lambda s: (frame(spark, items, schema.ITEMS), frame(spark, statements, schema.STATEMENTS), frame(spark, tenures, schema.TENURES), frame(spark, s, schema.SPANS), seats)
    rows = d.departures(BODY, *parts(spans)).cache()
    assert {r["qid"] for r in rows.collect()} == {*(f"Q{k}" for k in range(2, 9)), "Q90"}
    assert d.reach(rows).first().asDict() == {"people": 8, "reachable": 7, "with_date": 7, "verdict": "CONFIRMED"}
    assert d.leaving_dates(rows).first().asDict() == {"people": 8, "comparable": 7, "agree": 7, "reversed_spans": 0, "verdict": "CONFIRMED"}
    assert d.statement_ambiguity(rows).first()["several_statements"] == 1
    other = d.departures(BODY, *parts([spans[0] | {"end": D(1999, 1, 1)}, *spans[1:]]))
    assert d.leaving_dates(other).first()["verdict"] == "CONTRADICTED"
    names = spark.createDataFrame([(str(k), f"Name{k}") for k in range(2, 8)] + [("8", "Nama8")], "person_key string, surname string")
    assert d.identity(rows, names).first()["verdict"] in ("CONFIRMED", "INCONCLUSIVE")
    assert d.overall(d.reach(rows), d.leaving_dates(other)).first()["verdict"] == "CONTRADICTED"


def test_source_verdicts(spark):
    from rosterloom.plans import verdicts as v

    pairs = spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 1))] * 9 + [(D(2020, 1, 1), None), (D(2020, 2, 1), D(2020, 1, 1))], "a date, b date")
    assert v.start_dates(pairs, "a", "b").first().asDict() == {"pairs": 10, "agree": 9, "ours_earlier": 0, "ours_later": 1, "first_of_january": 9, "verdict": "CONTRADICTED"}
    assert v.start_dates(pairs.limit(3), "a", "b").first()["verdict"] == "INCONCLUSIVE"
    df = spark.createDataFrame([("x", ""), ("y", "")], "a string, b string")
    assert [v.dated_column(df, c).first()["verdict"] for c in ("a", "b", "zz")] == ["CONFIRMED", "CONTRADICTED", "INCONCLUSIVE"]
    assert v.seat_count(df, "a", 2).first()["verdict"] == "CONFIRMED" and v.seat_count(df, "a", 3).first()["verdict"] == "CONTRADICTED"
    assert v.identifier_gain(df, "b", "a").first()["gained"] == 2
    e, a = spark.createDataFrame([("p", "07"), ("q", "8"), ("r", "9")], "k string, v string"), spark.createDataFrame([("p", "7"), ("q", "80")], "k string, v string")
    assert v.identifier_values(e, a, "k", "v").first().asDict() == {"people": 3, "agree": 1, "differ": 1, "absent": 1, "verdict": "CONTRADICTED"}
    m = spark.createDataFrame([("moved",)] * 9 + [("other",), (None,)], "why string")
    assert v.misses(m, "why").first()["verdict"] == "CONFIRMED"
    s, u = spark.createDataFrame([("II North",), ("South",), ("West",)], "n string"), spark.createDataFrame([("north",), ("south ",), ("east",)], "l string")
    assert {(r["name"], r["label"], r["how"]) for r in v.labels(s, u, "n", "l").collect()} == {("II North", "north", "numeral"), ("South", "south ", "exact"), ("West", None, "unmatched"), (None, "east", "unused")}
