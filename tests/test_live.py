import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from rosterloom.config import Body, Config
from rosterloom.operators import profile
from rosterloom.plans import run
from rosterloom.sources import live
from tests.test_rules import frame
from rosterloom import schema

XSI = "xmlns:xsi='http://www.w3.org/2001/XMLSchema-instance'"


def seat(k, **x):
    base = dict(ID=k, Language="DE", PersonNumber=k, Active=True, FirstName="Ann", LastName=f"Lee{k}", Council=1, CouncilAbbreviation="NR", CantonAbbreviation="ZH", DateJoining="2019-12-02T00:00:00", DateLeaving=None)
    return base | x


class _Service(http.server.BaseHTTPRequestHandler):
    TABLES = {
        "MemberCouncil": [seat(1), seat(2, CouncilAbbreviation="SR"), seat(3, Active=False), seat(4, Language="FR"), seat(5, PersonNumber=None)],
        "MemberCouncilHistory": [seat(1, DateJoining="2015-11-30T00:00:00", DateLeaving="2019-12-01T00:00:00"), seat(1)],
        "LegislativePeriod": [dict(ID=51, Language="DE", LegislativePeriodNumber=51, LegislativePeriodName="51", StartDate="2019-12-02T00:00:00", EndDate=None)],
    }
    MANDATES = [
        ("g1", "<Dauer><Start>2019-05-06T00:00:00.000</Start><End>9999-12-31T23:59:59.000</End></Dauer><Funktion>Mitglied</Funktion><Funktion>Präsidium</Funktion><Gremium>Rat</Gremium><Person><Kontakt OBJ_GUID='p1'><Name>Lee</Name><Vorname>Ann</Vorname><Wahlkreis xsi:nil='true'/></Kontakt></Person>"),
        ("g2", "<Dauer><Start>20190506</Start><End>20200101</End></Dauer><Funktion>Mitglied</Funktion><Gremium>Rat</Gremium><Person><Kontakt OBJ_GUID='p2'><Name>Ray</Name><Vorname>Bo</Vorname></Kontakt></Person>"),
        ("g3", "<Dauer><Start>20190506</Start></Dauer><Funktion>Mitglied</Funktion><Gremium xsi:nil='true'/><GremiumName>Rat</GremiumName><Person><Kontakt OBJ_GUID='p3'><Name xsi:nil='true'/></Kontakt></Person>"),
    ]
    CONTACTS = ["<Kontakt OBJ_GUID='p1'><Name>Other</Name><Partei>AB</Partei><Beruf>one</Beruf><Beruf>two</Beruf></Kontakt>", "<Kontakt OBJ_GUID='p3'><NameVorname>Fox Cy</NameVorname><Name>Fox</Name><Vorname>Cy</Vorname></Kontakt>"]
    asked: list = []

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        query = dict(urllib.parse.parse_qsl(url.query))
        _Service.asked.append((url.path, query))
        name = url.path.strip("/").split("/")[0]
        if name in self.TABLES:
            rows, where = self.TABLES[name], query.get("$filter", "")
            rows = [r for r in rows if f"Language eq '{r['Language']}'" in where]
            if "CouncilAbbreviation" in where:
                rows = [r for r in rows if f"CouncilAbbreviation eq '{r['CouncilAbbreviation']}'" in where]
            if "Active eq true" in where:
                rows = [r for r in rows if r["Active"]]
            body = str(len(rows)) if url.path.endswith("$count") else json.dumps({"d": {"results": rows[int(query["$skip"]) :][: int(query["$top"])]}})
        else:
            own = [f"<Mitglied xmlns='urn:m' OBJ_GUID='{g}'>{x}</Mitglied>" for g, x in self.MANDATES] if name == "m" else self.CONTACTS
            start = int(query["s"])
            hits = "".join(f"<Hit>{x}</Hit>" for x in own[start : start + 2])
            body = f"<Answer xmlns='urn:x' {XSI} numHits='{len(own)}'>{hits}</Answer>"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def graph(spark):
    none = {"items": schema.ITEMS, "statements": schema.STATEMENTS, "candidates": "name string, qid string, birth_date date, has_position boolean"}
    return lambda name: frame(spark, [], none[name])


def test_federal_run_with_filters_in_the_scan(spark, service):
    _Service.asked.clear()
    config = Config(bodies=(Body("NR", "Q1"),), biography_url="https://example.org/{id}")
    result = run.run(spark, config, live.federal(spark, service, ["NR"], delay=0), graph(spark), F.lit("2022-06-01").cast("date"))
    (row,) = result.members.collect()
    assert (row["person_key"], row["full_name"], str(row["tenure_start"])) == ("1", "Ann Lee1", "2015-11-30")
    asked = {name: [q for p, q in _Service.asked if p == f"/{name}"] for name in _Service.TABLES}
    assert {q["$filter"] for q in asked["MemberCouncil"]} and all("Active eq true" in q["$filter"] and "CouncilAbbreviation eq 'NR'" in q["$filter"] and "Language eq 'DE'" in q["$filter"] for q in asked["MemberCouncil"])
    assert [len(asked[name]) for name in asked] == [1, 1, 1]  # each table once, though history has two uses


def test_the_stage_that_empties_a_fetch_is_named(spark, service):
    config = Config(bodies=(Body("XX", "Q1"),), biography_url="https://example.org/{id}")
    rows = {name: spark.createDataFrame([{k: str(v) for k, v in r.items() if v is not None} for r in _Service.TABLES[name]]) for name in _Service.TABLES}
    for c in ("BirthPlace_City", "BirthPlace_Canton", "Citizenship", "NumberOfChildren", "ParlGroupAbbreviation", "PartyAbbreviation", "DateOfBirth", "DateLeaving"):
        rows["MemberCouncil"] = rows["MemberCouncil"].withColumn(c, F.lit(None).cast("string"))
    rows["LegislativePeriod"] = rows["LegislativePeriod"].withColumn("EndDate", F.lit(None).cast("string"))
    tables = {"members": rows["MemberCouncil"], "history": rows["MemberCouncilHistory"], "periods": rows["LegislativePeriod"]}
    with pytest.raises(ValueError, match="the stage council leaves none of the rows before it .n_rows 5, active 4, person_number 3, council 0"):
        run.run(spark, config, tables.get, graph(spark), F.lit("2022-06-01").cast("date"))
    with pytest.raises(ValueError, match="no rows at all"):
        run.run(spark, config, (tables | {"members": rows["MemberCouncil"].limit(0)}).get, graph(spark), F.lit("2022-06-01").cast("date"))
    watched = profile.Watched(spark.range(10), [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 5)])
    assert watched.rows.filter("id > 3").count() == 6 and watched.counts == {"n_rows": 10, "even": 5, "small": 3} and watched.verdict == "3 rows pass (n_rows 10, even 5, small 3)"


def test_run_from_nested_records(spark, service):
    config = Config(source="mandates", bodies=(Body("GR", "Q1", group_name="Rat"),), biography_url="https://example.org/{id}")
    tables = live.mandates(spark, service + "/m?s={start}", service + "/k?s={start}", size=2, delay=0)
    mandates = {r["kontaktguid"]: r for r in tables("mandates").collect()}
    assert mandates["p1"]["funktion"] == "Mitglied; Präsidium" and mandates["p1"]["wahlkreis"] is None and mandates["p3"]["gremium"] == "Rat" and mandates["p3"]["name"] is None
    result = run.run(spark, config, tables, graph(spark), F.lit("2022-06-01").cast("date"))
    got = {r["person_key"]: r for r in result.members.collect()}
    assert {k: r["full_name"] for k, r in got.items()} == {"p1": "Ann Lee", "p3": "Cy Fox"}
    assert got["p1"]["party"] == "AB" and str(got["p1"]["date_joining"]) == "2019-05-06" and got["p1"]["date_leaving"] is None
