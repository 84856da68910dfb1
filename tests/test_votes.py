import datetime as dt
import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from rosterloom import schema
from rosterloom.plans import validate
from rosterloom.sources import votes
from tests.test_rules import frame, member

D = dt.date


class _Service(http.server.BaseHTTPRequestHandler):
    VOTES = {51: [{"ID": 900}], 52: [{"IdVote": 901, "ID": 1}, {"IdVote": 902}], 50: [], 49: None, 48: [{"Name": "no number"}]}
    #: vote: (period, voters); a vote that fails in the midst of its pages is None
    BALLOTS = {900: (51, range(1, 8)), 901: (52, [1, 2, 3, None]), 902: None}
    asked: list = []

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        query = dict(urllib.parse.parse_qsl(url.query))
        _Service.asked.append((url.path, query))
        key = int(query["$filter"].rsplit(" ", 1)[1].strip("'"))
        if url.path == "/Vote":
            found = self.VOTES.get(key, [])
        else:
            held = self.BALLOTS[key]
            found = None if held is None else [{"IdLegislativePeriod": held[0], "PersonNumber": p} for p in held[1]]
        if found is None:
            self.send_error(404)
            return
        if url.path.endswith("/$count"):
            body = str(len(found))
        else:
            at = int(query.get("$skip", 0))
            body = json.dumps({"d": {"results": found[at : at + int(query["$top"])]}})
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


def test_one_several_no_and_failing_votes(spark, service):
    periods = spark.createDataFrame([(n - 40, n) for n in (48, 49, 50, 51, 52)] + [(None, 53)], "number int, id int")
    periods = periods.withColumn("id", F.when(F.col("number") == 8, 48).otherwise(F.col("id")))
    got = {r["period_id"]: r["vote_id"] for r in votes.find_votes(spark, periods, service, delay=0.0).collect()}
    assert got == {51: 900, 52: 901}
    assert all(q["$top"] == "1" for p, q in _Service.asked if p == "/Vote")


def test_a_failing_key_is_a_row(spark, service):
    found = votes.ballots(spark, [900, 902, 901], service, delay=0.0, size=3).collect()
    assert sorted((r["vote"], r["person_key"]) for r in found if r["error"] is None) == [("900", str(k)) for k in range(1, 8)] + [("901", "1"), ("901", "2"), ("901", "3")]
    (failed,) = [r for r in found if r["error"] is not None]
    assert failed["vote"] == "902" and "404" in failed["error"]
    _Service.asked.clear()
    counted = votes.keyed(spark, service, votes.BALLOT_TABLE, "IdVote", [900, 902], count=True, delay=0.0).collect()
    assert {r["_key"]: r["n"] for r in counted} == {"900": 7, "902": None} and [r["_key"] for r in counted if r["_error"]] == ["902"]
    assert all(p.endswith("/$count") for p, _ in _Service.asked)


def test_validation_from_the_service(spark, service):
    day = D(2019, 12, 2)
    people = [member(k, str(k), f"A {k}", date_joining=day) for k in (1, 2, 3)] + [member(4, "4", "A D", date_joining=D(2023, 12, 4)), member(9, "9", "A I", date_joining=day)]
    periods = spark.createDataFrame([(51, 51, day, D(2023, 12, 3)), (52, 52, D(2023, 12, 4), None), (40, 40, D(1980, 1, 1), D(1984, 1, 1))], "id int, number int, start date, end date")
    members = frame(spark, people, schema.MEMBERS)
    found, failed = validate.from_service(spark, members, periods, service, delay=0.0)
    got = {(r["number"], r["person_key"]): r["verdict"] for r in found.collect()}
    assert failed == [] and {k: v for k, v in got.items() if k[0] == 51} == {(51, "1"): "agrees", (51, "2"): "agrees", (51, "3"): "agrees", (51, "4"): "earlier_mandate", **{(51, str(k)): "left_since" for k in (5, 6, 7)}, (51, "9"): "did_not_vote"}
    assert got[52, "4"] == got[52, "9"] == "did_not_vote"
    _, failed = validate.from_service(spark, members, periods, service, vote_ids=[901, 902], delay=0.0)
    assert [f["vote"] for f in failed] == ["902"]
    with pytest.raises(ValueError, match="no roll call"):
        validate.from_service(spark, members, periods.withColumn("id", F.lit(50)), service, delay=0.0)
