import http.server
import json
import threading
import urllib.error
import urllib.parse

import pytest
from pyspark.sql import functions as F

from rosterloom.sources import http as source


def test_retries_and_pacing():
    pauses, answers = [], [urllib.error.HTTPError("u", 503, "", {}, None), b"not json", b'{"a": 1}']

    def fetch(_):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    assert source.get_json("u", fetch, sleep=pauses.append) == {"a": 1}
    assert pauses == [1.0, 2.0, 4.0]

    def refused(_):
        raise urllib.error.HTTPError("u", 404, "", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        source.get_json("u", refused, sleep=pauses.append)

    def silent(_):
        raise OSError("no route")

    with pytest.raises(ConnectionError):
        source.get_json("u", silent, sleep=pauses.append)


def test_pages_through_spark(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"d": {"rows": [{"id": 10 * k + j} for j in range(2)]}}))
    source.register(spark)
    rows = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{page}}.json").option("pages", "3").option("field", "d.rows").option("delay", "0").load()
    assert sorted(r["id"] for r in rows.select(F.get_json_object("value", "$.id").cast("int").alias("id")).collect()) == [0, 1, 10, 11, 20, 21]


class _Service(http.server.BaseHTTPRequestHandler):
    ROWS = [{"ID": k, "Lang": "DE" if k % 2 else "FR", "Name": f"n{k}"} for k in range(25)]
    asked: list = []

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        query = dict(urllib.parse.parse_qsl(url.query))
        _Service.asked.append((url.path, query))
        rows = [r for r in self.ROWS if "$filter" not in query or f"Lang eq '{r['Lang']}'" in query["$filter"]]
        if url.path == "/table/$count":
            body = str(len(rows))
        elif url.path == "/table":
            body = json.dumps({"d": {"results": rows[int(query["$skip"]) :][: int(query["$top"])]}})
        elif url.path == "/index":
            start = int(query["s"])
            hits = "".join(f"<Hit><k>{k}</k></Hit>" for k in range(start, min(start + 4, 10)))
            body = f"<Index xmlns='urn:x' numHits='10'>{hits}</Index>"
        elif url.path == "/sparql":
            body = json.dumps({"results": {"bindings": [{"item": {"value": "Q1"}, "label": {"value": query["query"], "xml:lang": "de"}}, {"item": {"value": "Q2"}}]}})
        else:
            body = json.dumps({"search": [{"id": "Q7", "label": query["search"], "description": "d"}, {"id": "Q8"}]})
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


def test_odata_pushes_filters_and_columns(spark, service):
    source.register(spark)
    read = lambda **o: spark.read.format("odata").options(url=f"{service}/table", columns="ID, Lang", size="10", delay="0", **o).load()
    assert read().count() == 25
    _Service.asked.clear()
    assert sorted(int(r["ID"]) for r in read().filter("Lang = 'DE'").collect()) == list(range(1, 25, 2))
    assert all(q["$filter"] == "Lang eq 'DE'" for _, q in _Service.asked) and any(q.get("$select") == "ID,Lang" for _, q in _Service.asked)
    _Service.asked.clear()
    assert read(first="3").count() == 3
    assert [q["$top"] for p, q in _Service.asked if p == "/table"] == ["3"]


def test_xml_index_bindings_and_search(spark, service):
    source.register(spark)
    rows = spark.read.format("paged_xml").options(url=service + "/index?s={start}", size="4", delay="0").load().collect()
    assert len(rows) == 10 and "0" in rows[0]["value"]
    found = source.bindings(source.answers(spark, f"{service}/sparql", "SELECT {x}", delay=0), ["item", "label"]).collect()
    assert [tuple(r) for r in found] == [("Q1", "SELECT {x}", None, "de"), ("Q2", None, None, None)]
    assert [tuple(r) for r in source.entities(spark, f"{service}/api", "a b", "de", delay=0).collect()] == [("Q7", "a b", "d"), ("Q8", None, None)]


def test_search_fields(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<fields><searchfield type='t' Name='b'/><searchfield Name='a'/><searchfield Name='b'/></fields>")
    assert [r["name"] for r in source.search_fields(spark, str(tmp_path)).orderBy("ord").collect()] == ["b", "a"]
