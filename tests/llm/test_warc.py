import base64
import gzip
import glob
import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from rosterloom.llm import store, warc

PAGES = "page_id long, url string, html string, digest string, first int"


def brute(rows):
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = firsts.get(h or "")
        again = first is not None and (i is None or i > first)
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    return sorted([tuple(r)[:5] for r in warc.archive(spark, pages, **options).collect()], key=str)


def test_round_trip(spark):
    rng = random.Random(4)
    odd = ["", None, "\r\n", "\r\n\r\n", "a\r\n\r\nb\r\n\r\n", "\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n", "x\r", "\n", "\n\n1 2 3 4 5\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é🎉", "long " * 600000]
    html = odd + ["".join(rng.choice(["\r", "\n", "\r\n\r\n", "a", "<p>"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = [(k, rng.choice([f"http://h/{k}", None, "", "http://a b\n/ü 1"]), h) for k, h in enumerate(html * 2)]
    rows += [(None, None, None), (None, None, "only"), (3, "again", "a"), (3, "again", "a"), (-(1 << 63), "least", "b"), ((1 << 63) - 1, "most", "b")]
    assert got(spark, rows) == brute(rows)


def test_least_and_empty(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    assert [r[3] for r in got(spark, rows, least=3)] == ["response", "response", "response", "revisit"]
    assert got(spark, []) == []


def test_sql(spark):
    rows = [(k, "u", f"<p>{k % 7}</p>ü") for k in range(40)] + [(99, None, None)]
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "html": [r[2] for r in rows]}))
    assert sorted(con.execute(warc.ORACLE).fetchall(), key=str) == brute(rows) == got(spark, rows)


def test_both_versions_and_lengths():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\n\r\n\nhttp://not/ 0.0.0.0 20240101000000 text/html 5\n"
        arc = warc.arc_start("a.arc", version)
        for k in range(3):
            arc += b"\n" + warc.arc_header(f"http://x/{k}", "text/html", len(body), version, 0, "a.arc", "sum") + body
        records = list(warc.parse_arc(arc))
        assert [(r.url, r.content, r.checksum) for r in records] == [(f"http://x/{k}", body, None if version == 1 else "sum") for k in range(3)]
        with pytest.raises(ValueError):
            list(warc.parse_arc(arc[:-2]))


def test_files_are_warc(spark):
    pages = spark.createDataFrame([(7, "http://x/", "hello", "", 0)], PAGES).coalesce(1)
    path = store.place(spark, "warc")
    warc.write(warc.with_types(warc.convert(warc.to_arc(pages))), path)
    (file,) = glob.glob(path.removeprefix("file://") + "/part-*.gz")
    content = gzip.open(file).read()
    assert content.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:") and content.endswith(b"hello\r\n\r\n")


def test_record_ids_are_unique_and_referred_to(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "b"), (None, "u", "b"), (5, "u", "b"), (1, "u", "c")] * 3
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(3)
    path = store.place(spark, "warc")
    warc.write(warc.with_types(store.written(spark, warc.convert(warc.to_arc(pages)), "records")), path)
    content = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file://") + "/part-*.gz"))
    ids = re.findall(rb"WARC-Record-ID: (\S+)", content)
    assert len(ids) == len(set(ids)) == len(rows)
    refers = re.findall(rb"WARC-Refers-To: (\S+)", content)
    assert len(refers) == 9 and set(refers) < set(ids)
