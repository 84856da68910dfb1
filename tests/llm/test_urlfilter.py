import random

import duckdb
import pyarrow as pa

from rosterloom.llm import urlfilter as u


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, "allow")


ODD = [None, "", "example.com/en/", "http://", "://net/es/", "HTTP://EXAMPLE.com/en/x?y#z", "x://a.net/es/", "x://anet/es/", "x://net", "x://net/es", "x://WWW.example.com/en/?q", "x://bwww.example.com/en/", "x://a..net/fr/1", "x://com?/en/", "x://com/", "http://a://b/c", "x://É.net/es/ü"]


def test_against_brute_force_and_sql(spark):
    rng = random.Random(1)
    urls = ODD + [f"https://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{k}" for k in range(500)] * 2
    rows = [(k, x, "clash", 1) for k, x in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages).collect()}
    assert got == {k: brute(x, u.RULES) for k, x in enumerate(urls)}
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows]}))
    assert {r[0]: r[1:] for r in con.execute(u.oracle()).fetchall()} == got


def test_many_rules(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["allow", "block"]), f"h{k}.org", rng.choice(["/", "/a/", "/abc"])) for k in range(2500)]
    urls = [f"http://x.h{rng.randrange(2000)}.org{rng.choice(['/', '/a/b', '/abcd', ''])}" for _ in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages, rules).collect()}
    assert got == {k: brute(x, rules) for k, x in enumerate(urls)}


def test_cascade_is_exact_on_its_universe(spark):
    names = [f"k{n}" for n in range(5000)]
    listed = names[::40]
    universe = spark.createDataFrame([(n,) for n in names], "key string")
    cascade, other = u.build(universe, len(names), [listed, names[7::50]])
    assert len(cascade.levels) > 2
    assert other.listed(pa.array(names)).tolist() == [n in set(names[7::50]) for n in names]
    assert cascade.listed(pa.array(names)).tolist() == [n in set(listed) for n in names]


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert u.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), []).first()["verdict"] == "allow"
