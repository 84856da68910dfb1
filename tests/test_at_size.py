"""Registered queries on tables as they are at larger sizes, against their SQL."""

import datetime
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__
from rosterloom.operators import intervals
from rosterloom.plans import resolve


def same(spark, folder, name, tables):
    """The query's rows equal those of its SQL; a table is its files' rows, in the order of their names."""
    con = duckdb.connect()
    for table, files in tables.items():
        (folder / f"{table}.parquet").mkdir()
        for k, rows in enumerate(files):
            pq.write_table(rows, folder / f"{table}.parquet" / f"part-{k:04}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    found = Counter(tuple(r) for r in got.collect())
    assert found and found == Counter(want)


def test_period_findings_with_customers_numbered_like_suppliers_items(spark, tmp_path):
    keys = [*range(1, 30), 90_001, 90_002, 910_001, 910_002]
    day = lambda y, m: datetime.datetime(y, m, 3)
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    customer = pa.table({"c_custkey": keys, "c_name": [f"Customer#{k:09}" for k in keys], "c_mktsegment": [segments[k % 5] for k in keys]})
    orders = pa.table({"o_custkey": keys * 2, "o_orderdate": pa.array([day(1995 + k % 3, 2) for k in keys] + [day(1998 + k % 4, 9) for k in keys], pa.timestamp("us"))})
    supplier = pa.table({"s_suppkey": [0, 3, 10], "s_name": ["Supplier#0", "Supplier#3", "Supplier#10"]})
    same(spark, tmp_path, "roster_period_findings", {"customer": [customer], "orders": [orders], "supplier": [supplier]})


def test_first_values_are_those_of_the_first_file(spark, tmp_path):
    pages = lambda ids, url: pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array([url(k) for k in ids], pa.string())})
    files = [pages([], str), pages([7], lambda k: "  "), pages([5, 6], lambda k: None if k == 5 else f" http://{k}"), pages(list(range(100, 20_000)), lambda k: f"http://{k}")]
    same(spark, tmp_path, "column_samples", {"pages": files})


def test_intervals_of_many_rows_are_swept_once(spark, tmp_path, monkeypatch):
    sizes, plain = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b, *more: sizes.append((a.count(), b.count())) or plain(a, b, *more))
    day, n = datetime.datetime(1996, 5, 4), 3_000
    later = [day + datetime.timedelta(k) for k in (0, 1, 4)]
    orders = pa.table({"o_orderkey": [*range(1, n + 1), None], "o_orderdate": pa.array([later[k % 3] for k in range(n)] + [day], pa.timestamp("us")), "o_orderstatus": [*("PFO"[k % 2] for k in range(n)), None]})
    lineitem = pa.table({"l_orderkey": [*range(n)], "l_shipdate": pa.array([later[k % 2] if k % 9 else None for k in range(n)], pa.timestamp("us")), "l_linenumber": pa.array([k % 4 if k % 7 else None for k in range(n)], pa.int32()), "l_quantity": [float(k % 40) for k in range(n)]})
    same(spark, tmp_path, "interval_overlap_sweep", {"orders": [orders], "lineitem": [lineitem]})
    assert max(sizes[0]) < 20


def test_members_of_one_name_and_birth_date_are_resolved_as_one_kind(spark, tmp_path, monkeypatch):
    sizes, plain = [], resolve.settled_alike
    monkeypatch.setattr(resolve, "settled_alike", lambda m, pairs, *more: sizes.append((m.count(), pairs.count())) or plain(m, pairs, *more))
    keys = [125 * k + n for k in range(60) for n in (1, 7, 30)]
    parts = [125 * k + n for k in range(4) for n in (1, 7, 30, 18)]
    customer = pa.table({"c_custkey": keys})
    part = pa.table({"p_partkey": parts, "p_size": pa.array([4 if k % 3 == 0 else k % 7 for k in parts], pa.int32()), "p_brand": [f"Brand#{k % 4}" for k in parts]})
    same(spark, tmp_path, "resolve_names", {"customer": [customer], "part": [part]})
    ((members, pairs),) = sizes
    assert members == len(keys) and pairs <= 3 * 8 * len(parts)
