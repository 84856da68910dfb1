import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from rosterloom.llm import topk

VECTORS = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, every, k):
    good = [(i, [np.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w)), j, b) for b, (j, w) in enumerate(good) if b != a and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scored[:k])]
    return sorted(out)


def got(spark, rows, every=10, **options):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], VECTORS)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(spark, df, every, **options).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(900)] + [(1000 + k, [0.5] * 8) for k in range(400)]
    assert got(spark, rows, shard_rows=250, block_queries=40) == brute(rows, 10, 5)
    apart = [(k, (v + np.eye(8)[k % 8] * 40).tolist()) for k, v in enumerate(rng.normal(size=(600, 8)))]
    assert got(spark, apart, shard_rows=50) == brute(apart, 10, 5)


def test_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k % 170, rng.normal(size=4).astype("f4").tolist()) for k in range(200)] + [(0, None)]
    pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e.parquet'")
    assert sorted(con.execute(topk.ORACLE).fetchall()) == got(spark, rows, every=50)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, []), (60, []), (None, [1.0, 1.0]), (70, [3.0]), (1, [-1.0, 0.25]), (1, [-1.0, 0.25]), (80, [1.0, 2.0]), (80, [1.0, 2.0])]
    assert got(spark, rows) == brute(rows, 10, 5)
    assert got(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [float(1 << 20), 1 / 256]), (1, [float(1 << 20), 1 / 256]), (2, [float(1 << 20), 2 / 256]), (3, [-1.0, 1.0])]
    assert got(spark, rows) == brute(rows, 10, 5)
    assert [r[2] for r in got(spark, [(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [3e38, 2.0])])] == [2, 1]
    far = [(0, [1e17, -1e17]), (1, [1e17, -1e17]), (2, [2e17, -1e17]), (3, [3e17, -1e17]), (4, [-3e38, 1.5]), (5, [1e17, 1e17 + 64])]
    assert [(r[2], r[3]) for r in got(spark, far)][:3] == [(3, (1 << 63) - 1), (2, (1 << 63) - 1), (1, (1 << 63) - 1)] and [r[2] for r in got(spark, far)][3:] == [5, 4]
    keys = [-(1 << 90), -300, -1, 0, 1, 255, 256, 1 << 70]
    assert sorted(keys, key=topk._key) == keys and [topk._score(topk._key(k)) for k in keys] == keys


def test_scores_beyond_doubles_over_many_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(np.float32(x)) for x in rng.integers((1 << 22) - 300, 1 << 22, 2) * 1.0]) for k in range(800)]
    assert got(spark, rows, shard_rows=40, block_queries=9) == brute(rows, 10, 5)


def test_boxes_rule_cells_out():
    rows = np.array([[k, 5] for k in range(100)])
    tree = topk.split(rows, 4, 7)
    out = np.zeros(100, np.int32)
    topk.place(tree, rows, np.arange(100), out)
    assert out.tolist() == np.repeat([7, 8, 9, 10], 25).tolist()
    assert topk.split(np.ones((50, 3), np.int64), 4, 0) == (0,)


def test_tree_boxes_are_tight():
    x = np.random.default_rng(1).integers(-50, 50, (700, 5)).astype(float)
    tree = topk.Tree(x, 32)
    for (a, b), low, high in zip(tree.ranges, tree.low, tree.high):
        assert (tree.rows[a:b].min(0) == low).all() and (tree.rows[a:b].max(0) == high).all()
