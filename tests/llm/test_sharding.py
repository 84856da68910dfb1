import zlib
from collections import Counter

from rosterloom.llm import sharding

DOCS = "doc_id long, text string, shard string, slot int"


def held(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    return sharding.summary(sharding.shard(spark, docs, **options)).collect()


def test_law_and_slots(spark):
    rows = [(k, f"text {k} " * (k % 7)) for k in range(1001)] + [(5, "same")] * 400 + [(None, None)] * 3
    out = held(spark, rows, bucket_bytes=2000)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_same_seed_same_order(spark):
    rows = [(k, f"t{k}") for k in range(300)]
    one, two, other = (sorted((r["shard"], r["slot"], r["doc_id"]) for r in held(spark, rows, **o)) for o in ({}, {}, {"seed": 3}))
    assert one == two != other


def test_the_same_rows_in_other_partitions_give_the_same_shards(spark):
    rows = [(k, f"text {k}") for k in range(500)] + [(7, "again")] * 300 + [(None, None)] * 20
    outs = []
    for n in (1, 2, 5):
        docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS).repartition(n)
        out = sharding.shard(spark, docs, bucket_bytes=300)
        outs.append(sorted(map(str, ((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in out.collect()))))
    assert outs[0] == outs[1] == outs[2]


def test_a_folder_for_each_shard_and_many_buckets(spark):
    docs = spark.createDataFrame([(k, "x" * 50) for k in range(400)], "doc_id int, text string")
    out = sharding.shard(spark, docs, bucket_bytes=100)
    assert {f.split("/shard=")[1].split("/")[0] for f in out.inputFiles()} == {str(s) for s in range(24)}
    sizes = Counter(r["shard"] for r in out.collect())
    assert sum(sizes.values()) == 400 and max(sizes.values()) - min(sizes.values()) <= 1


def test_few_and_no_rows(spark):
    assert held(spark, []) == []
    assert len(held(spark, [(1, "a"), (2, "b")])) == 2


def test_permutation():
    assert sorted(sharding.fisher_yates(100, 4)) == list(range(100))
    firsts = Counter(sharding.fisher_yates(4, s)[0] for s in range(4000))
    assert all(850 < n < 1150 for n in firsts.values())
