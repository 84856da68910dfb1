"""Sharding: a seeded two-pass external shuffle into shards whose row counts differ by one at most.

First pass: every record is scattered into one of many memory-sized buckets by a seeded hash of its
id, its text and its number among equal records, so a hot id or a text that a third of all rows
share spreads evenly, and the same rows give the same shards however they are cut into partitions. Equal records
are numbered in two steps, within a task and over the tasks that hold some, on rows of ids and hashes;
which of them gets which number makes no difference. Consecutive buckets make a part, the work of one
task; the parts' sizes (a number a task) give each part its place in the whole order. Second pass:
a task reads its part sorted by bucket, each bucket is in a canonical order, is Fisher-Yates shuffled with its
own seed, and its records take consecutive places; each shard is an equal share of the places. A task holds one
bucket at a time, at any number of buckets. The shards are written as folders of files in the shared
folder, one for each shard, so a lost executor repeats a part and nothing else, and a reader of one shard reads
no other. Law: ``rows``, under which equal texts are spread like any others: counts at most one apart cannot keep a group in one shard, so
groups of equal texts have no meaning of their own here.

The scatter is written out as a table before it is used twice; its size is that of the input.

Cases: a null text has no bytes (size 8, crc32 0) and stays null in the shards; null or repeated ids
and rows are kept, each row once; fewer rows than shards leave shards empty; an empty table gives no
rows; columns beside doc_id and text are not carried.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.llm import store

SHARDS = 24
SEED = 20261
#: The aim for a bucket's bytes of text; a bucket is what one task holds in memory.
BUCKET_BYTES = 8 << 20
#: The aim for a part's bytes, the work of one task, and the parts beyond which they have more buckets instead.
PART_BYTES = 32 << 20
MOST_PARTS = 20_000


def fisher_yates(n: int, seed: int) -> list[int]:
    """A uniform permutation of n, by swaps from the end."""
    order, rng = list(range(n)), random.Random(seed)
    for i in range(n - 1, 0, -1):
        j = rng.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def _dealt(starts: dict[int, int], total: int, shards: int, seed: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bucket, place = None, None, 0
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal place
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(fisher_yates(table.num_rows, seed * 1_000_003 + bucket), pa.int64()))
            # shard s owns the places from s * total // shards on
            places = range(place, place + table.num_rows)
            shard = [((p + 1) * shards - 1) // total for p in places]
            slot = [p - s * total // shards for p, s in zip(places, shard)]
            place += table.num_rows
            out = table.select(["doc_id", "text"]).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))
            yield from out.to_batches(max_chunksize=1024)

        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if buckets[a] != bucket:
                    if held:
                        yield from flush()
                        held = []
                    bucket = int(buckets[a])
                    if bucket // width != part:
                        part = bucket // width
                        place = starts[part]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def numbered(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """place and nth (from 0) of those ``rows`` (doc_id, th, place) that have an equal one; the upper bits of place name a task."""
    alike = rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    alike = store.written(spark, alike, "alike")
    again = rows.join(alike, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi").withColumn("task", F.shiftright("place", 33))
    again = store.written(spark, again, "again")
    key = ["doc_id", "th"]
    before = again.groupBy(*key, "task").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy(*key).orderBy("task")) - F.col("n")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("task").alias("_k"), "before")
    before = store.written(spark, before, "before")
    own = again.withColumn("k", F.row_number().over(Window.partitionBy(*key, "task").orderBy("place")) - 1)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("task") == F.col("_k"))
    return store.written(spark, own.join(before, same).select(F.col("place").alias("_p"), (F.col("k") + F.col("before")).alias("nth")), "numbers")


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shards, a folder each, and reads them back: doc_id, text, shard, slot."""
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("place"))
    placed = store.written(spark, placed, "placed")
    total_bytes = placed.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = min(MOST_PARTS, max(1, -(-total_bytes // max(bucket_bytes, PART_BYTES))))
    width = max(1, -(-total_bytes // (bucket_bytes * parts)))  # buckets of a part
    numbers = numbered(spark, placed.select("doc_id", "th", "place"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th", F.coalesce("nth", F.lit(0))), F.lit(parts * width)).alias("bucket")
    scattered = placed.join(numbers, F.col("place") == F.col("_p"), "left").select("doc_id", "text", "th", bucket)
    part = F.floor(F.col("bucket") / width).cast("int")
    counts = {r["part"]: r["n"] for r in scattered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a task
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, shard int, slot bigint"
    dealt = scattered.repartitionById(parts, part).sortWithinPartitions("bucket", "doc_id", "th").mapInArrow(_dealt(starts, total, shards, seed, width), schema)
    return store.written(spark, dealt, "shards", "shard").select("doc_id", "text", "shard", "slot")


def summary(sharded: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharded.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
