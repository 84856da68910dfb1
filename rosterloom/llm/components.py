"""Connected components by alternating large-star and small-star rounds over link tables.

Every round is two aggregations and two joins on rows of two ids; a node with very many links is a
skewed key of these joins and never one group in memory. Each aggregate is written before it is joined, so
a join has a plain shuffle on both sides, which adaptive execution splits where a key is hot. Each
round's links are written to the shared folder, so lineage stays short. The number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import store

MOST_ROUNDS = 60


def _print(links: DataFrame) -> tuple:
    """A fingerprint of a set of links that doesn't depend on their order."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (u, v): the smallest id that it reaches. Links of a
    node to itself and links with a null are left out; repeated links count once."""
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = store.written(spark, now, "links")
    seen = _print(now)
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.written(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = store.written(spark, large, "large")
        least_of_large = store.written(spark, large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least_of_large, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least_of_large.select("u", F.col("m").alias("v"))).distinct()
        after = store.written(spark, small, "links")
        store.removed(spark, least, large, least_of_large)
        got = _print(after)
        store.removed(spark, now)
        now = after
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
