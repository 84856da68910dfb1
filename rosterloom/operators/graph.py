"""Groups of rows that compete for the same things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.lineage import cut

MOST_ROUNDS = 60


def reach(pairs: DataFrame, node: str, thing: str) -> DataFrame:
    """(node, group): the least node that each reaches over shared things.

    A round takes the least group over each node's things and then the group of that group, so the way
    halves with every round: rounds grow with the logarithm of the longest chain. Lineage is cut in every round.
    """
    links = cut(pairs.select(node, thing).distinct())
    now = links.select(node, F.col(node).alias("group")).distinct()
    for _ in range(MOST_ROUNDS):
        of_thing = links.join(now, node).groupBy(thing).agg(F.min("group").alias("group"))
        near = links.join(of_thing, thing).groupBy(node).agg(F.min("group").alias("near"))
        # what a node's old group has now found is the group of all that point to it
        told = near.join(now, node).groupBy("group").agg(F.min("near").alias("told"))
        near = near.join(now, node).join(told, "group").select(node, F.least("near", "told").alias("near"), F.col("group").alias("was"))
        jump = near.select(F.col(node).alias("_n"), F.col("near").alias("_g"))
        after = cut(near.join(jump, F.col("near") == F.col("_n"), "left").select(node, F.least("near", "_g").alias("group"), "was"))
        if after.filter("group <> was").isEmpty():
            return after.select(node, "group")
        now = after.select(node, "group")
    raise RuntimeError("groups did not settle")
