"""Assignment in order, in parallel: each member takes what its rule picks from what the members before it left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.graph import reach
from rosterloom.operators.lineage import removed, written

MOST_ROUNDS = 1_000


def settled(pairs: DataFrame, member: str, item: str, picks: Callable[[DataFrame], DataFrame], whole: bool) -> DataFrame:
    """(member, item): what a fold over the members in their order gives, each item once.

    ``pairs`` are the items that members may take; the member column is unique to a member and orders it. ``picks`` gives from
    pairs (member, item) for each member that picks one. A round settles the members whose pick nobody before
    them can change, and takes their items from all others: one that is the first among all that want its pick, if the rule looks
    at nothing else (``whole`` is false); if it looks at all of them, see ``settled_alike``.
    So each round settles at least one pick of each group, and in most data nearly all. What is left is written after each round.
    """
    if whole:
        alike = pairs.select(F.col(member).alias("_alike"), F.col(member).alias("_member")).distinct()
        return settled_alike(alike, pairs, member, item, picks).select(F.col("_member").alias(member), item)
    left, done = written(pairs, "wanted"), []
    for _ in range(MOST_ROUNDS):
        now = written(picks(left).select(F.col(member).alias("_m"), F.col(item).alias("_pick")), "picks")
        first = left.groupBy(item).agg(F.min(member).alias("_first")).withColumnRenamed(item, "_i")
        ready = now.join(first, (F.col("_pick") == F.col("_i")) & (F.col("_m") == F.col("_first"))).select(F.col("_m").alias("_r"))
        ready = written(ready, "ready")
        taken = written(now.join(ready, F.col("_m") == F.col("_r"), "left_semi"), "taken")
        done.append(taken)
        rest = left.join(ready, F.col(member) == F.col("_r"), "left_anti").join(taken.select("_pick"), F.col(item) == F.col("_pick"), "left_anti")
        before, left = left, written(rest, "wanted")
        removed(before, now, ready)
        if left.isEmpty():
            removed(left)
            return reduce(DataFrame.unionByName, done).select(F.col("_m").alias(member), F.col("_pick").alias(item))
    raise RuntimeError(f"members were not settled in {MOST_ROUNDS} rounds")


def settled_alike(members: DataFrame, pairs: DataFrame, alike: str, item: str, picks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_member, item): the same fold, for members that choose alike and a rule that looks at all of a member's items.

    ``members`` are (_alike, _member), ``pairs`` the items of each kind of members, once however many members it has. ``picks``
    gives the pick of a kind. A kind's pick changes only when another kind takes one of its items, so its members after the last such
    one (``_after``) either all pick nothing or the first of them picks. In a group, connected by items, nothing changes before the
    first member that picks; so a kind that picks nothing waits for that one at least. A round takes the picks of the kinds whose next
    member comes before those of all kinds that share any of their items: that of each group's first at least. Rounds are as many as
    picks in a chain that depend on each other, whatever the number of members. Kinds without a pick are not looked at again once their group has none.
    """
    group = reach(pairs.select(F.col(alike).alias("_node"), F.col(item).alias("_thing")), "_node", "_thing").select(F.col("_node").alias("_k"), F.col("group").alias("_group"))
    members, left, done = written(members, "members"), written(pairs, "wanted"), []
    least = members.agg(F.min("_member") - 1).first()[0]
    state = written(group.withColumn("_after", F.lit(least).cast(members.schema["_member"].dataType)), "state")
    after = lambda kinds: members.join(kinds, (F.col("_alike") == F.col("_k")) & (F.col("_member") > F.col("_from"))).groupBy("_k").agg(F.min("_member").alias("_next"))
    while not left.isEmpty():
        now = written(picks(left).select(F.col(alike).alias("_p"), F.col(item).alias("_pick")), "picks")
        due = written(after(state.join(now, F.col("_k") == F.col("_p"), "left_semi").select("_k", F.col("_after").alias("_from"))), "due")
        first = state.join(due, "_k").groupBy("_group").agg(F.min("_next").alias("_first"))
        idle = state.join(due, "_k", "left_anti").join(first, "_group").select("_k", F.greatest("_after", "_first").alias("_from"))
        # a kind that picks but has no member left neither takes nor loses anything any more
        idle = idle.join(now, F.col("_k") == F.col("_p"), "left_anti")
        soon = written(due.withColumn("_due", F.lit(True)).unionByName(after(idle).withColumn("_due", F.lit(False))), "soon")
        met = left.join(soon, F.col(alike) == F.col("_k")).select("_k", item, "_next", "_due")
        rivals = met.groupBy(item).agg(F.min("_next").alias("_least"))
        ready = met.filter("_due").join(rivals, item).groupBy("_k").agg(F.min("_least").alias("_least"), F.min("_next").alias("_next")).filter("_least = _next")
        taken = written(ready.join(now, F.col("_k") == F.col("_p")).select(F.col("_next").alias("_member"), F.col("_pick").alias(item)), "taken")
        done.append(taken)
        # who could have taken it looks again, from the member after the one that did
        told = left.join(taken, item).groupBy(F.col(alike).alias("_t")).agg(F.max("_member").alias("_at"))
        rest = left.join(soon.select("_k"), F.col(alike) == F.col("_k"), "left_semi").join(taken.select(item), item, "left_anti").select(left.columns)
        later = state.join(soon.select("_k"), "_k", "left_semi").join(told, F.col("_k") == F.col("_t"), "left").select("_k", "_group", F.greatest("_after", "_at").alias("_after"))
        before, state, left = (state, left, now, due, soon), written(later, "state"), written(rest, "wanted")
        removed(*before)
    removed(left, state, members)
    if not done:  # there were no pairs
        return pairs.select(F.lit(least).cast(members.schema["_member"].dataType).alias("_member"), item)
    return reduce(DataFrame.unionByName, done)
