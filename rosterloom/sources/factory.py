"""From a configuration's name of a source to its roster."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from rosterloom.sources import base, directory, federal, mandates, register

Tables = Callable[[str], DataFrame]


def _federal(spark: SparkSession, table: Tables, councils: dict, today: Column, roles: Sequence[str]) -> base.Roster:
    return federal.read(table("members"), table("history"), table("periods"), list(councils))


def _directory(spark: SparkSession, table: Tables, councils: dict, today: Column, roles: Sequence[str]) -> base.Roster:
    groups = directory.group_ids(table("groups"), councils)
    people = directory.members(table("memberships"), table("persons"), groups, roles, today)
    return base.roster(spark, people, **({"tenures": directory.tenures(table("memberships"), groups)} if groups else {}))


def _register(spark: SparkSession, table: Tables, councils: dict, today: Column, roles: Sequence[str]) -> base.Roster:
    seats = table("seats")
    people = [register.members(seats, table("persons"), table("parties"), chamber, council, today) for council, chamber in councils.items()]
    spells = [register.tenures(seats, chamber, council) for council, chamber in councils.items()]
    return base.roster(spark, reduce(DataFrame.unionByName, people), tenures=reduce(DataFrame.unionByName, spells))


def _mandates(spark: SparkSession, table: Tables, councils: dict, today: Column, roles: Sequence[str]) -> base.Roster:
    own = table("mandates")
    return base.roster(spark, mandates.members(own, table("persons"), councils, roles, today), tenures=mandates.tenures(own, councils))


#: Every kind of source with the tables it reads.
SOURCES: dict[str, tuple[Callable[..., base.Roster], tuple[str, ...]]] = {
    "federal": (_federal, ("members", "history", "periods")),
    "directory": (_directory, ("groups", "memberships", "persons")),
    "register": (_register, ("seats", "persons", "parties")),
    "mandates": (_mandates, ("mandates", "persons")),
}


def build(spark: SparkSession, source: str, table: Tables, councils: dict, today: Column, roles: Sequence[str] = ()) -> base.Roster:
    """The roster of a named source; ``table`` gives its tables by name, ``councils`` maps each council to its chamber's name."""
    if source not in SOURCES:
        raise ValueError(f"source is {source!r}; it can be {', '.join(SOURCES)}")
    return SOURCES[source][0](spark, table, councils, today, roles)


def enrichment(memberships: DataFrame | None, persons: DataFrame | None, groups: dict[str, int]) -> DataFrame | None:
    """Spans of a second source, if one is configured."""
    return None if memberships is None or persons is None or not groups else directory.spans(memberships, persons, groups)
