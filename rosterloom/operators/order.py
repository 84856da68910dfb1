"""The orders in which a run lists things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text


def roster_order() -> list[Column]:
    """Members by council, then by last and given name with case folded; ties keep the order of the source."""
    name = text.given_and_last(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("full_name"))
    return [F.col("council"), text.folded(F.concat_ws(", ", name["last"], name["given"])), F.col("ord")]


def register_order(last: str, first: str) -> list[Column]:
    """A register's members by their names as they are written."""
    return [F.coalesce(last, F.lit("")), F.coalesce(first, F.lit(""))]


def by_number(periods: DataFrame) -> DataFrame:
    return periods.orderBy("number")


def newest(periods: DataFrame, n: int) -> DataFrame:
    """The n latest periods, the latest first."""
    return periods.orderBy(F.desc("number")).limit(n)


def of_number(periods: DataFrame, number: int) -> DataFrame:
    """The period of a number, if there is one."""
    return periods.filter(F.col("number") == number).limit(1)


def by_item(people: DataFrame) -> DataFrame:
    """People by item id as text, so Q10 stands before Q9."""
    return people.orderBy("qid")
