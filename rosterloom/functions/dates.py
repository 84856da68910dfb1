"""Dates at day precision. Nothing below day precision ever becomes a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The federal source's "no date": this day and all before it.
FEDERAL_NONE = "1753-01-01"
#: From here on an end date means "open".
OPEN_FROM = "2900-01-01"
EARLIEST, LATEST = "0001-01-01", "9999-12-31"


def date_of(text: str) -> Column:
    return F.lit(text).cast("date")


def iso_date(x: Column) -> Column:
    """The day of an ISO date or date and time; years, months and impossible days are null."""
    t = F.trim(x.cast("string"))
    head = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    return F.when(head != "", head.try_cast("date"))


def federal_date(x: Column) -> Column:
    d = iso_date(x)
    return F.when(d > date_of(FEDERAL_NONE), d)


def compact_date(x: Column) -> Column:
    """ISO, or eight digits."""
    t = F.trim(x.cast("string"))
    return F.coalesce(iso_date(t), F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("date")))


def open_end(x: Column) -> Column:
    d = compact_date(x)
    return F.when(d < date_of(OPEN_FROM), d)


def composed_date(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts; null unless all three are there and make a day."""
    parts = [F.trim(p.cast("string")) for p in (year, month, day)]
    whole = parts[0].rlike(r"^\d{1,4}$") & parts[1].rlike(r"^\d{1,2}$") & parts[2].rlike(r"^\d{1,2}$")
    iso = F.concat_ws("-", F.lpad(parts[0], 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(whole, iso.try_cast("date"))


def graph_date(x: Column) -> Column:
    """The day of a graph time value, with or without its plus sign."""
    return iso_date(F.regexp_replace(F.trim(x), r"^\+", ""))


def time_literal(d: Column) -> Column:
    return F.concat(F.lit("+"), F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00Z/11"))


def date_text(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("unknown"))


def plausible_year(x: Column, this_year: int) -> Column:
    """Four digits from 1850 to this year, as a number; else null."""
    t = F.trim(x.cast("string"))
    y = t.try_cast("int")
    return F.when(t.rlike(r"^\d{4}$") & y.between(1850, this_year), y)


def gap_days(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier)
