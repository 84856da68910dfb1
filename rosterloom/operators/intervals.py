"""Closed date intervals with unknown bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.dates import EARLIEST, LATEST, date_of
from rosterloom.operators.lineage import written

#: The rows of each side that a task of a sweep holds at once.
CELL_ROWS = 2_048


def _low(x: Column) -> Column:
    return F.coalesce(x, date_of(EARLIEST))


def _high(x: Column) -> Column:
    return F.coalesce(x, date_of(LATEST))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """A null start is minus infinity, a null end plus infinity; a reversed interval overlaps nothing."""
    return (_low(s1) <= _high(e1)) & (_low(s2) <= _high(e2)) & (_low(s1) <= _high(e2)) & (_low(s2) <= _high(e1))


def covers(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """As ``overlaps``, but an unknown start covers no period."""
    return s1.isNotNull() & s2.isNotNull() & overlaps(s1, e1, s2, e2)


def clip(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    """The first interval cut to the second; as it is where a start is unknown."""
    known = s1.isNotNull() & s2.isNotNull()
    return F.when(known, F.greatest(s1, s2)).otherwise(s1), F.when(known, F.least(e1, e2)).otherwise(e1)


def overlap_join(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], small: bool = False) -> DataFrame:
    """All pairs of rows whose intervals overlap, unknown starts matching nothing.

    With ``small`` the right side is a dimension of at most some hundred rows by its nature (periods), which is
    broadcast. Two large sides meet in ``sweep``.
    """
    ls, le, rs, re_ = (F.col(c) for c in (*l, *r))
    if small:
        return left.join(F.broadcast(right), covers(ls, le, rs, re_))
    return sweep(left, right, l, r)


def _cells(cuts: np.ndarray):
    """Rows with each cell that their interval touches, and whether they start there. ``cuts`` are the first days of the cells but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (batch.column(k).to_numpy() for k in (0, 1))
            first, last = np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high, "right")
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array((first[row] + nth).astype(np.int32)), pa.array(nth == 0)], [*batch.schema.names, "_cell", "_starts"])

    return run


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) for all positions from low to high of each row."""
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _swept(names: list[str], taken: tuple[list[str], list[str]]):
    """The pairs of one cell: those of the rows that are active when another starts, found in the sorted starts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (ls, le, lnew), (rs, re_, rnew) = ([t[c].to_numpy() for c in ("_low", "_high", "_starts")] for t in (left, right))
        pairs = []
        # a right row that starts while the left one lasts, and a left row that starts after the right one has begun
        for mine, last, other, new, side, after in ((ls, le, rs, rnew, 0, "left"), (rs, re_, ls, lnew, 1, "right")):
            fresh = np.flatnonzero(new)
            fresh = fresh[np.argsort(other[fresh], kind="stable")]
            row, at = _ranges(np.searchsorted(other[fresh], mine, after), np.searchsorted(other[fresh], last, "right"))
            pairs.append((row, fresh[at])[:: -1 if side else 1])
        a, b = (pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1))
        return pa.table([*left.select(taken[0]).take(a).columns, *right.select(taken[1]).take(b).columns], names=names)

    return run


def sweep(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """All pairs of rows whose intervals overlap, by a plane sweep over ranges of days.

    The days are cut where the starts of both sides fall into cells of equal numbers, some ``cell_rows`` a side. A row
    stands in the cell where it starts and, as active, in the later ones that it lasts into; a cell is one task's group, whose pairs are found in
    sorted starts, each pair in the cell where its later row starts, so it comes once and only pairs that overlap
    are looked at. Each copy of a long row meets a cell of starts, so copies are paid by results. A cell where many rows
    start or last is cut into blocks of both sides. The driver gathers the cuts, no more than there are days between the
    first start and the last, and two counts for each cell.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    sides, names = [], [*left.columns, *right.columns]
    for d, (s, e), tag in ((left, l, "l"), (right, r, "r")):
        s, e = F.col(s), F.col(e)
        own = [F.col(c).alias(f"_{tag}{k}") for k, c in enumerate(d.columns)]
        sides.append(d.filter(s.isNotNull() & (s <= _high(e))).select(day(s).alias("_low"), day(_high(e)).alias("_high"), *own))
    starts = sides[0].select("_low").unionByName(sides[1].select("_low"))
    days = np.array([(r["_low"], r["n"]) for r in starts.groupBy("_low").agg(F.count("*").alias("n")).collect()], np.int64).reshape(-1, 2)  # a row a day
    days = days[np.argsort(days[:, 0])]
    before = np.cumsum(days[:, 1]) - days[:, 1]
    cuts = days[1:, 0][np.diff(before // (2 * cell_rows)) > 0]
    # written once: the counts, the blocks and the pairs have to see the same rows in the same order
    dealt = [written(d.mapInArrow(_cells(cuts), _schema(d, "_cell int, _starts boolean")), "active") for d in sides]
    counts = [{c["_cell"]: c["n"] for c in d.groupBy("_cell").agg(F.count("*").alias("n")).collect()} for d in dealt]
    both = [(c, -(-counts[0][c] // cell_rows), -(-counts[1][c] // cell_rows)) for c in counts[0] if c in counts[1]]
    blocks = F.broadcast(left.sparkSession.createDataFrame(both, "_cell int, _a int, _b int"))  # a row a cell
    keys, chosen = ["_cell", "_i", "_j"], []
    for d, own, other, (mine, its) in ((dealt[0], "_a", "_b", ("_i", "_j")), (dealt[1], "_b", "_a", ("_j", "_i"))):
        met = d.join(blocks, "_cell").withColumn(mine, F.when(F.col(own) == 1, 0).otherwise(F.floor(F.rand(7) * F.col(own))).cast("int"))
        chosen.append(met.withColumn(its, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_a", "_b"))
    own = [[c for c in d.columns if c not in ("_low", "_high")] for d in sides]
    kinds = ", ".join(f"_{k} {f.dataType.simpleString()}" for k, f in enumerate([*left.schema, *right.schema]))
    met = chosen[0].groupBy(*keys).cogroup(chosen[1].groupBy(*keys)).applyInArrow(_swept([f"_{k}" for k in range(len(names))], tuple(own)), kinds)
    return met.toDF(*names)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], more])


def current_period(periods: DataFrame, number: str, s: str, e: str, today: Column) -> DataFrame:
    """The highest period that contains today, or else the highest."""
    inside = overlaps(F.col(s), F.col(e), today, today)
    row = F.struct(*[F.col(c) for c in periods.columns])
    picked = F.coalesce(F.max_by(row, F.when(inside, F.col(number))), F.max_by(row, F.col(number)))
    return periods.agg(picked.alias("p")).filter("p IS NOT NULL").select("p.*")
