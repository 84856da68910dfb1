"""Data profiling and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from rosterloom.operators.lineage import cut

CONFIRMED, INCONCLUSIVE, CONTRADICTED = "CONFIRMED", "INCONCLUSIVE", "CONTRADICTED"


def column_coverage(df: DataFrame) -> DataFrame:
    """column_name and filled (neither null nor blank) for every column, in one pass."""
    counts = df.agg(*[F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "filled")


def column_samples(df: DataFrame, columns: Sequence[str] | None = None, at: Column | None = None) -> DataFrame:
    """column_name, filled and the first filled value in the order of ``at``, for every column, in one pass.

    Without ``at`` that is the order in which Spark deals the rows to tasks. For files it isn't that of the table, as larger
    files come first: there ``at`` has to be ``in_files()``, and ``df`` the table as it was read.
    """
    columns = list(columns or df.columns)
    cells = df.select((F.monotonically_increasing_id() if at is None else at).alias("_at"), *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns])
    counts = cells.agg(*[F.struct(F.count(c).alias("filled"), F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias("first")).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "x").select("column_name", "x.filled", "x.first")


def in_files() -> Column:
    """The place of a row of Parquet files: the files by name, the rows as they stand in them."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def histogram(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties in the order of the values."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows pass all conditions up to each stage."""
    out, passed = [F.count("*").alias("n_rows")], F.lit(True)
    for name, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(*out)


def passed(stages: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """For each stage whether a row passes it and all before it; the first is that there is a row at all."""
    out, so_far = {"n_rows": F.lit(True)}, F.lit(True)
    for name, condition in stages:
        so_far = so_far & F.coalesce(condition, F.lit(False))
        out[name] = so_far
    return out


def stage_verdicts(df: DataFrame, keys: Sequence[str], stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """For each key the rows left after each stage, and the stage at which none was left; null if some pass all of them."""
    counts = df.groupBy(*keys).agg(*[F.count_if(x).alias(name) for name, x in passed(stages).items()])
    return counts.withColumn("emptied_by", F.coalesce(*[F.when(F.col(name) == 0, name) for name in ("n_rows", *(n for n, _ in stages))]))


class Watched:
    """Counts of the stages of a fetch, taken in the pass that reads its rows: ``rows`` are the same with the counts observed,
    ``counts`` is known as soon as something has read them all. Where nothing is left the optimizer may drop the watched part of a
    plan that has already run; only then a job of its own counts."""

    def __init__(self, df: DataFrame, stages: Sequence[tuple[str, Column]]):
        self.stages, self._seen = [name for name, _ in stages], Observation()
        self._df, self._counts = df, [F.count_if(x).alias(name) for name, x in passed(stages).items()]
        self.rows = df.observe(self._seen, *self._counts)

    @property
    def counts(self) -> dict[str, int]:
        try:
            return self._seen.get
        except Py4JError:
            return self._df.agg(*self._counts).first().asDict()

    @property
    def verdict(self) -> str:
        """What a fetch gives: its last count, or the stage that emptied it."""
        found = self.counts
        stage = next((n for n in ("n_rows", *self.stages) if not found[n]), None)
        listed = ", ".join(f"{n} {found[n]}" for n in ("n_rows", *self.stages))
        return f"{found[self.stages[-1]]} rows pass ({listed})" if stage is None else f"the source gives no rows at all ({listed})" if stage == "n_rows" else f"the stage {stage} leaves none of the rows before it ({listed})"


def key_quality(df: DataFrame, name: str, key: str, mark: str) -> DataFrame:
    """Names with several keys: split, if two keys share a distinguishing mark; undecided, if a key has no mark at all; else
    namesakes."""
    keys = df.groupBy(name).agg(F.count_distinct(key).alias("keys"))
    shared = df.filter(F.col(mark).isNotNull()).groupBy(name, mark).agg(F.count_distinct(key).alias("_c")).groupBy(name).agg(F.max("_c").alias("_c"))
    bare = df.groupBy(name, key).agg(F.count(mark).alias("_m")).groupBy(name).agg(F.min("_m").alias("_least"))
    quality = F.when(F.col("keys") == 1, "one").when(F.col("_c") > 1, "split").when(F.col("_least") == 0, "undecided").otherwise("namesakes")
    return keys.join(shared, name, "left").join(bare, name).select(name, "keys", quality.alias("quality"))


def name_index(df: DataFrame, key: Column, row: str) -> DataFrame:
    """The rows of each key, sorted, and their number; rows whose key is blank are counted under an empty one, without their list."""
    own = F.coalesce(key, F.lit(""))
    out = df.groupBy(own.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(own != "", F.col(row)))).alias("rows"))
    return out.select("key", "n", "rows")


def people_count(df: DataFrame, person: str | None) -> DataFrame:
    """Distinct people; without a column for them, rows."""
    return df.agg((F.count_distinct(person) if person and person in df.columns else F.count("*")).alias("people"))


def ranked(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    """The n most frequent values with their share of all rows in percent, ties in the order of the values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.orderBy(F.desc("n"), column).limit(n).join(total, how="cross").select(column, "n", F.round(100.0 * F.col("n") / F.col("_t"), 1).alias("share"))  # one row on the right


def verdict(*ladder: tuple[Column, str]) -> Column:
    """The verdict of the first condition that holds, else CONFIRMED."""
    out = None
    for condition, found in ladder:
        out = F.when(condition, found) if out is None else out.when(condition, found)
    return F.lit(CONFIRMED) if out is None else out.otherwise(CONFIRMED)


def worst(df: DataFrame, column: str) -> DataFrame:
    """One row with the worst of all verdicts."""
    severity = F.when(F.col(column) == CONTRADICTED, 2).when(F.col(column) == INCONCLUSIVE, 1).otherwise(0)
    top = df.agg(F.max(severity).alias("s"))
    return top.select(F.when(F.col("s") == 2, CONTRADICTED).when(F.col("s") == 1, INCONCLUSIVE).otherwise(CONFIRMED).alias(column))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order without gathering them: a range sort, the sizes of its
    partitions, and each row's place in its own. The sorted rows are checkpointed, so both uses see the same partitions."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33))
    ranged = cut(ranged)
    sizes = ranged.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")
