"""Substring deduplication with prefix-partitioned suffix trees.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``LENGTH`` consecutive words of one document;
the words of a window whose words also start in a document with a smaller doc_id are removed.

Suffixes that begin a window are split into groups by a prefix of variable length that all
equal windows choose alike. The choice anchors a window at the one of its first ``LENGTH - p + 1``
places whose ``p`` words hash least: those words are its prefix, and neighbouring windows, which
mostly share it, travel as one string (a run). Runs with equal content are collapsed before anything
else, so the exact and near copies of a text, however many, are one string with its first
document. A prefix that stands in a single document is dropped at once (rows of hashes only); one
with a single distinct run needs no tree. What is left are the borders of repeats: the words of
these runs are fetched from the first document of each. A prefix with more than ``GROUP_RUNS`` distinct runs
gets a longer one: its runs are texts of their own, cut by prefixes twice as long, and so on until
each group fits; prefixes as long as a window end it, as then a group has one run, or in text that repeats
one word ``LENGTH`` at most. Groups of whole prefixes, up to ``TREE_WORDS`` words together, become
suffix trees: suffixes sorted by prefix doubling, and between neighbours the depth at which they
branch. The maximal ranges of suffixes with branchings no less deep than ``LENGTH`` are the subtrees
below the deep internal nodes, that is, the maximal repeats; a window is removed if its subtree holds
a suffix of a smaller document.

Sizes: the first pass has a row of hashes for about every twentieth word; text is shuffled twice, to
meet its border runs and its removed windows. Nothing is gathered on the driver. 128 bits of hash stand
for a run or a text.

Cases: null and empty texts have no words; a document with fewer than ``LENGTH`` words is kept whole;
a null doc_id is neither smaller nor larger than others, so its document is kept whole and removes
nothing; rows with the same doc_id never remove from each other, even if their texts are equal;
very long texts are read whole; an empty table gives no rows; other columns, whatever their names, are carried unchanged,
only that ``dedup`` gives its own three columns in place of columns with their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm import store
from rosterloom.llm import textkernel as tk

LENGTH = 50
PREFIX = 10
GROUP_RUNS = 1_000
TREE_WORDS = 1_000_000
#: The words of two windows cover a run with no more windows than this, so their hashes name it.
MOST_WINDOWS = LENGTH

RUN = "key bigint, s1 bigint, s2 bigint, n int, ua bigint, ub bigint, doc bigint, start int"
_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(length: int, prefix: int):
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in tk.by_document(batch):
                words = tk.Words(data, offsets)
                if not len(words) or words.counts.max() < length:
                    continue
                one, two = words.hashes(0), words.hashes(1)
                key = tk.sliding_min(tk.ngrams(one, prefix), length - prefix + 1)
                at = np.flatnonzero(tk.window_starts(words.first, length))
                fresh = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(key[at].view(np.int64)) != 0)))
                begin = np.flatnonzero(fresh)
                n = np.diff(np.concatenate((begin, [len(at)])))
                pieces = -(-n // MOST_WINDOWS)
                k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                n = np.minimum(MOST_WINDOWS, np.repeat(n, pieces) - k * MOST_WINDOWS)
                start = at[np.repeat(begin, pieces)] + k * MOST_WINDOWS
                names_of = []
                for h, seed in ((one, 0), (two, 1)):
                    g = tk.ngrams(h, length, seed)
                    names_of.append(tk.mix(g[start] * _U(0x9E3779B97F4A7C15) + g[start + n - 1] + n.astype(_U)))
                doc = np.searchsorted(words.first, start, "right") - 1
                whose = pa.array(row + doc, pa.int64())
                columns = [_signed(key[start]), *map(_signed, names_of), pa.array(n, pa.int32()), *[batch.column(k).take(whose) for k in range(3)], pa.array(start - words.first[doc], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _normal(words: tk.Words, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the kept words, each followed by one space, and where each kept word begins."""
    start, end = (words.start, words.end) if kept is None else (words.start[kept], words.end[kept])
    sizes = end - start + 1
    begins = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 32, np.uint8)
    within = np.arange(len(out)) - np.repeat(begins, sizes)
    inked = within < np.repeat(sizes, sizes) - 1
    out[inked] = words.data[(np.repeat(start, sizes) + within)[inked]]
    return out, begins


BORDER = "s1 bigint, s2 bigint, key bigint, n int, hot boolean, first bigint, text binary"


def _fetched(length: int):
    """The words of the requested runs; a text that stands in several rows of a task gives them once."""
    names = [x.split()[0] for x in BORDER.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()
        for batch in batches:
            one, two, docs = (batch.column(k).to_pylist() for k in range(3))
            wanted = batch.column(4)
            for row, to, data, offsets in tk.by_document(batch):
                words = tk.Words(data, offsets)
                text, begins = _normal(words)
                begins = np.append(begins, len(text))
                out: list[list] = [[] for _ in names]
                for doc in range(row, to):
                    if (one[doc], two[doc]) in done:
                        continue
                    done.add((one[doc], two[doc]))
                    first = int(words.first[doc - row])
                    for w in wanted[doc].as_py():
                        a = first + w["start"]
                        own = text[begins[a] : begins[a + w["n"] + length - 1] - 1].tobytes()
                        for column, value in zip(out, (w["s1"], w["s2"], w["key"], w["n"], w["hot"], docs[doc], own)):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return run


class SuffixTree:
    """The suffixes of strings of words in order, and the depth at which neighbours branch.

    ``words`` are the strings run together, ``first`` as in ``textkernel.Words``, ``at`` the places of
    the suffixes to hold. Nodes of a suffix tree are the maximal ranges of neighbours whose
    branchings are no less deep than the node.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, at: np.ndarray):
        size = int(np.diff(first).max())
        ends = np.repeat(first[1:], np.diff(first))
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        levels, width = [rank], 1
        while width < size:  # prefix doubling: the order of the first 2 * width words of each suffix
            follow = np.zeros_like(rank)
            follow[: max(0, len(rank) - width)] = rank[width:]
            follow[np.arange(len(rank)) + width >= ends] = 0
            rank = np.unique(rank * (len(rank) + 2) + follow, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
            levels.append(rank)
        self.order = at[np.argsort(rank[at], kind="stable")]
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        self.depth = np.zeros(len(a), np.int64)
        room_a, room_b = ends[a] - a, ends[b] - b
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            fits = (room_a >= step) & (room_b >= step)
            same = np.zeros(len(a), bool)
            same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
            # ranks of suffixes that are cut short by the end are told apart by ``fits``
            self.depth += same * step
            a, b, room_a, room_b = a + same * step, b + same * step, room_a - same * step, room_b - same * step

    def repeats(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix in order the number of its subtree below ``depth``, and where subtrees begin."""
        begin = np.concatenate(([True], self.depth < depth)) if len(self.order) else np.zeros(0, bool)
        return np.cumsum(begin) - 1, np.flatnonzero(begin)


def _trees(length: int):
    """Windows of runs, as lists of first and past-the-last ones, that a smaller document has too. Batches are sorted by key and run."""
    names = ["s1", "s2", "a", "b"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def solved(table: pa.Table) -> pa.RecordBatch:
        data, offsets = tk.column_bytes(table["text"])
        words = tk.Words(data, offsets)
        n, docs = table["n"].to_numpy(), table["first"].to_numpy()
        string = np.repeat(np.arange(len(n)), n)
        at = np.repeat(words.first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        tree = SuffixTree(words.hashes(0), words.first, at)
        whose = np.empty(len(words), np.int64)
        whose[at] = string
        node, begin = tree.repeats(length)
        least = np.minimum.reduceat(docs[whose[tree.order]], begin)
        gone = np.zeros(len(words), bool)
        gone[tree.order] = least[node] < docs[whose[tree.order]]
        out: list[list] = [[] for _ in names]
        one, two = table["s1"].to_numpy(), table["s2"].to_numpy()
        for s in np.unique(string[gone[at]]).tolist():
            own = gone[words.first[s] : words.first[s] + n[s]].astype(np.int8)
            edge = np.diff(np.concatenate(([0], own, [0])))
            for column, value in zip(out, (one[s], two[s], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, (None, None, None)
        for batch in batches:
            run_ids = np.stack([batch.column(k).to_numpy() for k in (2, 0, 1)], 1)
            fresh = (np.diff(run_ids, axis=0, prepend=run_ids[:1]) != 0).any(1)
            fresh[0] = tuple(run_ids[0].tolist()) != last
            batch, keys = batch.filter(pa.array(fresh)), run_ids[fresh, 0]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and keys[a] != last[0] and size >= TREE_WORDS:
                    yield solved(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += (b - a) * (length + 20)
                last = (keys[a], None, None)
            last = tuple(run_ids[-1].tolist())
        if held:
            yield solved(pa.Table.from_batches(held))

    return run


def _removals(spark: SparkSession, texts: DataFrame, length: int, prefix: int, group_runs: int) -> DataFrame:
    """ua, ub and the removed windows (arrays a and b of first and past-the-last ones) of ``texts`` (ua, ub, doc, text); ua and
    ub name a text, doc orders them."""
    runs = store.written(spark, texts.mapInArrow(_runs(length, prefix), RUN), "runs")
    # aggregates are written before they are joined: a join of two plain shuffles is one whose hot keys can be split
    spread = store.written(spark, runs.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("key"), "spread")
    shared = store.written(spark, runs.join(spread, "key", "left_semi"), "shared")
    distinct = shared.groupBy("s1", "s2", "key", "n").agg(F.min(F.struct("doc", "ua", "ub", "start")).alias("f"), F.max("doc").alias("last"))
    distinct = store.written(spark, distinct.select("s1", "s2", "key", "n", "f.*", "last"), "distinct")
    several = store.written(spark, distinct.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    hot = (F.col("m") > group_runs) & F.lit(prefix < length)
    wanted = distinct.join(several, "key").select("ua", "ub", F.struct("start", "n", "key", "s1", "s2", hot.alias("hot")).alias("w"))
    lists = wanted.groupBy("ua", "ub").agg(F.collect_list("w").alias("w"))  # a text's own runs
    border = store.written(spark, texts.join(lists, ["ua", "ub"]).select("ua", "ub", "doc", "text", "w").mapInArrow(_fetched(length), BORDER), "border")
    cold = border.filter("NOT hot").repartition("key").sortWithinPartitions("key", "s1", "s2")
    found = cold.mapInArrow(_trees(length), "s1 bigint, s2 bigint, a array<int>, b array<int>")
    if prefix < length and not several.filter(F.col("m") > group_runs).isEmpty():
        longer = border.filter("hot").select(F.col("s1").alias("ua"), F.col("s2").alias("ub"), F.col("first").alias("doc"), "text")
        found = found.unionByName(_removals(spark, longer, length, min(2 * prefix, length), group_runs).toDF("s1", "s2", "a", "b"))
    found = store.written(spark, found, "found").dropDuplicates(["s1", "s2"])
    told = distinct.select("s1", "s2", F.col("doc").alias("first"), "last").join(found, ["s1", "s2"], "left").filter("last > first OR a IS NOT NULL").drop("last")
    told = store.written(spark, told, "told")
    hit = shared.join(told, ["s1", "s2"]).filter("doc > first OR a IS NOT NULL")
    later = F.col("doc") > F.col("first")
    a = F.when(later, F.array(F.col("start"))).otherwise(F.transform("a", lambda x: x + F.col("start")))
    b = F.when(later, F.array(F.col("start") + F.col("n"))).otherwise(F.transform("b", lambda x: x + F.col("start")))
    # a set, so that rows that repeat a text give its spans once
    spans = hit.select("ua", "ub", F.struct(a.alias("a"), b.alias("b")).alias("s")).groupBy("ua", "ub").agg(F.collect_set("s").alias("s"))
    return spans.select("ua", "ub", F.flatten(F.transform("s", lambda x: x["a"])).alias("a"), F.flatten(F.transform("s", lambda x: x["b"])).alias("b"))


def _marked(spark: SparkSession, docs: DataFrame, length: int, prefix: int, group_runs: int) -> DataFrame:
    """row (a struct of all columns), n_words, n_removed and kept_text for each row of ``docs``."""
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    doc = F.col("doc_id").cast("bigint")
    spans = _removals(spark, named.select(doc.alias("ua"), F.xxhash64("text").alias("ub"), doc.alias("doc"), "text"), length, prefix, group_runs)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    same = (F.col("row.doc_id").cast("bigint") == F.col("ua")) & (F.xxhash64("row.text") == F.col("ub"))
    known = rows.filter("row.doc_id IS NOT NULL").join(spans.hint("shuffle_hash"), same, "left").select("row", "a", "b")
    none = F.lit(None).cast("array<int>")
    unknown = rows.filter("row.doc_id IS NULL").select("row", none.alias("a"), none.alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops = batch.column(1), batch.column(2)
            kept_texts, n_words, n_removed = [], [], []
            whole, at = tk.column_bytes(batch.column(0).field("text"))
            for row, to in tk.slices(at):
                data, offsets = whole[at[row] : at[to]], at[row : to + 1] - at[row]
                words = tk.Words(data, offsets)
                change = np.zeros(len(words) + 1, np.int64)
                own, other = starts.slice(row, to - row), stops.slice(row, to - row)
                sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                if sizes.sum():
                    base = np.repeat(words.first[:-1], sizes)
                    np.add.at(change, base + own.flatten().to_numpy(), 1)
                    np.add.at(change, base + other.flatten().to_numpy() + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                text, begins = _normal(words, ~gone)
                total = np.concatenate(([0], np.cumsum(~gone)))
                bytes_at = np.append(begins, len(text))
                content = text.tobytes()
                for d in range(to - row):
                    a, b = int(total[words.first[d]]), int(total[words.first[d + 1]])
                    kept_texts.append(content[bytes_at[a] : bytes_at[b] - 1] if b > a else b"")
                    n_words.append(int(words.first[d + 1] - words.first[d]))
                    n_removed.append(n_words[-1] - (b - a))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", *RESULTS])

    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return known.unionByName(unknown).mapInArrow(run, schema)


RESULTS = ("n_words", "n_removed", "kept_text")


def dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the kept words joined by one space) for each row."""
    done = _marked(spark, docs, length, prefix, group_runs)
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def clean(spark: SparkSession, docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``docs`` with the kept words in place of the text (and their number of characters in n_chars, if there is such a column)
    where words were removed, all else as it was."""
    lost, row = F.col("n_removed") > 0, F.col("row")
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    columns = [F.when(lost, new[c].cast(docs.schema[c].dataType)).otherwise(row.getField(c)).alias(c) if c in new else row.getField(c).alias(c) for c in docs.columns]
    return _marked(spark, docs, length, prefix, group_runs).select(*columns)


def summary(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB SQL over the table documents.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), m AS (
  SELECT h, min(doc_id) AS lo FROM p GROUP BY h
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM p JOIN m USING (h) WHERE lo < doc_id
), a AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), k AS (
  SELECT a.doc_id, count(*) - count(g.pos) AS n_kept, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY a.pos) AS kept
  FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""
