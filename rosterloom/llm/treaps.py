"""Ranked lexical search with an inverted treap for each term.

Terms are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased. The documents are scanned once for each
block of items (a stated query set): each document with a term leaves its number of terms and its occurrences of the items'
terms. The sizes of the collection and the terms' document frequencies are summed from that table, and with them
each occurrence has its impact, a whole number.

A task reads its postings in shards. In a shard each term of the items has a treap over the documents that hold it:
in search order by doc_id and in heap order by impact, so a subtree's root is its maximum. All treaps of an item are
traversed together: a state is a range of doc_ids with one subtree of each term; where the roots' impacts sum up to less
than the item's k-th score, or to as much where no doc_id of the range is smaller than that of the k-th document, the range
holds nothing new and is pruned. Otherwise the range is split at the document of the strongest root: its score is
what the treaps hold for it, and each treap falls into a part left and right of it. The k-th score found in a shard is
handed on to the next one of the task; the tasks' best are merged by item. A group of items is traversed level by
level, so the work is done on whole arrays.

A task holds one shard and k rows for each item of a block. Items are equal when they are the same row; terms when their
64-bit hashes are.

Cases: a null text has no terms; documents without terms count nowhere, items without terms return nothing; repeated
documents are ranked each; documents with a null doc_id are ranked, after all others with their score; repeated
items are answered each under their item_id; empty tables return nothing; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.llm import store
from rosterloom.llm import textkernel as tk

K = 10
SHARD_POSTINGS = 1 << 19
#: Items whose treaps are traversed together, and items of a block, for which the documents are scanned.
GROUP_ITEMS = 8
BLOCK_ITEMS = 2048
FILTER_BITS = 20
_NULL = (1 << 63) - 1


class Treaps:
    """The treaps of many terms: postings in order of (term, document), each with its left and right child."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int):
        self.doc, self.impact = doc, impact
        cuts = np.searchsorted(term, np.arange(terms + 1)).tolist()
        heights, n = impact.tolist(), len(impact)
        left, right, roots = [-1] * n, [-1] * n, [-1] * terms
        for t in np.flatnonzero(np.diff(cuts)).tolist():
            spine: list[int] = []  # the nodes on the right edge, each of lesser impact than the one before
            for i in range(cuts[t], cuts[t + 1]):
                below, own = -1, heights[i]
                while spine and heights[spine[-1]] < own:
                    below = spine.pop()
                left[i] = below
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            roots[t] = spine[0]
        self.left, self.right, self.roots = (np.array(x, np.int64) for x in (left, right, roots))

    def split(self, node: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Along the path of each subtree ``node`` to the document ``at``: the posting of that document, and the highest
        ones in the ranges (low, at) and (at, high); -1 where there is none."""
        hit, below, above = (np.full(len(node), -1) for _ in range(3))
        todo, now = np.arange(len(node)), node
        while len(todo):
            x, d = self.doc[now], at[todo]
            less, more = x < d, x > d
            first = less & (below[todo] < 0) & (x > low[todo])
            below[todo[first]] = now[first]
            first = more & (above[todo] < 0) & (x < high[todo])
            above[todo[first]] = now[first]
            same = ~(less | more)
            hit[todo[same]] = now[same]
            now = np.where(less, self.right[now], self.left[now])
            go = ~same & (now >= 0)
            todo, now = todo[go], now[go]
        for side, out, child, other, bound in ((-1, below, self.left, self.right, low), (1, above, self.right, self.left, high)):
            todo = np.flatnonzero((hit >= 0) & (out < 0))
            now = child[hit[todo]]
            while len(todo):  # the top of the child's part inside of the range
                todo, now = todo[now >= 0], now[now >= 0]
                inside = (self.doc[now] - bound[todo]) * side < 0
                out[todo[inside]] = now[inside]
                todo, now = todo[~inside], other[now[~inside]]
        return hit, below, above


def best(item: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each item's k best, by score and then by ``key``."""
    order = np.lexsort((key, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


class Search:
    """The k best documents so far of each item; fed with shards."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = np.ones(items, np.int64), np.full(items, _NULL)  # the k-th score and its document
        self.visited = 0

    def add(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        item, ids, score = (np.concatenate(x) for x in ((self.item, item), (self.id, ids), (self.score, score)))
        kept = best(item, ids, score, self.k)
        self.item, self.id, self.score = item[kept], ids[kept], score[kept]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.k)
        ends = np.searchsorted(self.item, full, "right") - 1
        self.least[full], self.last[full] = self.score[ends], self.id[ends]

    def shard(self, treaps: Treaps, ids: np.ndarray, item: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        """Traverse the treaps of the terms (item, term, times), sorted by item; ``ids`` are the documents' in ascending order."""
        node = treaps.roots[term]
        there = node >= 0
        item, node, times = item[there], node[there], times[there]
        new, state = np.unique(item, return_inverse=True)
        low, high, owner = np.full(len(new), -1), np.full(len(new), len(ids)), new
        while len(node):
            weight = treaps.impact[node] * times
            begins = np.flatnonzero(np.diff(state, prepend=-1))
            bound = np.add.reduceat(weight, begins)
            open_ = (bound > self.least[owner]) | (bound == self.least[owner]) & (ids[low + 1] < self.last[owner])
            keep = open_[state]
            node, times, weight, state = node[keep], times[keep], weight[keep], (np.cumsum(open_) - 1)[state[keep]]
            low, high, owner = low[open_], high[open_], owner[open_]
            if not len(node):
                break
            begins = np.flatnonzero(np.diff(state, prepend=-1))
            top = np.maximum.reduceat(weight, begins)
            strongest = np.flatnonzero(weight == top[state])
            at = treaps.doc[node[strongest[np.searchsorted(state[strongest], np.arange(len(begins)))]]]
            self.visited += len(at)
            hit, below, above = treaps.split(node, at[state], low[state], high[state])
            score = np.add.reduceat(np.where(hit >= 0, treaps.impact[hit] * times, 0), begins)
            self.add(owner, ids[at], score)
            # left parts are even states, right parts odd ones
            nodes, two = np.stack((below, above), 1).reshape(-1), np.stack((state * 2, state * 2 + 1), 1).reshape(-1)
            times = np.repeat(times, 2)
            low, high, owner = np.stack((low, at), 1).reshape(-1), np.stack((at, high), 1).reshape(-1), np.repeat(owner, 2)
            there = nodes >= 0
            order = np.argsort(two[there], kind="stable")
            node, times, two = nodes[there][order], times[there][order], two[there][order]
            used, state = np.unique(two, return_inverse=True)
            low, high, owner = low[used], high[used], owner[used]


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, np.ndarray]:
    words = tk.Words(data, offsets, tk.NOT_ALNUM)
    return words, words.hashes(lower=True)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each item and term: item, hash, times."""
    for batch in batches:
        for row, _, data, offsets in tk.by_document(batch):
            words, hashes = _terms(data, offsets)
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            for d in np.flatnonzero(words.counts).tolist():
                own, times = np.unique(hashes[words.first[d] : words.first[d + 1]], return_counts=True)
                item = batch.column(0)[row + d].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own.view(np.int64)), pa.array(times)], ["item", "hash", "times"])
            del doc


def _found(shared):
    """doc_id, terms in the document, and which of the items' terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        mask = np.uint64((1 << FILTER_BITS) - 1)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[(known & mask).astype(np.int64)] = True
        for batch in batches:
            for row, to, data, offsets in tk.by_document(batch):
                words, hashes = _terms(data, offsets)
                at = np.flatnonzero(maybe[(hashes & mask).astype(np.int64)])
                term = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                at, term = at[(same := known[term] == hashes[at])], term[same]
                doc = np.searchsorted(words.first, at, "right") - 1
                pair, tf = np.unique(doc * len(known) + term, return_counts=True)
                cuts = np.searchsorted(pair, np.arange(to - row + 1) * len(known))
                term, tf = (pair % len(known)).astype(np.int32), tf.astype(np.int64)
                held = np.flatnonzero(words.counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row + held)), pa.array(words.counts[held].astype(np.int64)), pa.array((cuts[held + 1] - cuts[held]).astype(np.int32)),
                    *[pa.array([x[cuts[d] : cuts[d + 1]].tobytes() for d in held.tolist()], pa.binary()) for x in (term, tf)],
                ], ["doc_id", "n", "size", "terms", "tfs"])

    return run


def _frequencies(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return run


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The m of documents with n terms, exact at any size."""
    if int(n.max(initial=0)) * 75 * docs >= 1 << 63:
        n = n.astype(object)
    return (25 + 75 * n * docs // terms).astype(np.int64)


def _searched(shared, docs: int, total: int, k: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, times, w = shared.value
        search = Search(int(item.max(initial=-1)) + 1, k)
        groups = [(a, b) for a, b in zip(*[np.searchsorted(item, np.arange(x, len(search.least) + x, GROUP_ITEMS)) for x in (0, GROUP_ITEMS)]) if b > a]
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64)
            ends, a = np.cumsum(sizes), 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + shard_postings, "right")))
                ids = batch.column(0).slice(a, b - a).cast(pa.int64()).fill_null(_NULL).to_numpy()
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                doc = np.repeat(place, sizes[a:b])
                own, tf = (np.frombuffer(b"".join(batch.column(c).slice(a, b - a).to_pylist()), t) for c, t in ((3, np.int32), (4, np.int64)))
                m = np.repeat(lengths(batch.column(1).slice(a, b - a).to_numpy(), docs, total), sizes[a:b])
                impact = w[own] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                by = np.lexsort((doc, own))
                treaps = Treaps(own[by], doc[by], impact[by], len(w))
                for x, y in groups:
                    search.shard(treaps, ids[order], item[x:y], term[x:y], times[x:y])
                a = b
        yield pa.RecordBatch.from_arrays([pa.array(search.item), pa.array(search.id, mask=search.id == _NULL), pa.array(search.score)], ["item", "doc_id", "score"])

    return run


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    numbered = store.written(spark, items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    asked = store.written(spark, numbered.filter(F.col("text").isNotNull()).select("item", "text").mapInArrow(_asked, "item bigint, hash bigint, times bigint"), "asked")
    rows = asked.agg(F.count_distinct("item")).first()[0]
    blocks = -(-rows // block_items)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))))
    found = []
    for block in range(blocks):
        mine = asked.filter(F.col("block") == block).select("item", "hash", "times").toArrow()  # the terms of some block_items items
        if not mine.num_rows:
            continue
        names, item = np.unique(mine["item"].to_numpy(), return_inverse=True)
        known, term = np.unique(mine["hash"].to_numpy().view(np.uint64), return_inverse=True)
        postings = docs.select("doc_id", "text").mapInArrow(_found(spark.sparkContext.broadcast(known)), "doc_id bigint, n bigint, size int, terms binary, tfs binary")
        postings = store.written(spark, postings, "postings")
        n, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        for r in postings.select("terms").mapInArrow(_frequencies(len(known)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
            df[r["term"]] = r["df"]
        order = np.argsort(item, kind="stable")
        shared = spark.sparkContext.broadcast((item[order], term[order], mine["times"].to_numpy()[order], weights(df, n)))
        best_ = postings.mapInArrow(_searched(shared, n, total, k, shard_postings), "item bigint, doc_id bigint, score bigint")
        name = spark.createDataFrame([(i, int(x)) for i, x in enumerate(names)], "item bigint, row bigint")
        found.append(best_.join(F.broadcast(name), "item").select("row", "doc_id", "score"))  # a row an item of the block
    if not found:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    together = found[0]
    for other in found[1:]:
        together = together.unionByName(other)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    together = together.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return together.join(numbered.select(F.col("item").alias("row"), "item_id"), "row").select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: The same in DuckDB SQL over the tables documents and benchmark.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark WHERE text IS NOT NULL),
size AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
held AS (SELECT uid, doc_id, len, term, count(*)::BIGINT AS tf FROM (SELECT uid, doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, size GROUP BY term, n),
s AS (
  SELECT item, item_id, uid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len * n) // l))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN w USING (term), size GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {K}"""
