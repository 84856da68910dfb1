"""Exact top-k search by inner product with a KD-tree for each shard.

Vectors count as integers floor(scale * x); they are held as they are and scaled where they are compared. A coarse KD-tree, median splits of a bounded sample
(``SAMPLE_VALUES`` numbers), deals all rows into cells; each cell's tight box is taken from all its
rows, and a cell with more than ``shard_rows`` rows is cut into shards by a hash of the row, so equal
vectors, however many, spread. Queries are rows of the same table. A box bounds the inner product of a
query with everything in it by the sum of the larger of q * low and q * high. Each query goes to the cell
with the best bound first; the k-th score found there is propagated, and only cells whose bound is
not below it get the query in the second pass: the other pairs are dropped before anything is shuffled.

A task gets one shard and a block of at most about ``block_queries`` queries: it builds the shard's KD-tree by
median splits along the widest side, with tight bounding boxes, and answers each query best-first:
boxes are opened in the order of their bounds, and the search ends where the best bound left is
below the k-th score. The results of the shards are merged by query.

Memory is bounded by both sizes; a shard is copied only for the blocks that ask for it. The driver
gathers the sample and the cells' boxes, ``MOST_CELLS`` at most for each length of vectors. Results are exact: no candidate is
skipped unless its box cannot hold a better one. Scores and bounds are computed in doubles where every sum is
below 2 ** 53, otherwise in whole numbers of any size; the k-th score is handed on as a whole number.

Cases: a vector that is null, or holds a null or non-finite component, and a row with a null id take
no part; vectors of different lengths are never compared; ties go to the smaller id, then to the
earlier row; rows that repeat an id are rows of their own, each a candidate of the other; scores are whole numbers of any size
until the result, which holds them to the range of a long in their true order; with fewer than k candidates all are returned; a query without candidates has no rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rosterloom.llm import store

SCALE = 256
K = 5
#: The numbers of a shard's vectors and of a block's queries, from which their rows follow.
SHARD_VALUES = 1 << 20
BLOCK_VALUES = 1 << 18
SAMPLE_VALUES = 1 << 20
MOST_CELLS = 1024
LEAF = 128
SEED = 31
_LONG = (1 << 63) - 1


class Tree:
    """A KD-tree over the rows of a matrix: nodes are ranges of a permutation of the rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        self.ranges, self.children, lows, highs = [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = rows[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            me = len(self.ranges)
            self.ranges.append((a, b)), self.children.append([]), lows.append(low), highs.append(high)
            if parent >= 0:
                self.children[parent].append(me)
            side = high - low
            if b - a > leaf and side.size and side.max() > 0:
                axis, half = int(np.argmax(side)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], half)]
                todo += [(a, a + half, me), (a + half, b, me)]
        self.low, self.high = np.array(lows), np.array(highs)
        self.rows = rows[self.order]

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, uids: np.ndarray, own: int, least: float | int) -> list[tuple]:
        """The k best (score, -id, -uid) of rows other than ``own``, in any order; rows below
        ``least`` may be missing."""
        bound = np.maximum(q * self.low, q * self.high).sum(1)
        best: list[tuple] = []  # a heap, the worst first
        open_, kth = [(-bound[0], 0)], least
        while open_ and -open_[0][0] >= kth:
            _, node = heapq.heappop(open_)
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= kth:
                        heapq.heappush(open_, (-bound[child], child))
                continue
            a, b = self.ranges[node]
            scores = self.rows[a:b] @ q
            near = np.flatnonzero(scores >= kth)
            if len(near) > 4 * k:  # of many candidates with the least score only those with small ids count
                near = near[np.lexsort((uids[self.order[a + near]], ids[self.order[a + near]], -scores[near]))[: k + 1]]
            for at in near.tolist():
                row = self.order[a + at]
                if uids[row] == own:
                    continue
                entry = (scores[at], -int(ids[row]), -int(uids[row]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the lists, and their numbers run together."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _scaled(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) as doubles, or if ``wide`` as whole numbers of any size."""
    if not wide:
        return np.floor(x * scale)
    one = lambda v: int(np.floor(v * scale)) if abs(v) * scale < 1 << 53 else int(v) * scale + int(np.floor((v % 1) * scale)) if v % 1 else int(v) * scale
    return np.array([one(v) for v in x.reshape(-1).tolist()], object).reshape(x.shape)


def _exact(x: np.ndarray, y: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Both scaled: as doubles if every sum of products of their numbers is exact in doubles, else as whole numbers of any size."""
    top = lambda m: int(np.abs(m).max(initial=0)) * scale + scale
    wide = top(x) * top(y) * max(x.shape[1], 1) >= 1 << 53
    return _scaled(x, scale, wide), _scaled(y, scale, wide)


def _key(score: int) -> bytes:
    """Bytes that are in the order of whole numbers of any size."""
    size = abs(score).to_bytes(-(-abs(score).bit_length() // 8) or 1)
    own = len(size).to_bytes(2) + size
    return b"\1" + own if score >= 0 else b"\0" + bytes(255 - b for b in own)


def _score(key: bytes) -> int:
    if key[:1] == b"\1":
        return int.from_bytes(key[3:])
    return -int.from_bytes(bytes(255 - b for b in key[3:]))


def split(rows: np.ndarray, cells: int, first: int) -> tuple:
    """A coarse tree: (axis, threshold, below, not below) or the number of a cell, at most ``cells`` from ``first`` on."""
    if cells > 1 and len(rows) > 1:
        axis = int(np.argmax(rows.max(0) / 2 - rows.min(0) / 2)) if rows.shape[1] else -1
        values = np.sort(rows[:, axis]) if axis >= 0 else np.zeros(1)
        at = values[len(values) // 2]
        if at == values[0]:
            more = values[values > at]
            at = more[0] if len(more) else None
        if at is not None and axis >= 0:
            low = rows[:, axis] < at
            return axis, float(at), split(rows[low], cells // 2, first), split(rows[~low], cells - cells // 2, first + cells // 2)
    return (first,)


def place(tree: tuple, rows: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write the cell of each row ``at`` into ``out``."""
    if len(tree) == 1:
        out[at] = tree[0]
        return
    axis, threshold, below, rest = tree
    low = rows[at, axis] < threshold
    place(below, rows, at[low], out)
    place(rest, rows, at[~low], out)


def _dealt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            sizes, flat = _matrix(batch.column(1))
            starts, cell = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                got = np.zeros(len(own), np.int32)
                place(trees[size], flat[starts[own][:, None] + np.arange(size)], np.arange(len(own)), got)
                cell[own] = got
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "uid", "cell"])

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The box of each cell's rows in this task."""
    held: dict[int, list] = {}
    for batch in batches:
        sizes, flat = _matrix(batch.column(1))
        starts, cell = np.cumsum(sizes) - sizes, batch.column(0).to_numpy()
        for c in np.unique(cell).tolist():
            own = np.flatnonzero(cell == c)
            rows = flat[starts[own][:, None] + np.arange(sizes[own[0]])]
            n, low, high = held.get(c, (0, rows[0], rows[0]))
            held[c] = [n + len(own), np.minimum(low, rows.min(0)), np.maximum(high, rows.max(0))]
    lists = [pa.array([x[k] for x in held.values()], pa.list_(pa.float64())) for k in (1, 2)]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), *lists], ["cell", "n", "low", "high"])


def _joined_boxes(table: pa.Table) -> pa.Table:
    low, high = (np.stack(table[c].to_pylist()).astype(np.float64) if table.num_rows else None for c in ("low", "high"))
    return pa.table({"cell": table["cell"][:1], "n": [sum(table["n"].to_pylist())], "low": pa.array([low.min(0)], pa.list_(pa.float64())), "high": pa.array([high.max(0)], pa.list_(pa.float64()))})


def _routed(shared, home: bool, scale: int):
    """Queries with the shards they go to: the one with the best bound, or all but that one whose bound isn't below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = _matrix(batch.column(2))
            starts = np.cumsum(sizes) - sizes
            uids, least = batch.column(0).to_numpy(), [None if k is None else _score(k) for k in batch.column(3).to_pylist()]
            cut = (uids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            row, cell, piece = [], [], []
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                cells, low, high, pieces = shared.value[size]
                q = flat[starts[own][:, None] + np.arange(size)]
                x, both = _exact(q, np.concatenate((low, high)), scale)
                low, high = both[: len(low)], both[len(low) :]
                bounds = np.stack([np.maximum(x * a, x * b).sum(1) for a, b in zip(low, high)], 1)
                for r, b in zip(own.tolist(), bounds):
                    best = int(np.argmax(b))
                    first = (cells[best], int(cut[r]) % pieces[best])
                    goes = [first] if home else [(cells[c], p) for c in np.flatnonzero(b >= least[r] if least[r] is not None else np.ones(len(b), bool)) for p in range(pieces[c]) if (cells[c], p) != first]
                    row += [r] * len(goes)
                    cell += [c for c, _ in goes]
                    piece += [p for _, p in goes]
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(piece, pa.int32())], ["uid", "vec_id", "v", "least", "cell", "piece"])

    return run


def _searched(k: int, scale: int):
    names = ["uid", "query_id", "vec_id", "vec_uid", "key"]

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            ids, uids = vectors["vec_id"].to_numpy(), vectors["uid"].to_numpy()
            sizes, flat = _matrix(vectors["v"])
            q_ids, q_uids, least = queries["vec_id"].to_numpy(), queries["uid"].to_numpy(), [None if x is None else _score(x) for x in queries["least"].to_pylist()]
            q_sizes, q_flat = _matrix(queries["v"])
            starts, q_starts = np.cumsum(sizes) - sizes, np.cumsum(q_sizes) - q_sizes
            for size in np.unique(q_sizes).tolist():
                rows, asked = np.flatnonzero(sizes == size), np.flatnonzero(q_sizes == size)
                if not len(rows):
                    continue
                x = flat[starts[rows][:, None] + np.arange(size)]
                y = q_flat[q_starts[asked][:, None] + np.arange(size)]
                x, y = _exact(x, y, scale)
                tree = Tree(x)
                for at, q in zip(asked.tolist(), y):
                    low = -np.inf if least[at] is None else least[at]
                    for score, i, u in tree.search(q, k, ids[rows], uids[rows], q_uids[at], low):
                        out.append((int(q_uids[at]), int(q_ids[at]), -i, -u, _key(int(score))))
        return pa.table([*[pa.array([r[n] for r in out], pa.int64()) for n in range(4)], pa.array([r[4] for r in out], pa.binary())], names)

    return run


def _held_to_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [max(-_LONG - 1, min(_LONG, _score(k))) for k in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.int64())], ["query_id", "rank", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid").orderBy(F.desc("key"), "vec_id", "vec_uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cells(held: DataFrame, shard_rows: int) -> dict[int, tuple]:
    """A coarse tree for each length of vectors, from a bounded sample; cells are numbered through."""
    counts = {r["size"]: r["n"] for r in held.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, SAMPLE_VALUES / max(1, sum(size * n for size, n in counts.items())))
    chosen = held.filter(F.pmod(F.xxhash64(F.lit(SEED), "uid"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("v").toArrow()
    sizes, flat = _matrix(chosen["v"]) if chosen.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    starts, trees, first = np.cumsum(sizes) - sizes, {}, 0
    for size in sorted(counts):
        own = np.flatnonzero(sizes == size)
        cells = min(MOST_CELLS, -(-counts[size] // shard_rows))
        trees[size] = split(flat[starts[own][:, None] + np.arange(size)].reshape(len(own), size), cells, first)
        first += cells
    return trees


def search(spark: SparkSession, vectors: DataFrame, every: int, k: int = K, scale: int = SCALE, shard_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """The k best other rows for each row whose vec_id is divisible by ``every``: query_id, rank,
    vec_id, score. ``vectors`` has vec_id and embedding."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    scaled = scaled.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("v"), F.monotonically_increasing_id().alias("uid"))
    held = store.written(spark, scaled, "vectors")
    widest = held.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    shard_rows, block_queries = shard_rows or max(1, SHARD_VALUES // widest), block_queries or max(1, BLOCK_VALUES // widest)
    trees = spark.sparkContext.broadcast(_cells(held, shard_rows))
    dealt = store.written(spark, held.mapInArrow(_dealt(trees), "vec_id bigint, v array<double>, uid bigint, cell int"), "dealt")
    box = "cell int, n bigint, low array<double>, high array<double>"
    boxes = dealt.select("cell", "v").mapInArrow(_boxes, box).groupBy("cell").applyInArrow(_joined_boxes, box).orderBy("cell").collect()
    pieces = {b["cell"]: -(-b["n"] // shard_rows) for b in boxes}
    by_size: dict[int, tuple] = {}
    for size in {len(b["low"]) for b in boxes}:
        own = [b for b in boxes if len(b["low"]) == size]
        by_size[size] = ([b["cell"] for b in own], *[np.array([b[c] for b in own], np.float64).reshape(len(own), size) for c in ("low", "high")], [pieces[b["cell"]] for b in own])
    shared = spark.sparkContext.broadcast(by_size)
    cut = F.broadcast(spark.createDataFrame(list(pieces.items()), "cell int, pieces bigint"))  # a row a cell
    shards = dealt.join(cut, "cell").withColumn("piece", F.pmod(F.xxhash64("uid"), "pieces").cast("int")).drop("pieces")
    asked = dealt.filter(F.col("vec_id") % every == 0).select("uid", "vec_id", "v")
    schema = "uid bigint, query_id bigint, vec_id bigint, vec_uid bigint, key binary"
    goes = "uid bigint, vec_id bigint, v array<double>, least binary, cell int, piece int"

    def met(queries: DataFrame, home: bool) -> DataFrame:
        routed = store.written(spark, queries.mapInArrow(_routed(shared, home, scale), goes), "routed")
        blocks = routed.groupBy("cell", "piece").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
        blocks = store.written(spark, blocks, "blocks")
        each = shards.join(blocks, ["cell", "piece"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        mine = routed.join(blocks.toDF(*blocks.columns), ["cell", "piece"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "uid"), "blocks").cast("int"))
        keys = ["cell", "piece", "block"]
        return each.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInArrow(_searched(k, scale), schema)

    first = store.written(spark, met(asked.withColumn("least", F.lit(None).cast("binary")), True), "home")
    if sum(pieces.values()) > 1:
        least = first.groupBy("uid").agg(F.count("*").alias("n"), F.min("key").alias("least")).filter(F.col("n") >= k).select("uid", "least")
        first = first.unionByName(met(asked.join(least, "uid", "left"), False))
    found = _best(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "key")
    return found.mapInArrow(_held_to_longs, "query_id bigint, rank int, vec_id bigint, score bigint")


#: The same in DuckDB SQL over the table embeddings.
ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS vec_uid, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, vec_uid) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""
