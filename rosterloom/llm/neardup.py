"""Near-duplicate documents by SetSketch registers, banding and exact verification.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set has its distinct shingles of
``SHINGLE`` words (all words as one shingle, if fewer). Sets are linked if 100 * intersection is at least
percent * union: ``PERCENT`` in ``classes`` if none is given, ``STAGE_PERCENT`` in ``clean``. Documents with equal sets are one node from the start, however many they are.

A sketch has ``width(percent)`` registers, ``REGISTERS`` at least: each hashes every shingle to an exponential value with rate
``RATE``, keeps the minimum and stores floor(1 - log_BASE(minimum)), cut to 0..``TOP``. Registers of a
union are the maxima of its parts' registers, and two sets have equal registers about as often as
their similarity says. Sketches are cut into bands of ``BAND`` registers; equal bands are a bucket. A
pair at the threshold misses all its buckets with a probability below ``MISS``: 20 bands do at 85, 27 at 80.

A bucket never becomes pairs. Its smallest node is its hub, each other node is verified against the
hub on the full sets, and the difference of the two sets is kept. The verified links give components.
Where the nodes that met under a hub still lie in several components, the links between those are
looked for among all of them, exactly: in blocks of at most ``CLUSTER`` nodes, first by the sketches (the
similarity that maximises the joint likelihood of the registers that are larger, smaller and equal; a pair far
below the threshold is left), then on the full sets, whose symmetric difference is that of their
differences to the hub. Links within a component are not looked for: they change nothing.

Sizes: the sketch table has some 200 bytes a document; sets are made and shuffled only for nodes that
share a bucket. A node's work grows with its buckets, not with their sizes. The driver holds counts.

Cases: null and empty texts, and texts of white space, have an empty set and are linked with nothing; in
``classes`` a null doc_id takes the component of its equal set (null if there is none) and is not kept, and rows
that repeat a doc_id are one document, linked with whatever one of its texts is linked with; ``clean`` takes
each row for itself; very long
texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import store
from rosterloom.llm import textkernel as tk
from rosterloom.llm.components import components

SHINGLE = 5
PERCENT = 85
#: What the stages of a pipeline take for near.
STAGE_PERCENT = 80
REGISTERS = 80
BAND = 4
MISS = 1e-6
BASE = 1.001
RATE = 20.0
TOP = 65534
#: Below the threshold by this much (some six standard deviations), an estimate rules a pair out.
MARGIN = 0.25
CLUSTER = 1024

_U = np.uint64


def width(percent: int) -> int:
    """The registers whose bands a pair at the threshold misses with a probability below ``MISS``."""
    bands = int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** BAND)))) if percent < 100 else 1
    return max(REGISTERS, BAND * bands)


@lru_cache
def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    return tk.mix(np.arange(count, dtype=_U) + _U(11)) | _U(1), tk.mix(np.arange(count, dtype=_U) + _U(7001))


def registers(shingles: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """The sketch of a set of distinct 64-bit shingle hashes, which must not be empty."""
    least = np.full(count, np.iinfo(_U).max, _U)
    a, b = _hashers(count)
    for k in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[k : k + 1024, None] * a + b).min(0), out=least)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def _log_share(x: np.ndarray) -> np.ndarray:
    """The probability that a register is larger, for a share x of the union that is in one set only."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """Jaccard similarities that maximise the joint likelihood, from the counts of registers (of ``count``) that
    are larger and smaller in a than in b and the sizes of the sets (arrays of one length)."""
    u = n_a / (n_a + n_b)
    j = _GRID * _most(u)[:, None]
    return np.take_along_axis(j, _likelihood(j, u[:, None], more[:, None], less[:, None], count).argmax(1)[:, None], 1)[:, 0]


def _most(u: np.ndarray) -> np.ndarray:
    return np.minimum(u / (1 - u), (1 - u) / u)


def _likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, count: int) -> np.ndarray:
    p, q = _log_share(u - (1 - u) * j), _log_share((1 - u) - u * j)
    tiny = 1e-12
    same = count - more - less
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))


def reaches(least: float, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """Whether ``estimate`` is at least ``least``. The likelihood is concave in the similarity, so two steps of the grid
    tell on which side of ``least`` its maximum lies."""
    u = n_a / (n_a + n_b)
    fits = _GRID * _most(u)[:, None] >= least
    at = np.where(fits.any(1), fits.argmax(1), len(_GRID))
    out = at == 0
    k = np.flatnonzero((at > 0) & (at < len(_GRID)))
    j = _GRID[at[k, None] + np.array([-1, 0])] * _most(u[k])[:, None]
    f = _likelihood(j, u[k, None], more[k, None], less[k, None], count)
    out[k] = f[:, 1] > f[:, 0]
    return out


def linked(inter: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * inter >= percent * (n_a + n_b - inter)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = tk.Words(data, offsets)
    h = words.hashes(lower=True)
    grams = tk.ngrams(h, SHINGLE) if len(h) else h
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield tk.ngrams(h[a:b], b - a)[:1] + _U(b - a)
        else:
            yield np.zeros(0, _U)


def _name(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return int(tk.mix(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)), int(tk.mix(own + _U(0x14057B7EF767814F)).sum(dtype=_U).view(np.int64))


def _sketched(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, sketch = [], [], [], []
        for _, _, data, offsets in tk.by_document(batch):
            for own in shingle_sets(data, offsets):
                a, b = _name(own)
                n.append(len(own)), one.append(a), two.append(b)
                sketch.append(registers(own, count).tobytes() if len(own) else None)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketch, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "sketch"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of documents, as bytes."""
    for batch in batches:
        for a, b, data, offsets in tk.by_document(batch):
            sets = list(shingle_sets(data, offsets))
            columns = [batch.column(0).slice(a, b - a), pa.array([_name(x)[0] for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "s1", "own"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub, its set, node, its set -> the intersection's size and the symmetric difference."""
    for batch in batches:
        inter, delta = [], []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
            apart = np.setxor1d(x, y, assume_unique=True)
            inter.append((len(x) + len(y) - len(apart)) // 2), delta.append(apart.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(delta, pa.binary())], ["hub", "id", "inter", "delta"])


def _cross(table: pa.Table, percent: int) -> pa.Table:
    """Links between components among the nodes of one block (role 0) and one chunk (role 1)."""
    ids, comps, n = (table[c].to_numpy() for c in ("id", "component", "n"))
    role = table["role"].to_numpy()
    sketch = np.stack([np.frombuffer(x.as_buffer(), "<u2") for x in table["sketch"]]) if table.num_rows else np.zeros((0, width(percent)), "<u2")
    delta = [np.frombuffer(x.as_buffer(), _U) for x in table["delta"]]
    block, chunk = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for k in chunk.tolist():
        others = block[(comps[block] != comps[k]) & (100 * np.minimum(n[block], n[k]) >= percent * np.maximum(n[block], n[k]))]
        if not len(others):
            continue
        more, less = (sketch[k] > sketch[others]).sum(1), (sketch[k] < sketch[others]).sum(1)
        close = reaches(percent / 100 - MARGIN, more, less, np.full(len(others), float(n[k])), n[others].astype(float), sketch.shape[1])
        others, more, less = others[close], more[close], less[close]
        likely = estimate(more, less, np.full(len(others), float(n[k])), n[others].astype(float), sketch.shape[1])
        for o in others[np.argsort(-likely, kind="stable")].tolist():
            a, b = root(int(comps[k])), root(int(comps[o]))
            if a == b:
                continue
            apart = len(np.setxor1d(delta[k], delta[o], assume_unique=True))
            if linked((n[k] + n[o] - apart) // 2, n[k], n[o], percent):
                out.append((int(ids[k]), int(ids[o])))
                parent[max(a, b)] = min(a, b)
    return pa.table([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], ["u", "v"])


def _residual(spark: SparkSession, pairs: DataFrame, nodes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links between the components of nodes that met under one hub."""
    comp = known.select(F.col("id").alias("_c"), "component")
    hubs = store.written(spark, pairs.select("hub", "hub_s1").distinct(), "met_hubs")
    mains = hubs.join(comp, hubs["hub"] == comp["_c"], "left").select("hub", "hub_s1", F.coalesce("component", "hub").alias("main"))
    mains = store.written(spark, mains, "mains")
    others = pairs.select("hub", "hub_s1", "id", "id_s1").join(comp, F.col("id") == F.col("_c"), "left").withColumn("component", F.coalesce("component", "id")).drop("_c")
    # every aggregate is written before it is joined: hubs are hot keys
    apart = others.join(mains, ["hub", "hub_s1"]).withColumn("minor", F.col("component") != F.col("main"))
    apart = store.written(spark, apart, "apart")
    sizes = apart.groupBy("hub", "hub_s1").agg((F.count("*") + 1).alias("members"), F.count_if("minor").alias("minors")).filter("minors > 0")
    sizes = sizes.select("hub", "hub_s1", F.ceil(F.col("members") / CLUSTER).cast("int").alias("blocks"), F.ceil(F.col("minors") / CLUSTER).cast("int").alias("chunks"))
    sizes = store.written(spark, sizes, "sizes")
    own = apart.drop("main").join(sizes, ["hub", "hub_s1"])
    deltas = pairs.select("hub", "hub_s1", "id", "id_s1", "delta").toDF("_h", "_s", "_i", "_t", "delta")
    own = own.join(deltas, (F.col("hub") == F.col("_h")) & (F.col("hub_s1") == F.col("_s")) & (F.col("id") == F.col("_i")) & (F.col("id_s1") == F.col("_t"))).drop("_h", "_s", "_i", "_t")
    self = mains.join(sizes, ["hub", "hub_s1"]).select("hub", "hub_s1", F.col("hub").alias("id"), F.col("hub_s1").alias("id_s1"), F.col("main").alias("component"), F.lit(False).alias("minor"), "blocks", "chunks", F.lit(b"").alias("delta"))
    met = own.unionByName(self)
    met = met.join(nodes.select(F.col("rep").alias("_r"), F.col("s1").alias("_t"), "n", "sketch"), (F.col("id") == F.col("_r")) & (F.col("id_s1") == F.col("_t"))).drop("_r", "_t")
    rows = ["hub", "hub_s1", "block", "chunk", "role", "id", "component", "n", "sketch", "delta"]
    mine = lambda parts: F.pmod(F.xxhash64("id", "id_s1"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    blocks = met.withColumn("block", mine("blocks")).withColumn("chunk", every("chunks")).withColumn("role", F.lit(0))
    chunks = met.filter("minor").withColumn("chunk", mine("chunks")).withColumn("block", every("blocks")).withColumn("role", F.lit(1))
    return blocks.select(rows).unionByName(chunks.select(rows)).groupBy("hub", "hub_s1", "block", "chunk").applyInArrow(lambda table: _cross(table, percent), "u bigint, v bigint")


def classes(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    count = width(percent)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketched = store.written(spark, texts.mapInArrow(lambda batches: _sketched(batches, count), "doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch binary"), "sketches")
    nodes = sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"))
    nodes = store.written(spark, nodes, "nodes")
    band = F.array(*[F.xxhash64(F.lit(k), F.substr("sketch", F.lit(1 + 2 * BAND * k), F.lit(2 * BAND))) for k in range(count // BAND)])
    bands = nodes.select("rep", "s1", F.explode(band).alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min(F.struct("rep", "s1")).alias("h"), F.count("*").alias("m")).filter("m > 1").select(F.col("bucket").alias("_b"), F.col("h.rep").alias("hub"), F.col("h.s1").alias("hub_s1"))
    hubs = store.written(spark, hubs, "hubs")  # written before it is joined, so that a hot bucket can be split
    again = bands.toDF(*bands.columns)
    met = again.join(hubs, F.col("bucket") == F.col("_b")).filter("rep <> hub OR s1 <> hub_s1")
    met = store.written(spark, met.select("hub", "hub_s1", F.col("rep").alias("id"), F.col("s1").alias("id_s1")).distinct(), "met")
    wanted = met.select("id", "id_s1").unionByName(met.select("hub", "hub_s1").distinct().toDF("id", "id_s1")).distinct().toDF("_id", "_s1")
    wanted = store.written(spark, wanted, "wanted")
    ids = store.written(spark, wanted.select("_id").distinct(), "ids")
    listed = texts.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(_listed, "id bigint, s1 bigint, own binary")
    listed = listed.join(wanted, (F.col("id") == F.col("_id")) & (F.col("s1") == F.col("_s1")), "left_semi").dropDuplicates(["id", "s1"])
    listed = store.written(spark, listed, "sets")
    left, right = listed.toDF("_i", "_s", "own"), listed.toDF("_h", "_t", "hubs")
    pairs = met.join(left, (F.col("id") == F.col("_i")) & (F.col("id_s1") == F.col("_s"))).join(right, (F.col("hub") == F.col("_h")) & (F.col("hub_s1") == F.col("_t")))
    packed = pairs.select(F.struct("hub", "hub_s1").alias("hub"), F.struct("id", "id_s1").alias("id"), "hubs", "own")
    kinds = "hub struct<hub:bigint,hub_s1:bigint>, id struct<id:bigint,id_s1:bigint>, inter bigint, delta binary"
    pairs = packed.mapInArrow(_verified, kinds).select("hub.hub", "hub.hub_s1", "id.id", "id.id_s1", "inter", "delta")
    pairs = store.written(spark, pairs, "pairs")
    sizes = nodes.select("rep", "s1", "n")
    sized = pairs.drop("delta").join(sizes.toDF("_i", "_s", "n_id"), (F.col("id") == F.col("_i")) & (F.col("id_s1") == F.col("_s"))).join(sizes.toDF("_h", "_t", "n_hub"), (F.col("hub") == F.col("_h")) & (F.col("hub_s1") == F.col("_t")))
    links = sized.filter(100 * F.col("inter") >= percent * (F.col("n_id") + F.col("n_hub") - F.col("inter"))).select(F.col("hub").alias("u"), F.col("id").alias("v"))
    # rows that repeat a doc_id with several sets are one document: it links the nodes of these sets
    filled = sketched.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "s1", "s2", "n")
    repeated = filled.distinct().groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("doc_id").alias("_d"))
    several = filled.join(repeated, F.col("doc_id") == F.col("_d"), "left_semi").join(nodes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).filter("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    links = store.written(spark, links.unionByName(several).distinct(), "links0")
    known = components(spark, links)
    more = store.written(spark, _residual(spark, pairs, nodes, known, percent), "residual")
    if not more.isEmpty():
        known = components(spark, links.unionByName(more))
    least = sketched.select("doc_id", "n", "s1", "s2").join(nodes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left")
    done = least.join(known, F.col("rep") == F.col("id"), "left")
    component = F.coalesce("component", F.col("rep"), F.col("doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def clean(spark: SparkSession, docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of ``docs`` of which each class keeps one: the row with the least doc_id, nulls last. Here every row
    is a document of its own, whether its doc_id is null or repeated."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = store.written(spark, packed, "rows")  # written, so that a row keeps its number
    found = classes(spark, rows.select(F.col("number").alias("doc_id"), "row.text"), percent).select(F.col("doc_id").alias("number"), "component_id")
    members = rows.select("number", F.col("row.doc_id").cast("bigint").alias("id")).join(found, "number")
    members = store.written(spark, members, "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("m")).select(F.col("m.number").alias("number"))
    out = store.written(spark, members.join(first, "number", "left_anti").select("number"), "out")
    return rows.join(out, "number", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same in DuckDB SQL over the table documents: all pairs that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), n AS (
  SELECT doc_id, len(sh)::BIGINT AS n FROM g
), u AS (
  SELECT doc_id, unnest(sh) AS s FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b
)
SELECT n.doc_id, n AS n_shingles, min(m) AS component_id, n.doc_id = min(m) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n"""
