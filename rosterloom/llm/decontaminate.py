"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, marks and numbers of any script, A-Z lower-cased, so case and punctuation
don't hide a passage; in scripts that put no spaces between words each character is a token. A seed is a fixed mask over consecutive tokens: the tokens at its
care positions are hashed, those at the others are ignored, so a substituted token leaves the seeds
that ignore it or stand beside it. Seed hashes of the test items are joined with those of the
training documents; a hit puts item and document on one diagonal, and the overlap on that diagonal is
verified token by token: the best ungapped segment around the hit, in which at least ``IDENTITY`` of
the tokens agree. It is a leak if it has ``MATCHED`` agreeing tokens, or if it covers ``COVERED`` of a
shorter item.

The documents are scanned once, whatever the size of the test set. The scan hashes every position
under every mask and keeps those whose hash a bit table of the test seeds holds: at most ``MOST_BITS``
bits are broadcast, a larger test set only lets more positions through. Documents with a position
left are written with their token hashes; the join of positions and seeds, and that of the hits with
the tokens of both sides, are Spark's own, on tables that are written before, so small ones are
broadcast by their known size and hot ones can be split. Texts are never shuffled.

Cases: null and empty texts match nothing, nor do items without a token. An item of fewer than ``SHORTEST`` tokens is too short for differences:
it is found where all its tokens stand, and if it is no more than a word or two (fewer than ``FEW`` tokens, or ``FEW_BYTES`` bytes of them), which any text may have by chance,
where a document is that item and nothing else. Items of fewer than ``SPACED`` tokens have seeds of their own in place of
the masks: cut into two more blocks than tokens may differ, they keep some two blocks whole in each
passage that is accepted, and each two blocks are a seed; repeated items are reported each, repeated documents too; a null doc_id is carried as it is;
ids may have any type; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm import store
from rosterloom.llm import textkernel as tk

#: 1: the token counts, 0: it is ignored; with WHOLE before it, the mask is for documents of just its length.
WHOLE = "="
MASKS = ("11101100101", "110100110011", "101100011101", "111001101101")
IDENTITY = 0.75
MATCHED = 12
COVERED = 0.8
SHORTEST = 5
FEW, FEW_BYTES = 3, 10
#: From this length on, each passage that is accepted holds a seed of a mask; tests walk over all of them, at any length.
SPACED = 14
#: The bit table has some 64 bits for each test seed, and no more bits than two to this power (64 MB).
MOST_BITS = 29
PROBES = 8


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, np.ndarray]:
    words = tk.Words(data, offsets, marks=tk.character_marks(data))
    return words, words.hashes(lower=True)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash under a mask at each position where it fits into ``hashes``, documents run together."""
    cares = mask.removeprefix(WHOLE)
    n = len(hashes) - len(cares) + 1
    out = np.full(max(n, 0), int(cares, 2) + (len(mask) - len(cares) << 32), np.uint64)
    for k, care in enumerate(cares):
        if care == "1" and n > 0:
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return tk.mix(out)


def needed(length: int) -> int:
    """The agreeing tokens that make a leak of an item of this length."""
    return min(MATCHED, max(min(SHORTEST, length), int(np.ceil(COVERED * length))))


def short_seeds(length: int) -> list[tuple[str, int]]:
    """Masks and their places in an item of this length, of which every passage with the ``needed`` tokens holds one."""
    cuts = np.linspace(0, length, length - needed(length) + 3).round().astype(int).tolist()
    out = []
    for (a, b), (c, d) in combinations(list(zip(cuts, cuts[1:])), 2):
        out.append(("1" * (b - a) + "0" * (c - b) + "1" * (d - c), a))
    return out


def masks_of(length: int, whole: bool = False) -> list[tuple[str, int | None]]:
    """The masks of an item of this length, each with its only place, or None for every place; ``whole``: it has to be a document's whole text."""
    if length < SHORTEST:
        return [(WHOLE * whole + "1" * length, 0)]
    return [(mask, None) for mask in MASKS] if length >= SPACED else short_seeds(length)


def item_seeds(own: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The seed hashes of an item's tokens and the places where they begin."""
    hashes, places = [], []
    for mask, place in masks_of(len(own), whole):
        got = seeds(own if place is None else own[place : place + len(mask.removeprefix(WHOLE))], mask)
        hashes.append(got), places.append(np.arange(len(got)) + (place or 0))
    return np.concatenate(hashes), np.concatenate(places)


class Bits:
    """A Bloom filter of seed hashes: some 64 bits a seed and eight probes, so one position in ten million slips through."""

    def __init__(self, seeds_in_all: int):
        self.width = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(seeds_in_all, 1) * 64)))))
        self.table = np.zeros(1 << (self.width - 3), np.uint8)

    @classmethod
    def of(cls, width: int) -> Bits:
        """An empty one of a width."""
        out = cls(1)
        out.width, out.table = width, np.zeros(1 << (width - 3), np.uint8)
        return out

    def probe(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Probe k of each hash: low bits of the hash, then of the hash mixed with a salt."""
        return ((tk.mix(hashes + np.uint64(k)) if k else hashes) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for k in range(PROBES):
            at = self.probe(hashes, k)
            np.bitwise_or.at(self.table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The positions whose hash the filter holds; each probe looks at those that the one before it left."""
        left = np.arange(len(hashes))
        for k in range(PROBES):
            at = self.probe(hashes[left], k)
            left = left[(self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return left


def segment(same: np.ndarray) -> tuple[int, int]:
    """The segment with the best score, where a difference costs what keeps agreement at ``IDENTITY``."""
    score = np.where(same, 1.0, -IDENTITY / (1 - IDENTITY))
    total = np.concatenate(([0.0], np.cumsum(score)))
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    return int(np.argmin(total[: end + 1])), end


def verify(own: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start in the document, tokens, agreeing tokens) of a leak on a diagonal, or None."""
    lo, hi = max(0, -diagonal), min(len(item), len(own) - diagonal)
    same = own[lo + diagonal : hi + diagonal] == item[lo:hi]
    a, b = segment(same)
    agreed = int(same[a:b].sum())
    if agreed >= needed(len(item)):
        return lo + diagonal + a, b - a, agreed
    return None


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, own, whole = [], [], []
        for _, _, data, offsets in tk.by_document(batch):
            words, hashes = tokens(data, offsets)
            for a, b in zip(words.first[:-1], words.first[1:]):
                n.append(int(b - a)), own.append(hashes[a:b].tobytes())
                whole.append(bool(b - a < SHORTEST and (b - a < FEW or (words.end[a:b] - words.start[a:b]).sum() < FEW_BYTES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(own, pa.binary()), pa.array(whole, pa.bool_())], ["item", "item_id", "n", "own", "whole"])


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, own, whole in zip(*(batch.column(k) for k in range(3))):
            hashes, places = item_seeds(np.frombuffer(own.as_buffer(), np.uint64), whole.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), item.as_py())), pa.array(places.astype(np.int32))], ["seed", "item", "place"])


def _bits(seeded: DataFrame) -> Bits:
    """The bit table of all seeds: each task sets the bits of its seeds, and the pieces of their tables are joined by place."""
    bits = Bits(seeded.count())
    size = min(len(bits.table), 1 << 16)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Bits.of(bits.width)
        for batch in batches:
            mine.add(np.unique(batch.column(0).to_numpy()).view(np.uint64))
        pieces = mine.table.reshape(-1, size)
        at = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([pieces[k].tobytes() for k in at], pa.binary())], ["piece", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[piece] = held.get(piece, 0) | np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["piece", "bits"])

    for row in seeded.select("seed").mapInArrow(own, "piece bigint, bits binary").repartition("piece").mapInArrow(joined, "piece bigint, bits binary").collect():  # the table itself, 64 MB at most
        bits.table[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _scan(shared, masks: list[str]):
    """doc_id, token hashes and the positions left, of each document that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys, owns, found, places = [], [], [], []
            for row, _, data, offsets in tk.by_document(batch):
                words, hashes = tokens(data, offsets)
                hits = []
                for mask in masks:
                    here = seeds(hashes, mask)
                    at = bits.find(here)
                    doc = np.searchsorted(words.first, at, "right") - 1
                    length = len(mask.removeprefix(WHOLE))
                    inside = at + length <= words.first[doc + 1]
                    if mask.startswith(WHOLE):
                        inside &= words.counts[doc] == length
                    hits.append((doc[inside], here[at[inside]].view(np.int64), (at[inside] - words.first[doc[inside]]).astype(np.int32)))
                docs, here, at = (np.concatenate([h[k] for h in hits]) for k in range(3))
                for doc in np.unique(docs).tolist():
                    keys.append(row + doc), owns.append(hashes[words.first[doc] : words.first[doc + 1]].tobytes())
                    found.append(here[docs == doc]), places.append(at[docs == doc])
            if keys:
                columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(owns, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "seeds", "places"])

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best verified segment of each document and item, if there is one."""
    names = ["doc_id", "item_id", "start", "n_tokens", "n_agreeing"]
    for batch in batches:
        keep, rest = [], []
        for k, (doc, item, diagonals) in enumerate(zip(batch.column(2), batch.column(3), batch.column(4))):
            text, test = np.frombuffer(doc.as_buffer(), np.uint64), np.frombuffer(item.as_buffer(), np.uint64)
            best = None
            for diagonal in sorted(diagonals.as_py()):
                got = verify(text, test, diagonal)
                if got and (best is None or got[2] > best[2]):
                    best = got
            if best:
                keep.append(k), rest.append(best)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array([r[k] for r in rest], pa.int64()) for k in range(3)]], names)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, and the best segment's start
    (in tokens), n_tokens and n_agreeing."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    tests = benchmark.filter(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    items = store.written(spark, tests.mapInArrow(_read_items, f"item bigint, item_id {item_type}, n int, own binary, whole boolean").filter("n > 0"), "items")
    seeded = store.written(spark, items.select("item", "own", "whole").mapInArrow(_seeded, "seed bigint, item bigint, place int"), "seeds")
    lengths = [tuple(r) for r in items.select(F.least("n", F.lit(SPACED)), "whole").distinct().collect()]  # some twenty at most
    masks = sorted({mask for n, whole in lengths for mask, _ in masks_of(n, whole)})
    if not masks:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, start bigint, n_tokens bigint, n_agreeing bigint")
    shared = spark.sparkContext.broadcast(_bits(seeded))
    scanned = docs.select("doc_id", "text").mapInArrow(_scan(shared, masks), f"doc_id {id_type}, tokens binary, seeds array<bigint>, places array<int>")
    scanned = store.written(spark, scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    hits = scanned.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("row", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    met = hits.join(seeded, "seed").groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    met = store.written(spark, met, "met")
    both = met.join(items.select("item", "item_id", "own"), "item").join(scanned.select("row", "doc_id", "tokens"), "row")
    return both.select("doc_id", "item_id", "tokens", "own", "diagonals").mapInArrow(_checked, f"doc_id {id_type}, item_id {item_type}, start bigint, n_tokens bigint, n_agreeing bigint")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document holds no test item; a null doc_id stays only if its own text is clean."""
    found = leaks(docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text"), benchmark)
    bad = found.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.t").alias("_t")).distinct()
    bad = store.written(docs.sparkSession, bad, "leaks")  # of known size, so a small one is broadcast
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")
