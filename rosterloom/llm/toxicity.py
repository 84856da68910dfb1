"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 5 and 7 characters of a text with A-Z lower-cased, hashed into ``BUCKETS``
buckets. A text's vector has log(1 + count) in each bucket, times the bucket's log-count ratio
log((p / P) / (q / Q)), where p and q count the toxic and the other labelled texts that have the bucket, both
smoothed by ``SMOOTH`` times the root of P texts in the classes' own shares, and P and Q all of them. Buckets of fewer
texts than ``RARE`` times that root, and those whose ratio is below ``WEAK``, get no weight: they name single texts, or say
little, and without them so many features can't learn the sample by heart. The vector is scaled to length one. On it a
logistic regression is trained by full gradient
steps until its loss settles, in one task, with a somewhat larger weight for toxic texts, over at most ``MOST_ROWS`` labelled
texts: those with the smallest seeded hash of their id, so the sample doesn't depend on how the tables are
cut. Training and scoring take whole texts; the rows alone bound what the training task holds, some 12 bytes for
each distinct n-gram of each text.

Scoring needs one pass and no shuffle: the model is broadcast (``BUCKETS`` numbers), and each text is
summed in numpy. Its memory is bounded by a slice of texts.

Cases: null and empty texts have no feature and score by the bias alone; a null or repeated doc_id is
scored as any other row; labels that are null, or whose document is missing, and labels of one doc_id that differ are not used; without
both labels in training every score is the share of label 1 (0 without any label); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm import textkernel as tk

BITS = 19
BUCKETS = 1 << BITS
SIZES = (5, 7)
SMOOTH = 2.0
RARE = 0.6
WEAK = 0.7
#: The bound of the labelled sample that is gathered and trained on.
MOST_ROWS = 4_000
SEED = 77
STEPS = 100
SETTLED = 2e-3
RATE = 0.5
DECAY = 1e-5
#: Texts whose gradient is summed at a time, which bounds the task's memory.
BLOCK = 512
#: The loss of a toxic text counts as (others / toxic) to this power: a few toxic texts among many still teach.
BALANCE = 0.5


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def letters(data: np.ndarray) -> np.ndarray:
    """The characters of UTF-8 bytes, A-Z lower-cased."""
    found = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    found[(found >= 65) & (found <= 90)] += np.uint32(32)
    return found


def buckets(low: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each n-gram of characters."""
    size = len(low) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x9E3779B1)
        h += low[k : k + size]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BITS)


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of one text and log(1 + count) of each."""
    low = letters(data)
    found = np.sort(np.concatenate([buckets(low, n) for n in SIZES]))
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    return found[first].astype(np.int64), np.log1p(np.diff(np.append(first, len(found)))).astype(np.float32)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.scaled = (self.ratio * self.weight).astype(np.float32)
        self.square = (self.ratio * self.ratio).astype(np.float32)

    def score(self, data: np.ndarray) -> float:
        at, value = features(data)
        length = float(np.dot(self.square[at], value * value)) ** 0.5 or 1.0
        z = self.bias + float(np.dot(self.scaled[at], value)) / length
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def ratios(toxic: np.ndarray, others: np.ndarray, n_toxic: int, n_others: int) -> np.ndarray:
    """Log-count ratios from the numbers of toxic and other texts that have each bucket."""
    share, smooth = n_toxic / (n_toxic + n_others), SMOOTH * n_toxic**0.5
    out = np.log((toxic + smooth * share) / n_toxic) - np.log((others + smooth * (1 - share)) / n_others)
    out[(toxic + others < RARE * n_toxic**0.5) | (np.abs(out) < WEAK)] = 0
    return out.astype(np.float32)


def train(texts: list[str], labels: list[int]) -> Model:
    """A model of the given texts; see the module's text for what it is."""
    y = np.array(labels, np.float64)
    zero = np.zeros(BUCKETS, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(zero, zero, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    blocks, counted = [], np.zeros((2, BUCKETS))
    for k in range(0, len(texts), BLOCK):
        data, offsets = tk.column_bytes(pa.array(texts[k : k + BLOCK], pa.string()))
        parts = [(at.astype(np.int32), value) for at, value in (features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:]))]
        for (own, _), label in zip(parts, y[k : k + BLOCK]):
            counted[int(label)][own] += 1
        blocks.append((y[k : k + BLOCK], parts))
    ratio = ratios(counted[1], counted[0], int(y.sum()), int((1 - y).sum()))
    for k, (own, parts) in enumerate(blocks):
        parts = [(at[keep], value[keep]) for at, value in parts for keep in [ratio[at] != 0]]
        doc, at = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p, _ in parts]), np.concatenate([p for p, _ in parts])
        value = ratio[at] * np.concatenate([v for _, v in parts])
        length = np.bincount(doc, value * value, len(parts)) ** 0.5
        blocks[k] = (own, doc, at, value / np.where(length > 0, length, 1)[doc].astype(np.float32))
    heavy = ((1 - y.mean()) / y.mean()) ** BALANCE
    weight, bias = np.zeros(BUCKETS, np.float32), float(np.log(heavy * y.mean() / (1 - y.mean())))
    seen, seen_bias, before = np.full(BUCKETS, 1e-8), 1e-8, np.inf
    for _ in range(STEPS):
        slope, slope_bias, loss = DECAY * weight.astype(np.float64), 0.0, DECAY / 2 * float(np.dot(weight, weight))
        for own, doc, at, value in blocks:
            z = np.clip(np.bincount(doc, value * weight[at], len(own)) + bias, -60, 60)
            mass = np.where(own == 1, heavy, 1) / len(y)
            loss += float(np.dot(mass, np.log1p(np.exp(np.where(own == 1, -z, z)))))
            error = (1 / (1 + np.exp(-z)) - own) * mass
            slope += np.bincount(at, value * error.astype(np.float32)[doc], BUCKETS)
            slope_bias += float(error.sum())
        if 0 <= before - loss < SETTLED * loss:
            break
        before = loss
        seen += slope * slope
        weight -= (RATE * slope / np.sqrt(seen)).astype(np.float32)
        seen_bias += slope_bias**2
        bias -= RATE * slope_bias / seen_bias**0.5
    return Model(ratio, weight, bias)


def sample(docs: DataFrame, labels: DataFrame, train_on: Column, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, toxic and text of at most ``most`` labelled texts, those with the least seeded hash of doc_id; ``train_on`` is a
    condition on doc_id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(train_on & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").drop("_most")
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    chosen = known.withColumn("_o", order).orderBy("_o", "doc_id").limit(most).drop("_o")
    # ids in the sample are bounded, so they may be broadcast; a repeated doc_id gives one text
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, most: int = MOST_ROWS) -> Model:
    """A model trained in one task, over the bounded sample, so the driver holds nothing but the model."""
    rows = sample(docs, labels, train_on, most).select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            marks += batch.column(2).to_pylist()
        if texts:
            m = train(texts, marks)
            yield pa.RecordBatch.from_arrays([pa.array([m.ratio.tobytes()], pa.binary()), pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias])], ["ratio", "weight", "bias"])

    made = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "ratio binary, weight binary, bias double").collect()
    if not made:
        return train([], [])
    return Model(np.frombuffer(made[0]["ratio"], np.float32), np.frombuffer(made[0]["weight"], np.float32), made[0]["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = tk.column_bytes(batch.column(1))
            scores = [m.score(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted; fold 0 is never learned from."""
    scored = score(docs, fit(docs, labels, fold(F.col("doc_id"), folds) != 0))
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't take for toxic, with their columns as they are."""
    model = fit(docs, labels, fold(F.col("doc_id"), folds) != 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(next((c for c in docs.columns if c == "text"), None) or next(c for c in docs.columns if c.lower() == "text"))  # as Spark resolves it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = tk.column_bytes(batch.column(at))
            yield batch.filter(pa.array([m.score(data[a:b]) < 0.5 for a, b in zip(offsets[:-1], offsets[1:])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
