"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes (the last one padded with spaces). Filters of several
widths run over a window's bytes: a filter has one weight for each byte value at each of its places,
so its response is a sum of table look-ups. The largest response of each filter in the window, cut
off below zero, goes into a softmax layer. The network is trained in numpy with Adam on windows of
labelled texts; only the places of the largest responses get gradients. A text's probabilities are
the mean of its windows', weighted by their real bytes: the whole text is read, never a part.

Every lang value is learned. Training texts are at most about ``PER_LANGUAGE`` a language, fewer where the
languages are so many that this would be over ``MOST_TEXTS`` in all, but never none: they are chosen by a seeded
hash of doc_id against a share counted for each language, which the language's least hash is always within. All
windows of these texts are learned from, in one task; the bound on texts is the bound on what it holds. The model (some
hundred KB) is all that the driver gets; it is broadcast, scoring is one pass without a shuffle, and a worker's memory is
bounded by a slice of windows.

Cases: null texts and texts without a letter are ``und`` with score 0; null or repeated doc_ids are
predicted like others; a row with a null doc_id is neither held out nor learned from, one with a null lang never learned from;
without any labelled row all texts are ``und``; with one language all are that language; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm import textkernel as tk

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: The bounds of the labelled sample that is trained on.
PER_LANGUAGE = 300
MOST_TEXTS = 20_000
SEED = 5
EPOCHS = 8
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
#: Windows whose responses are held at a time.
AT_ONCE = 64


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # by width w: (w, 256, FILTERS)
    offset: np.ndarray
    out: np.ndarray  # (filters of all widths, languages)
    out_offset: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Each width's weights as tables over pairs of bytes (and one byte, if the width is odd)."""
        made = []
        for f in self.filters:
            own, w = [], len(f)
            for k in range(0, w - 1, 2):
                own.append((k, (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1)))
            if w % 2:
                own.append((w - 1, f[w - 1]))
            made.append(own)
        return made

    def probabilities(self, windows: np.ndarray, tables: list | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), AT_ONCE):
            x = windows[a : a + AT_ONCE]
            pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            pooled = []
            for w, own in zip(WIDTHS, tables):
                n, total = WINDOW - w + 1, None
                for k, t in own:
                    got = t[pairs[:, k : k + n]] if len(t) > 256 else t[x[:, k : k + n]]
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(1))
            h = np.maximum(np.concatenate(pooled, 1) + self.offset, 0)
            z = h @ self.out + self.out_offset
            z = np.exp(z - z.max(1, keepdims=True))
            out[a : a + AT_ONCE] = z / z.sum(1, keepdims=True)
        return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts, the text of each, and its real bytes."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][doc] + k * WINDOW
    real = np.minimum(WINDOW, offsets[1:][doc] - start)
    padded = np.concatenate((data, np.full(WINDOW, 32, np.uint8)))
    windows = padded[start[:, None] + np.arange(WINDOW)]
    windows[np.arange(WINDOW) >= real[:, None]] = 32
    return windows, doc, real


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Model:
    """A network trained on the windows of the texts, each language with the same weight."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = Model(languages, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return model
    windows, doc, real = cut(*tk.column_bytes(pa.array(texts, pa.string())))
    y = np.searchsorted(languages, labels)[doc]
    share = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))).astype(np.float32)
    params = [*model.filters, model.offset, model.out, model.out_offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            x, t = windows[at].copy(), y[at]
            short = np.where(rng.random(len(at)) < 0.4, rng.integers(12, WINDOW, len(at)), WINDOW)  # texts may be short
            x[np.arange(WINDOW) >= short[:, None]] = 32
            pooled, places = [], []
            for w, f in zip(WIDTHS, model.filters):
                n = WINDOW - w + 1
                total = sum(f[k][x[:, k : k + n]] for k in range(w))
                p = total.argmax(1)
                places.append(p), pooled.append(np.take_along_axis(total, p[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, 1) + model.offset
            r = np.maximum(h, 0)
            z = r @ model.out + model.out_offset
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(at)), t] -= 1
            z *= share[t][:, None] / len(at)
            back = (z @ model.out.T) * (h > 0)
            slopes = []
            for j, (w, f, p) in enumerate(zip(WIDTHS, model.filters, places)):
                g = np.zeros_like(f)
                own = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(x, p + k, 1), np.broadcast_to(np.arange(FILTERS), p.shape)), own)
                slopes.append(g)
            slopes += [back.sum(0), r.T @ z, z.sum(0)]
            step += 1
            for p, g, m, v in zip(params, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def sample(docs: DataFrame, train_on: Column, per_language: int = PER_LANGUAGE) -> DataFrame | None:
    """doc_id, lang and text of the labelled texts to learn from; None if there are none."""
    known = docs.select("doc_id", "text", "lang").filter(train_on & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    mark = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 31))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min(mark).alias("least")).collect()}  # a row a language
    if not sizes:
        return None
    per_language = max(1, min(per_language, MOST_TEXTS // len(sizes)))
    bars = [(lang, max(int(min(1.0, per_language / n) * (1 << 31)), least + 1)) for lang, (n, least) in sizes.items()]
    bars = F.broadcast(docs.sparkSession.createDataFrame(bars, "_lang string, bar bigint"))
    rows = known.join(bars, F.col("lang") == F.col("_lang")).filter(mark < F.col("bar")).select("doc_id", "lang", "text")
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "text").limit(per_language * 2 * len(sizes))


def fit(docs: DataFrame, train_on: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model trained in one task over the bounded sample."""
    rows = sample(docs, train_on, per_language)
    if rows is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels))], pa.binary())], ["model"])

    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id"), F.col("text")]
    made = rows.repartition(1).sortWithinPartitions(*order).select("text", "lang").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = m.tables() if m else None
        for batch in batches:
            n = len(batch)
            named, scores = np.full(n, UNKNOWN, object), np.zeros(n)
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if m:
                for a, b, data, offsets in tk.by_document(batch):
                    windows, doc, real = cut(data, offsets)
                    if not len(windows):
                        continue
                    p = m.probabilities(windows, tables) * real[:, None]
                    total = np.stack([np.bincount(doc, c, b - a) for c in p.T], 1) / np.maximum(np.diff(offsets), 1)[:, None]
                    ok = np.flatnonzero(lettered[a:b])
                    best = total[ok].argmax(1)
                    named[a + ok] = np.array(m.languages, object)[best]
                    scores[a + ok] = np.clip(total[ok, best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select("doc_id", "text", lettered).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def judge(docs: DataFrame, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred and score; fold 1 is never learned from."""
    model = fit(docs, fold(F.col("doc_id"), folds) != 1)
    held = F.coalesce(fold(F.col("doc_id"), folds) == 1, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
