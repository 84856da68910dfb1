import math
import random
from collections import Counter

import numpy as np

from rosterloom.llm import toxicity

DOCS, LABELS = "doc_id long, text string, toxic int, score string", "doc_id long, toxic int, text string"


def made(n, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"word{k}" for k in range(40)], ["snarkle", "grumpf"]
    docs, labels = [], []
    for k in range(n):
        toxic = int(rng.random() < 0.25)
        words = rng.choices(plain, k=rng.randrange(20, 80)) + rng.choices(bad, k=4 * toxic)
        rng.shuffle(words)
        docs.append((k, " ".join(words), 1 - toxic, "clash"))
        labels.append((k, toxic, "clash"))
    return docs, labels


def test_held_out_and_odd_rows(spark):
    docs, labels = made(700)
    odd = [(2000, None, 0, ""), (2001, "", 0, ""), (None, "grumpf snarkle grumpf snarkle word1", 0, ""), (2002, "word3 " * 60000, 0, ""), (2003, "a", 0, "")]
    out = toxicity.judge(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + [(2001, None, ""), (None, 1, ""), (9999, 1, "")], LABELS)).collect()
    assert len(out) == len(docs) + len(odd)
    want = {k: y for k, y, _ in labels}
    held = [r for r in out if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == want[r["doc_id"]] for r in held if r["doc_id"] in want) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[None]["predicted"] == 1 and not by[None]["held_out"] and by[2000]["score"] == by[2001]["score"] == by[2003]["score"]


def test_clean_keeps_columns(spark):
    docs, labels = made(500, 2)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    kept = toxicity.clean(d, l)
    assert kept.columns == d.columns
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.judge(d, l).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, p in predicted.items() if not p}


def test_held_out_labels_are_not_read(spark):
    docs, labels = made(300, 5)
    import zlib

    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y, t) for k, y, t in labels]
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert one == two


def test_no_labels_and_no_rows(spark):
    docs, _ = made(10)
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in toxicity.judge(spark.createDataFrame(docs, DOCS), none).collect()} == {0}
    assert toxicity.judge(spark.createDataFrame([], DOCS), none).count() == 0


def test_long_texts_are_trained_on_whole(spark):
    rng = random.Random(4)
    plain, docs, labels = [f"word{k}" for k in range(40)], [], []
    for k in range(160):
        words, toxic = rng.choices(plain, k=900), k % 2
        for at in (120, 150, 180, 450, 480, 750, 780):  # outside of pieces from the start, the thirds and the end
            words[at] = "snarkle" if toxic else words[at]
        docs.append((k, " ".join(words), 0, "clash"))
        labels.append((k, toxic, "clash"))
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert {r["doc_id"]: r["text"] for r in toxicity.sample(d, l, toxicity.F.lit(True)).collect()} == {r[0]: r[1] for r in docs}
    out = [r for r in toxicity.judge(d, l).collect() if r["held_out"]]
    assert len(out) > 20 and all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_against_a_plain_version():
    docs, labels = made(120, 8)
    texts, marks = [d[1].upper() + " É" for d in docs], [y for _, y, _ in labels]
    model = toxicity.train(texts, marks)

    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return [(n, low[k : k + n]) for n in toxicity.SIZES for k in range(len(low) - n + 1)]

    def bucket(n, gram):
        h = n
        for c in gram:
            h = (h * 0x9E3779B1 + ord(c)) % 2**32
        for shift, odd in ((15, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * odd % 2**32
        return h >> 32 - toxicity.BITS

    own = [Counter(bucket(*g) for g in grams(t)) for t in texts]
    counts = [Counter(b for o, y in zip(own, marks) if y == label for b in o) for label in (0, 1)]
    share, root = sum(marks) / len(marks), sum(marks) ** 0.5
    for b in set(counts[0]) | set(counts[1]):
        p, q = counts[1][b], counts[0][b]
        want = math.log((p + 2 * root * share) / sum(marks)) - math.log((q + 2 * root * (1 - share)) / (len(marks) - sum(marks)))
        assert abs(model.ratio[b] - (want if p + q >= 0.6 * root and abs(want) >= 0.7 else 0)) < 1e-5
    assert sum(model.ratio != 0) > 20
    for text, o in list(zip(texts, own))[:30]:
        length = sum((float(model.ratio[b]) * math.log(1 + n)) ** 2 for b, n in o.items()) ** 0.5 or 1.0
        z = model.bias + sum(float(model.ratio[b]) * math.log(1 + n) * float(model.weight[b]) for b, n in o.items()) / length
        assert abs(model.score(np.frombuffer(text.encode(), np.uint8)) - 1 / (1 + math.exp(-z))) < 1e-4


def test_labels_that_differ_are_not_used(spark):
    docs = spark.createDataFrame([(1, "a", 0, ""), (2, "b", 0, "")], DOCS)
    labels = spark.createDataFrame([(1, 0, ""), (1, 1, ""), (2, 1, ""), (2, 1, "")], LABELS)
    assert [(r["doc_id"], r["toxic"]) for r in toxicity.sample(docs, labels, toxicity.F.lit(True)).collect()] == [(2, 1)]


def test_held_out_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.judge(told.select("doc_id", "text"), labels).filter("held_out").collect()}
    want = {r["doc_id"]: r["toxic"] for r in told.select("doc_id", "toxic").collect() if r["doc_id"] in out}
    found = sum(out[i] for i, y in want.items() if y == 1)
    assert found >= 0.9 * sum(want.values()) and sum(out.values()) - found <= 0.01 * len(want)
