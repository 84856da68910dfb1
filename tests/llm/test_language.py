import random

import numpy as np
from pyspark.sql import functions as F

from rosterloom.llm import language

DOCS = "doc_id long, text string, lang string, score int"
WORDS = {"aa": "the of and house tree water going".split(), "bb": "schön über straße nicht und das mädchen".split(), "cc": "дом вода и не на улица".split()}


def made(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS[lang], k=rng.randrange(5, 150))), lang, 0) for k in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = made(600) + [(1000, None, "aa", 0), (1001, "123 !? \n", "bb", 0), (1002, "", "cc", 0), (None, "the house of water and the tree", None, 0), (1003, "über das mädchen " * 3000, None, 0)]
    out = language.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    want = {r[0]: r[2] for r in rows[:600]}
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 100 and sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.98 * len(held)
    odd = {r["doc_id"]: r for r in out}
    assert [(odd[k]["lang_pred"], odd[k]["score"]) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert odd[None]["lang_pred"] == "aa" and odd[1003]["lang_pred"] == "bb" and not odd[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out)


def test_no_labels_one_label_no_rows(spark):
    assert {r["lang_pred"] for r in language.judge(spark.createDataFrame([(k, "text", None, 0) for k in range(9)], DOCS)).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.judge(spark.createDataFrame([(k, "text", "aa", 0) for k in range(9)], DOCS)).collect()} == {"aa"}
    assert language.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_labels_are_no_input(spark):
    rows = made(300, 3)
    df = spark.createDataFrame(rows, DOCS)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = df.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    one, two = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.judge(x).collect()} for x in (df, other))
    assert one == two


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(k, f"text of {k % 230}", f"l{k % 230}", 0) for k in range(690)] + [(1000 + k, f"more of it {k}", "l0", 0) for k in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r["lang"] for r in language.sample(df, F.lit(True)).collect()} == {f"l{k}" for k in range(230)}
    monkeypatch.setattr(language, "MOST_TEXTS", 230)
    few = language.sample(df, F.lit(True)).collect()
    assert {r["lang"] for r in few} == {f"l{k}" for k in range(230)} and len(few) <= 2 * 230


def test_predictions_against_a_plain_convolution(spark):
    rows = made(90, 4) + [(500, "The house " * 80 + "é", None, 0), (501, "x", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    model = language.fit(df, F.lit(True))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    for i, text, *_ in rows[::9] + rows[-2:]:
        data, total = text.encode(), np.zeros(len(model.languages))
        for a in range(0, len(data), language.WINDOW):
            window = data[a : a + language.WINDOW]
            padded = window.ljust(language.WINDOW)
            pooled = [max(sum(f[k][padded[p + k]][c] for k in range(w)) for p in range(language.WINDOW - w + 1)) for w, f in zip(language.WIDTHS, model.filters) for c in range(language.FILTERS)]
            z = np.maximum(np.array(pooled) + model.offset, 0) @ model.out + model.out_offset
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(window) / len(data)
        assert got[i]["lang_pred"] == model.languages[int(total.argmax())] and abs(got[i]["score"] - total.max()) < 1e-4
