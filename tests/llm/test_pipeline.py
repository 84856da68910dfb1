import hashlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from rosterloom.llm import decontaminate, toxicity
from tests.llm import test_neardup, test_packing, test_substring

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        rows = [(i, r["text"]) for i, r in before.items()]
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{SF}/labels.parquet"), toxicity.fold(F.col("doc_id"), 5) != 0)
            assert set(after) == {i for i, t in rows if model.score(np.frombuffer((t or "").encode(), "u1")) < 0.5}
        if name == "near_duplicates":
            assert set(after) == survivors(rows, 80)
        if name == "substring_dedup":
            assert set(after) == set(before)
            for i, n_words, n_removed, sha in test_substring.brute(rows, 50):
                text = after[i]["text"]
                assert (text == before[i]["text"]) == (n_removed == 0)
                assert after[i]["n_chars"] == len(text or "") or n_removed == 0
                if n_removed:
                    assert hashlib.sha256(text.encode()).hexdigest() == sha
        if name == "decontamination":
            found = decontaminate.leaks(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert set(after) == set(before) - {r["doc_id"] for r in found.collect()}
        kept.append(len(after))
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = {i: len(x) for (i, _), x in zip(texts, test_packing.brute([t for _, t in texts]))}
    got = {}
    for r in pieces:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_is_the_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def survivors(rows, percent):
    """The least doc_id of each group of documents that links of ``percent`` hold together."""
    sets, least = {i: test_neardup.shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                least[max(p, q)] = min(p, q)
    return {i for i in sets if root(i) == i}


def test_near_duplicates_are_taken_from_80_percent(spark):
    rows = test_neardup.corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = survivors(rows, 80)
    assert want < survivors(rows, 85)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_clashing_and_missing_columns(spark):
    passage = " ".join(f"p{k}" for k in range(90))
    rows = [(1, passage + " one two three four five six", 1, "a", 2, "b"), (2, " ".join(f"q{k}" for k in range(200)) + " " + passage, 1, "a", 2, "b")]
    rows += [(None, "clean text without anything", 1, None, None, "b"), (4, None, None, "a", 2, "b"), (5, "", 1, "a", 2, "b")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words int, _a string, component_id int, row string")
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            assert stage(spark, docs, SF).count() >= 4
            break
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "n_words", "_a", "component_id", "row"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[2] == " ".join(f"q{k}" for k in range(200)) and texts[1].startswith(passage)
