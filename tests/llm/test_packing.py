import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, length int, ids string"


def brute(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check(rows, texts):
    want = dict(enumerate(brute(texts)))
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, ids in want.items():
        pieces = sorted(by_doc[doc])
        assert [p[0] for p in pieces] == np.cumsum([0, *[len(p[1]) for p in pieces]])[:-1].tolist()
        assert [x for p in pieces for x in p[1]] == ids
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding


def test_every_id_in_one_piece(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert check(packing.pack(docs, PATH).collect(), texts) == 0


def test_odd_texts(spark):
    texts = ["", None, "don't STOP'S 12½ ²x Ⅷ", "été İstanbul ΣΑΣ", "<|startoftext|> a", "a b c\x1cd\x85e", "日本語 text 🎉", "word " * 9000, "x" * 30000, "ß Œuvre — “quoted”"]
    rows = [(k, t, 1, "clash") for k, t in enumerate(texts)]
    assert check(packing.pack(spark.createDataFrame(rows, DOCS).coalesce(1), PATH).collect(), texts) == 0


def test_special_tokens_are_the_tokenizers():
    words, tokenizer = packing.load(PATH), Tokenizer.from_file(PATH)
    for text in ("a <|endoftext|> b", "<|STARTOFTEXT|>", "<|endoftext|><|endoftext|>x", "<| endoftext |>", "a<|endoftext|", "<|"):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert 49407 in tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_empty_table_and_repeats(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b", 0, ""), (1, "a b", 0, ""), (1, "a b", 0, "")], DOCS).coalesce(1), PATH).collect()
    assert sum(r["length"] for r in rows) == 9


def test_differencing_balances():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1000, 300).tolist()
    parts = packing.difference(sizes, 20)
    assert sum(s for s, _ in parts) == sum(sizes)
    assert sorted(k for _, t in parts for k in packing._leaves(t)) == list(range(300))
    assert max(s for s, _ in parts) - min(s for s, _ in parts) < 60


def test_crc_in_the_query(spark):
    piece = packing.pack(spark.createDataFrame([(7, "hello world", 0, "")], DOCS), PATH).select("ids", F.crc32("ids").alias("c")).collect()
    assert all(zlib.crc32(r["ids"]) == r["c"] for r in piece)
