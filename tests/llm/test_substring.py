import hashlib
import random
import re

import numpy as np
import pytest

from rosterloom.llm import substring

DOCS = "doc_id long, text string, n_removed int, a string"


def brute(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, split):
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - length + 1):
                if least[tuple(w[k : k + length])] < i:
                    gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], DOCS)
    done = substring.dedup(spark, df, **options)
    assert done.columns == ["doc_id", "text", "a", "n_words", "n_removed", "kept_text"]
    return sorted([tuple(r) for r in substring.summary(done).collect()], key=str)


def corpus(seed, length, docs=120, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randrange(length - 3, 3 * length)) for _ in range(6)]
    texts = []
    for _ in range(docs):
        parts = [rng.choices(words, k=rng.randrange(0, 2 * length)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - length))
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randrange(length - 2, 2 * length)])
        text = [x for p in parts for x in p]
        if texts and rng.random() < 0.3:
            text = list(rng.choice(texts))
            for _ in range(rng.randrange(3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(text)
    glue = [" ", "  ", "\n", "\t ", " \r\n"]
    return [(k, rng.choice(glue).join(t) + rng.choice(["", " "])) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed, group", [(1, 20_000), (2, 1), (3, 4)])
def test_against_brute_force(spark, seed, group):
    rows = corpus(seed, 50)
    rng = random.Random(seed)
    rng.shuffle(rows)
    want = brute(rows, 50)
    assert got(spark, rows, group_runs=group) == want
    assert sum(r[2] for r in want) > 1000


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(60))
    rows = [(5, long), (3, long), (3, long), (7, long + " é 日本"), (None, long), (None, None), (1, None), (2, ""), (4, " \n "), (6, "same " * 20000), (8, "same " * 300), (9, "a b"), (9, long), (-4, "b " * 49)]
    assert got(spark, rows) == brute(rows, 50)
    assert got(spark, []) == []
    assert got(spark, [(1, "a b")]) == brute([(1, "a b")], 50)


def test_columns_of_any_name_and_repeated_rows(spark):
    long = " ".join(f"x{k}" for k in range(400))
    rows = [(1, long, 9, "a", 8, "w")] * 3 + [(2, long + " end", 9, "a", 8, "w")] * 400 + [(3, "short", 9, "a", None, "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words int, _a string, ua int, row string")
    out = substring.clean(spark, df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, [*df.filter("doc_id <> 2").collect(), *df.filter("doc_id = 2").selectExpr("doc_id", "'end' AS text", "n_words", "_a", "ua", "row").collect()]))


def test_one_passage_in_many_documents(spark):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(70)]
    rows = [(k, " ".join([f"a{rng.randrange(10**6)}" for _ in range(30)] + passage + [f"b{rng.randrange(10**6)}" for _ in range(30)])) for k in range(300)]
    assert got(spark, rows, group_runs=20) == brute(rows, 50)


def test_short_windows(spark):
    rows = corpus(9, 6, docs=60, vocabulary=30)
    assert got(spark, rows, length=6, prefix=2) == brute(rows, 6)


def test_tree_depths():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 120).astype(np.uint64)
    first = np.array([0, 50, 90, 120])
    tree = substring.SuffixTree(words, first, np.arange(120))
    end = np.repeat(first[1:], np.diff(first))
    suffix = [words[k : end[k]].tolist() for k in range(120)]
    assert [suffix[k] for k in tree.order] == sorted(suffix)
    for depth, a, b in zip(tree.depth, tree.order, tree.order[1:]):
        same = 0
        while same < min(len(suffix[a]), len(suffix[b])) and suffix[a][same] == suffix[b][same]:
            same += 1
        assert depth == same
