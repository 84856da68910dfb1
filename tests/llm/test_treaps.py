import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rosterloom.llm import treaps

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        own = Counter(terms(text))
        scores = []
        for d, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, x in own.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **sizes):
    found = treaps.rank(spark, spark.createDataFrame([(*r, "clash") for r in docs], DOCS), spark.createDataFrame([(*r, 0) for r in items], ITEMS), **sizes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in found.collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    return [(rng.randrange(10_000), " ".join(word().upper() if rng.random() < 0.2 else word() for _ in range(rng.randrange(1, 60)))) for _ in range(n)], word


@pytest.mark.parametrize("sizes", [{}, dict(shard_postings=60), dict(block_items=3, shard_postings=500), dict(k=1)])
def test_as_brute_force(spark, sizes):
    docs, word = corpus(4, 300)
    docs = list(dict(docs).items())
    docs += [(20_000 + k, docs[0][1]) for k in range(40)]  # copies tie
    items = [(k, " ".join(word() for _ in range(1 + k))) for k in range(12)] + [(5, "w1 w1 w1 unknown")]
    assert run(spark, docs, items, **sizes) == brute(docs, items, sizes.get("k", 10))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "Straße_x, STRASSE"), (4, "Straße_x, STRASSE"), (None, "straße x"), (9, "long " * 50_000 + "x"), (-5, "漢字 x")]
    items = [(0, "straße X"), (1, None), (2, "?"), (0, "漢字"), (3, "nothing here")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 3])
    assert treaps.lengths(n, 10**10, 10**15).tolist() == [25 + 75 * 10**9 * 10**10 // 10**15, 25 + 75 * 3 * 10**10 // 10**15]


def test_treaps_have_their_orders_and_split():
    rng = np.random.default_rng(5)
    doc = np.sort(rng.choice(1000, 200, replace=False))
    t = treaps.Treaps(np.zeros(200, int), doc, rng.integers(1, 9, 200), 1)
    for i in range(200):
        for child, side in ((t.left[i], -1), (t.right[i], 1)):
            assert child < 0 or (t.impact[child] <= t.impact[i] and (t.doc[child] - t.doc[i]) * side > 0)
    for low, at, high in ((-1, 500, 1000), (100, 101, 102), (-1, int(doc[7]), int(doc[40])), (300, int(doc[100]), 900)):
        hit, below, above = (int(x[0]) for x in t.split(np.array([t.roots[0]]), np.array([at]), np.array([low]), np.array([high])))
        best = lambda a, b: max((t.impact[i] for i in range(200) if a < doc[i] < b), default=None)
        assert (hit >= 0) == (at in doc) and (None if below < 0 else t.impact[below]) == best(low, at) and (None if above < 0 else t.impact[above]) == best(at, high)


def test_pruning_leaves_most_documents_out():
    docs, _ = corpus(6, 4000)
    counts = [Counter(terms(t)) for _, t in docs]
    names = sorted({t for c in counts for t in c})
    rare = [names.index(t) for t in sorted(names, key=lambda t: sum(t in c for c in counts))[:40:8]]
    term, doc, impact = (np.array(x) for x in zip(*sorted((names.index(t), d, 1000 * n) for d, c in enumerate(counts) for t, n in c.items())))
    search = treaps.Search(1, 10)
    search.shard(treaps.Treaps(term, doc, impact, len(names)), np.arange(len(docs)), np.zeros(len(rare), int), np.array(sorted(rare)), np.ones(len(rare), int))
    assert len(search.score) == 10 and search.visited < len(docs) / 4
