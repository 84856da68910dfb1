import random
import re

import numpy as np
import pytest

from rosterloom.llm import neardup
from rosterloom.llm import textkernel as tk
from rosterloom.llm.components import components

DOCS = "doc_id long, text string, component_id int, n string"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 85 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    out = []
    for i, x in sets:
        if i is None:
            same = [root(j) for j, y in sets if j is not None and x and y == x]
            out.append((None, len(x), min(same, default=None), False))
        else:
            out.append((i, len(x), root(i), root(i) == i))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], DOCS)
    return sorted([tuple(r) for r in neardup.classes(spark, df).collect()], key=str)


def family(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"c{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 400))]
        texts.append(base)
        for _ in range(rng.randrange(12)):
            texts.append(family(rng, rng.choice([base, texts[-1]]), rng.randrange(len(base) // 25 + 1)))
    hot = [word() for _ in range(300)]
    texts += [family(rng, hot, rng.randrange(14)) for _ in range(120)]
    texts += [hot] * 30 + [[word() for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    rng.shuffle(texts)
    return [(k, " ".join(x.upper() if rng.random() < 0.1 else x for x in t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed, cluster", [(1, 1024), (2, 16)])
def test_against_brute_force(spark, seed, cluster, monkeypatch):
    monkeypatch.setattr(neardup, "CLUSTER", cluster)
    rows = corpus(seed)
    want = brute(rows)
    assert got(spark, rows) == want
    assert 20 < sum(r[3] for r in want) < len(rows) - 50


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "alone here"), (None, None), (8, "x " * 40000), (9, "x " * 30), (-3, "a B c d e")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_repeated_id_links_its_texts(spark):
    rows = [(5, "one two three four five six"), (5, "seven eight nine ten eleven"), (2, "one two three four five six"), (9, "seven eight nine ten eleven")]
    assert {r[0]: r[2] for r in got(spark, rows)} == {5: 2, 2: 2, 9: 2}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85, 0.95):
        found = []
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, 1500).astype(np.uint64))
            both = int(len(x) * share)
            only = (len(x) - both) // 2
            a, b = x[: both + only], np.concatenate((x[:both], x[both + only :]))
            p, q = neardup.registers(a), neardup.registers(b)
            assert (neardup.merged(p, q) == neardup.registers(x)).all()
            found.append(neardup.estimate(np.array([(p > q).sum()]), np.array([(p < q).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0])
        assert abs(np.mean(found) - share) < 0.04


def test_components_of_chains(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5001), (5001, 5000), (6, 6)]
    rng.shuffle(edges)
    out = {r["id"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)} | {5000: 5000, 5001: 5000}
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_short_and_empty_shingle_sets():
    import pyarrow as pa

    data, offsets = tk.column_bytes(pa.array(["a b", "", "a b c d e", "a b c d e f"]))
    assert [len(s) for s in neardup.shingle_sets(data, offsets)] == [1, 0, 1, 2]


def test_miss_bound_at_each_threshold():
    assert neardup.width(85) == neardup.REGISTERS
    for percent in (70, 80, 85, 95):
        assert (1 - (percent / 100) ** neardup.BAND) ** (neardup.width(percent) // neardup.BAND) < neardup.MISS


def test_clean_keeps_one_row_of_each_class(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, near), (7, text), (7, text), (None, text), (3, near), (None, "alone here"), (None, "alone here"), (None, "more alone"), (None, None), (4, ""), (5, "five"), (5, "six")]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], DOCS)
    kept = neardup.clean(spark, df)
    assert kept.columns == df.columns
    want = [(3, near), (None, "alone here"), (None, "more alone"), (None, None), (4, ""), (5, "five"), (5, "six")]
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted(want, key=str)


def test_two_steps_tell_whether_an_estimate_reaches_a_threshold():
    rng = np.random.default_rng(5)
    for count in (80, 108):
        more = rng.integers(0, count // 2 + 1, 40_000)
        less, n_a, n_b = rng.integers(0, count - more + 1), rng.integers(1, 3_000, 40_000).astype(float), rng.integers(1, 3_000, 40_000).astype(float)
        n_b[::2] = np.maximum(n_a[::2] + rng.integers(-20, 20, 20_000), 1)
        for least in (0.55, 0.6, 0.9):
            want = np.concatenate([neardup.estimate(*(x[k : k + 4_000] for x in (more, less, n_a, n_b)), count) for k in range(0, 40_000, 4_000)]) >= least
            assert 100 < want.sum() < 39_000 and (neardup.reaches(least, more, less, n_a, n_b, count) == want).all()
