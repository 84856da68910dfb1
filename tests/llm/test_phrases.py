import random
import re
from collections import Counter
from decimal import Decimal

import pytest

from rosterloom.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n int"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=100, most=5, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(most, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        held = set()
        for p, a in own.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if (i, j) != (0, len(p)) and own.get(p[i:j]) == a:
                        held.add(p[i:j])
        ranked = []
        for p, a in own.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(k, text, lang, "clash", 0) for k, (lang, text) in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in phrases.mine(spark, df, **how).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [rng.choice(["of", "the", "Of", "new", "york", "in", f"r{rng.randrange(400)}"]) for _ in range(rng.randrange(40))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = rng.choice([["New", "York", "City", "Hall"], ["in", "order", "to"], [], ["a,", "b"], ["x\ty"]])
        out.append(([None, "en", "de"][k % 3], rng.choice([" ", "  ", " \t"]).join(words)))
    return out


@pytest.mark.parametrize("how", [dict(least=5), dict(least=5, bits=12), dict(least=5, block_bytes=400, bucket_bytes=200), dict(least=3, top=7), dict(least=300)])
def test_as_brute_force(spark, how):
    rows = corpus(1, 300)
    own = {k: v for k, v in how.items() if k in ("top", "least")}
    small = how | {"bits": how.get("bits", 16)}
    known = phrases.counts(spark, spark.createDataFrame([(k, t, g, "c", 0) for k, (g, t) in enumerate(rows)], DOCS), small["least"], bits=small["bits"])
    assert known.filter("phrase IS NULL").count() == 3
    top = small.pop("top", 2000)
    assert run(spark, rows, top=top, **small) == brute(rows, **own)


def test_copies_and_overlaps(spark):
    rows = [("en", "a a a a a a a")] * 30 + [("en", "the same passage of words. twice")] * 90 + [("fr", None), ("fr", ""), (None, ",;"), ("en", "b " * 30_000)]
    assert run(spark, rows, bits=16) == brute(rows)
    assert run(spark, [], bits=16) == []


def test_large_numbers_are_exact(spark):
    a, n, l, r = 10**15 - 3, 10**15 - 1, 10**15 - 2, 10**15 - 5  # noqa: E741
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    got = row.selectExpr("(cast(a AS decimal(16, 0)) * cast(1000 * n AS decimal(19, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0))) AS s").first()["s"]
    assert got == int(Decimal(1000) * a * n) // (l * r)
