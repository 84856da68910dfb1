import random
import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from rosterloom.llm import decontaminate as d
from rosterloom.llm import textkernel as tk

DOCS, BENCH = "doc_id long, text string, item_id string", "item_id long, text string, doc_id int"


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def run(spark, docs, items):
    return d.leaks(spark.createDataFrame([(*r, "clash") for r in docs], DOCS), spark.createDataFrame([(*r, 0) for r in items], BENCH)).collect()


def test_substituted_passages_are_found(spark):
    rng = random.Random(3)
    items = [words(rng, n) for n in (14, 25, 36, 59, 8)]
    docs, want = [], set()
    for k in range(60):
        text = words(rng, 200)
        if k % 2:
            item = k // 2 % 5
            own = list(items[item])
            if len(own) > 20:
                for at in range(6, len(own), 9):
                    own[at] = "changed"
            text[70:70] = [x.upper() + "," for x in own]
            want.add((k, item))
        docs.append((k, " ".join(text)))
    got = run(spark, docs, [(i, " ".join(x)) for i, x in enumerate(items)])
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["start"] == 70 for r in got)


def test_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, bench).collect()}

    def toks(rows, key):
        data, offsets = tk.column_bytes(pa.array([r["text"] for r in rows]))
        w, h = d.tokens(data, offsets)
        return [(r[key], h[w.first[k] : w.first[k + 1]]) for k, r in enumerate(rows)]

    documents, items = toks(docs.collect(), "doc_id"), toks(bench.collect(), "item_id")
    brute = set()
    for doc, a in documents:
        for item, b in items:
            shared = np.isin(a, b)
            if shared.sum() < d.SHORTEST:
                continue
            if any(d.verify(a, b, g) for g in range(-len(b) + 5, len(a) - 4)):
                brute.add((doc, item))
    assert got == brute


def test_odd_rows(spark):
    item = (0, "one two three four five six seven eight nine ten eleven twelve thirteen")
    assert run(spark, [], [item]) == []
    assert run(spark, [(1, "a b c")], []) == []
    got = run(spark, [(None, item[1]), (1, None), (2, ""), (3, item[1]), (3, item[1]), (4, "x " * 50000 + item[1])], [item, (1, None), (2, ""), (3, "one two"), (0, item[1])])
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, 0)] * 2 + [(3, 0)] * 4 + [(4, 0)] * 2


def test_clean_keeps_the_rest(spark):
    item = (0, " ".join(f"t{k}" for k in range(20)))
    docs = spark.createDataFrame([(1, item[1], "s"), (2, "fine", "s"), (None, item[1], "s"), (None, "ok", None), (3, None, None)], DOCS)
    kept = d.clean(docs, spark.createDataFrame([(*item, 0)], BENCH))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) + str(r["text"]) for r in kept.collect()) == ["2fine", "3None", "Noneok"]


def accepted(length):
    """Passages that verify accepts for an item of this length, as the sets of tokens that differ."""
    item = np.arange(1, length + 1, dtype=np.uint64)
    for n in range(length - d.SHORTEST + 1):
        for at in combinations(range(length), n):
            own = item.copy()
            own[list(at)] = 1000
            if d.verify(own, item, 0):
                yield set(at)


@pytest.mark.parametrize("length", range(5, 17))
def test_every_accepted_passage_is_hit(length):
    data, offsets = tk.column_bytes(pa.array([" ".join(f"t{k}" for k in range(length))]))
    item = d.tokens(data, offsets)[1]
    known = set(zip(*(x.tolist() for x in d.item_seeds(item))))
    around = tk.mix(np.arange(7000, 7003, dtype=np.uint64))
    patterns = list(accepted(length))
    assert set() in patterns and max(map(len, patterns)) == length - d.needed(length)
    for at in patterns:
        own = item.copy()
        own[list(at)] = tk.mix(np.arange(900, 900 + len(at), dtype=np.uint64))
        for text, diagonal in ((own, 0), (np.concatenate((around, own, around)), 3)):
            found = [(h, k - diagonal) for mask, _ in d.masks_of(length) for k, h in enumerate(d.seeds(text, mask).tolist())]
            assert known & set(found), at


def test_item_ids_of_any_type_and_more_seeds_than_bits(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_BITS", 16)
    rng = random.Random(5)
    items = [words(rng, 30) for _ in range(400)]
    docs = spark.createDataFrame([(k, " ".join(words(rng, 40) + items[k][:20])) for k in range(60)] + [(99, " ".join(words(rng, 300)))], "doc_id int, text string")
    for kind, name in (("int", int), ("string", str)):
        tests = spark.createDataFrame([(name(k), " ".join(x)) for k, x in enumerate(items)], f"item_id {kind}, text string")
        assert sorted((r["doc_id"], int(r["item_id"])) for r in d.leaks(docs, tests).collect()) == [(k, k) for k in range(60)]


def test_a_hot_passage_and_a_repeated_word(spark):
    item = " ".join(f"t{k}" for k in range(20))
    docs = [(k, f"{item} own{k}") for k in range(300)] + [(900, "same " * 3000)]
    got = run(spark, docs, [(0, item), (1, "same " * 15)])
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, 0) for k in range(300)] + [(900, 1)]


def test_short_items_that_differ_or_are_cut_off_are_found(spark):
    rng = random.Random(8)
    items = [words(rng, n) for n in range(6, 14)]
    docs = []
    for k, item in enumerate(items):
        own = list(item)
        own[len(own) // 2] = "changed"
        docs.append((2 * k, " ".join(words(rng, 50) + own + words(rng, 50))))
        docs.append((2 * k + 1, " ".join(item[1:] + words(rng, 50))))
    got = run(spark, docs, [(k, " ".join(x)) for k, x in enumerate(items)])
    refused = {(2 * k, k) for k, item in enumerate(items) if {len(item) // 2} not in list(accepted(len(item)))}
    assert len(refused) == 3
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(n, n // 2) for n in range(2 * len(items))} - refused


def test_texts_without_spaces_and_short_items(spark):
    chinese = "北京是中华人民共和国的首都，也是全国的政治中心。"
    docs = [
        (1, "who won in 1998"), (2, "Tell me: Who won, in 1998?!"), (3, f"据说{chinese}人口很多"), (4, chinese.replace("首都", "城市")), (5, "yes"), (6, "yes, of course"), (7, "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"),
        (8, "who lost in 1998"), (9, "中国人民"), (10, "中国"), (11, "在中国很多"), (12, "«Où» est—il"),
    ]
    items = [(0, "who won in 1998"), (1, chinese), (2, "Yes."), (3, "เป็นเมืองหลวงของประเทศไทย"), (4, "中国"), (5, "où est il"), (6, "?!")]
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, docs, items)}
    assert got == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (7, 3), (10, 4), (12, 5)}


def plain_tokens(text):
    """The tokens by a plain walk over the characters."""
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        kind = c.isalnum() if c < "\x80" else unicodedata.category(c)[0] in "LMN"
        alone = any(low <= ord(c) <= high for low, high in tk._UNSPACED)
        if word and (not kind or alone):
            out.append(word)
            word = ""
        if kind and alone:
            out.append(c)
        elif kind:
            word += c
    return out + [word] * bool(word)


def plain_leak(doc, item):
    """Whether a text holds an item, from the definition: on some diagonal a stretch with enough agreeing tokens, of which three in four agree best."""
    if not item:
        return False
    if len(item) < d.SHORTEST:
        if len(item) < d.FEW or sum(len(t.encode()) for t in item) < d.FEW_BYTES:
            return doc == item
        return any(doc[k : k + len(item)] == item for k in range(len(doc)))
    need = min(12, max(5, -(-8 * len(item) // 10)))
    for g in range(-len(item) + 1, len(doc)):
        same = [doc[k + g] == item[k] for k in range(len(item)) if 0 <= k + g < len(doc)]
        if sum(same) < need:
            continue
        top, agreed, score, run_ = 0, 0, 0, 0
        for x in same:  # the stretch with the best score so far, its agreeing tokens
            score, run_ = (score + 1, run_ + 1) if x else (score - 3, run_)
            if score < 0:
                score, run_ = 0, 0
            if score > top:
                top, agreed = score, run_
        if agreed >= need:
            return True
    return False


def test_an_independent_search_finds_the_same(spark):
    rng = random.Random(12)
    items = [words(rng, n) for n in (2, 3, 4, 6, 9, 13, 18, 30)] + [list("北京是中华人民共和国的首都也是全国的政治中心")]
    docs = []
    for k in range(80):
        item = items[k % len(items)]
        own = [w if rng.random() > 0.12 else "other" for w in item]
        around = [words(rng, rng.randrange(30)) for _ in range(2)]
        joined = "".join(own) if k % len(items) == 8 and "other" not in own else " ".join(own)
        docs.append((k, rng.choice(["", " ".join(around[0]) + " — "]) + joined + rng.choice(["", "。" + " ".join(around[1])])))
    tests = [(k, " ".join(x) if k < 8 else "".join(x)) for k, x in enumerate(items)]
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, docs, tests)}
    assert got == {(i, k) for i, text in docs for k, item in tests if plain_leak(plain_tokens(text), plain_tokens(item))}
    assert len(got) > 30


def test_no_accepted_pattern_of_any_length_misses_all_masks():
    """A walk over all strings of agreements that hold no mask: none has a stretch with ``MATCHED`` of them that the score keeps."""
    width = max(map(len, d.MASKS))
    cares = [int(m, 2) for m in d.MASKS]
    sizes = [(1 << len(m)) - 1 for m in d.MASKS]
    todo, seen = [(0, 0, 0, 0)], {(0, 0, 0, 0)}
    while todo:
        last, score, agreed, top = todo.pop()
        for same in (0, 1):
            now = (last << 1 | same) & ((1 << width) - 1)
            if any(now & size & care == care for care, size in zip(cares, sizes)):
                continue
            s, a = (score + 1, min(agreed + 1, d.MATCHED)) if same else (score - 3, agreed)
            s, a = (s, a) if s >= 0 else (0, 0)
            assert s <= top or a < d.MATCHED  # a text that ends here would be accepted
            state = (now, s, a, max(top, s))
            if state not in seen:
                seen.add(state), todo.append(state)
    assert len(seen) > 1000
