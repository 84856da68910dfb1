import datetime as dt
import random

from pyspark.sql import functions as F

from rosterloom.functions import dates, text
from rosterloom.operators import chains, dedup, intervals, joins, profile

D = dt.date


def test_text_functions(spark):
    cases = [
        (text.tidy, " a   b\n", "a b"), (text.folded, " Straße  A", "strasse a"), (text.id_normal, " +007 ", "7"), (text.id_normal, "-0", "0"), (text.id_normal, "000", "0"), (text.id_normal, "1.5", "1.5"), (text.id_normal, "-07", "-7"),
        (text.item_id, "http://x/entity/Q12", "Q12"), (text.item_id, "Q", None), (text.property_id, "http://x/prop/P3", "P3"), (text.surname_fold, "Müller-Lüdenscheidt (SP)", "mulerludenscheidt"), (text.surname_fold, "Mueller", "muler"),
        (text.name_key, "Zoë van Ångström", "angstrom van zoe"), (text.slug, " Ää b, c_d ", "ää-b-c-d"),
    ]
    for k, (f, given, want) in enumerate(cases):
        assert spark.range(1).select(f(F.lit(given)).alias("x")).first()["x"] == want, (k, given)
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.split_list(F.lit("a; b,c ;;"))) == ["a", "b,c"]
    assert one(text.origin_places(F.lit("Aa (BE), Bb (ZH); Cc, Dd"))) == ["Aa (BE)", "Bb (ZH)", "Cc, Dd"]
    assert [one(text.searchable_name(F.lit(x))) for x in ("A B", "A", "A B C", None)] == [True, False, False, False]
    assert [one(text.as_bool(F.lit(x))) for x in (" TRUE", "1", "yes", "no", None)] == [True, True, True, False, False]
    assert one(text.given_and_last(F.lit(None).cast("string"), F.lit(""), F.lit("Ann B Lee"))).asDict() == {"given": "Ann B", "last": "Lee"}
    relation = lambda a, b: one(text.name_relation(F.lit(a), F.lit(b)))
    assert [relation("Meier", "Anna Meier"), relation("Müller", "Anna Mueller"), relation("Meyer", "Anna Meier"), relation("Huber", "Anna Meier"), relation("", "x")] == ["exact", "variant", "near", "different", None]


def test_near_is_a_window_within_one_edit(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = [(word(rng.randrange(1, 5)), word(rng.randrange(1, 9))) for _ in range(300)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    brute = [any(edits(h[k : k + w], n) <= 1 for w in (len(n) - 1, len(n), len(n) + 1) if w > 0 for k in range(len(h) - w + 1)) for n, h in rows]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n string, h string").select("k", text.near(F.col("n"), F.col("h")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == brute


def test_dates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    iso = lambda x: one(dates.iso_date(F.lit(x)))
    assert [iso(x) for x in ("2020-02-29", "2020-02-29T00:00:00", "2021-02-29", "2021", "2021-05", "2021-00-00", None, "x")] == [D(2020, 2, 29), D(2020, 2, 29), *[None] * 6]
    assert [one(dates.federal_date(F.lit(x))) for x in ("1753-01-01", "1753-01-02")] == [None, D(1753, 1, 2)]
    assert [one(dates.compact_date(F.lit(x))) for x in ("20220501", "20220230", "2022")] == [D(2022, 5, 1), None, None]
    assert [one(dates.open_end(F.lit(x))) for x in ("9999-12-31", "2899-12-31")] == [None, D(2899, 12, 31)]
    assert [one(dates.composed_date(*[F.lit(x) for x in p])) for p in (("2021", "2", "3"), ("2021", "2", "30"), ("2021", "", "3"))] == [D(2021, 2, 3), None, None]
    assert one(dates.graph_date(F.lit("+2021-05-06T00:00:00Z"))) == D(2021, 5, 6)
    assert one(dates.plausible_year(F.lit("1936"), 2022)) == 1936 and one(dates.plausible_year(F.lit("1849"), 2022)) is None


def days(rng, n):
    return [D(2000, 1, 1) + dt.timedelta(rng.randrange(3000)) if rng.random() > 0.15 else None for _ in range(n)]


def test_interval_joins_agree_with_the_definition(spark):
    rng = random.Random(2)
    a = list(zip(range(150), days(rng, 150), days(rng, 150)))
    b = list(zip(range(60), days(rng, 60), days(rng, 60)))
    low, high = D.min, D.max

    def meet(s1, e1, s2, e2):
        if s1 is None or s2 is None:
            return False
        e1, e2 = e1 or high, e2 or high
        return s1 <= e1 and s2 <= e2 and s1 <= e2 and s2 <= e1

    want = sorted((i, j) for i, s1, e1 in a for j, s2, e2 in b if meet(s1, e1, s2, e2))
    left, right = spark.createDataFrame(a, "i int, s1 date, e1 date"), spark.createDataFrame(b, "j int, s2 date, e2 date")
    for small in (True, False):
        got = intervals.overlap_join(left, right, ("s1", "e1"), ("s2", "e2"), small=small)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert want and low


def test_chains_agree_with_a_walk(spark):
    rng = random.Random(3)
    rows = []
    for p in range(80):
        at = D(2000, 1, 1)
        for _ in range(rng.randrange(1, 6)):
            end = at + dt.timedelta(rng.randrange(5))
            rows.append((p, len(rows), at, None if rng.random() < 0.2 else end))
            at = end + dt.timedelta(rng.choice([-1, 0, 1, 1, 1, 2, 9]))
    want = {}
    for p in range(80):
        own = sorted([r for r in rows if r[0] == p], key=lambda r: (r[2], r[1]))
        start, k = own[-1][2], len(own) - 1
        while k and own[k - 1][3] is not None and 0 <= (own[k][2] - own[k - 1][3]).days <= 1:
            k -= 1
            start = own[k][2]
        want[p] = (start, own[-1][3], len(own) - k)
    df = spark.createDataFrame(rows + [(999, 9999, None, None)], "p int, ord int, s date, e date")
    got = {r["p"]: (r["tenure_start"], r["tenure_end"], r["segments"]) for r in chains.latest_tenures(df, ["p"], "s", "e", ["ord"]).collect()}
    assert got == want


def test_dedup_family(spark):
    rows = [(1, 1, None, True), (1, 2, D(2020, 1, 1), False), (1, 3, D(2021, 1, 1), False), (1, 4, D(2021, 1, 1), True), (2, 5, None, None)]
    df = spark.createDataFrame(rows, "p int, ord int, d date, active boolean")
    pick = lambda x: {r["p"]: r["ord"] for r in x.collect()}
    assert pick(dedup.keep_latest(df, ["p"], "d", ["ord"])) == {1: 3, 2: 5}
    assert pick(dedup.keep_earliest(df, ["p"], "d", ["ord"])) == {1: 2, 2: 5}
    assert pick(dedup.keep_active_first(df, ["p"], F.col("active"), "d", ["ord"])) == {1: 4, 2: 5}
    assert pick(dedup.keep_first_dated(df, ["p"], "d", ["ord"])) == {1: 2, 2: 5}
    assert [tuple(r) for r in dedup.unique_or_drop(df, ["p"], "d").collect()] == []


def test_joins_refuse_to_arbitrate(spark):
    probe = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    build = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, item int")
    got = {r["k"]: (r["claims"], r["item"]) for r in joins.unique_key_join(probe, build, ["k"], "item").collect()}
    assert got == {"a": (1, 1), "b": (2, None), "c": (0, None)}
    wanted = spark.createDataFrame([(1, 1, 1, 10, 5), (1, 2, 2, 10, 9), (1, 2, 2, 11, 1), (2, 3, 3, 12, 1), (2, 3, 3, 13, 2)], "g int, m int, o int, i int, s int")
    assert {r["m"]: r["i"] for r in joins.greedy_assign(wanted, "g", "m", "o", "i", "s").collect()} == {1: 10, 2: 11, 3: 13}


def test_numbered_without_gathering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted((r["x"], r["n"]) for r in profile.numbered(df, ["x"], "n").collect()) == [(k, k + 1) for k in range(1000)]


def test_a_sweep_meets_each_pair_once(spark):
    rng = random.Random(9)

    def rows(n, long):
        out = []
        for k in range(n):
            start = D(2000, 1, 1) + dt.timedelta(rng.choice([7, rng.randrange(400)]))
            out.append((k, start, None if rng.random() < 0.02 else start + dt.timedelta(rng.randrange(-1, long if rng.random() < 0.05 else 6))))
        return out

    a, b = rows(400, 300), rows(300, 300)
    last = lambda e: e or D.max
    want = sorted((i, j) for i, s1, e1 in a for j, s2, e2 in b if s1 <= last(e1) and s2 <= last(e2) and s1 <= last(e2) and s2 <= last(e1))
    left, right = spark.createDataFrame(a, "i int, s date, e date"), spark.createDataFrame(b, "j int, s2 date, e2 date")
    for size in (50, 10_000):
        got = intervals.sweep(left, right, ("s", "e"), ("s2", "e2"), cell_rows=size)
        assert got.columns == ["i", "s", "e", "j", "s2", "e2"] and sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert intervals.sweep(left.limit(0), right, ("s", "e"), ("s2", "e2")).count() == 0


def fold(pairs, pick):
    taken, out = set(), {}
    for m in sorted({m for m, *_ in pairs}):
        got = pick(sorted(p for p in pairs if p[0] == m and p[1] not in taken))
        if got is not None:
            taken.add(got)
            out[m] = got
    return out


def test_parallel_assignment_is_the_fold(spark):
    from rosterloom.plans import resolve

    def ladder(free):
        agree, seated = [p for p in free if p[3]], [p for p in free if p[2]]
        if agree:
            return agree[0][1] if len(agree) == 1 else None
        if len(seated) == 1:
            return seated[0][1]
        return free[0][1] if not seated and len(free) == 1 else None

    rng = random.Random(10)
    for members, items, most in ((40, 30, 4), (60, 12, 3)):
        pairs = sorted({(m, f"Q{rng.randrange(items)}") for m in range(members) for _ in range(rng.randrange(1, most + 1))})
        rows = [(m, q, rng.random() < 0.3, rng.random() < 0.2, rng.randrange(5)) for m, q in pairs]
        df = spark.createDataFrame(rows, "ord long, _q string, _seated boolean, _agrees boolean, score int")
        got = {r["ord"]: r["_q"] for r in resolve.settled(df, "ord", "_q", resolve._picks, whole=True).collect()}
        assert got == fold(rows, ladder)
        best = fold(rows, lambda free: max(free, key=lambda p: (p[4], -int(p[1][1:])))[1] if free else None)
        wanted = df.select(F.lit(1).alias("g"), "ord", F.substring("_q", 2, 9).cast("int").alias("i"), "score", F.col("ord").alias("o"))
        assert {r["ord"]: f"Q{r['i']}" for r in joins.greedy_assign(wanted, "g", "ord", "o", "i", "score").collect()} == best


def test_spare_rows_of_an_alignment(spark):
    left, right = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "l int, f string, s string"), spark.createDataFrame([(10, "a", "x"), (11, "c", "z")], "r int, f2 string, s2 string")
    met = joins.two_signal_align(left, right, "l", "r", ("f", "f2"), ("s", "s2"))
    assert [r["r"] for r in joins.spare_right(met, right, "r").collect()] == [11]
