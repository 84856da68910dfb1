"""URL filters: exact rule membership from Bloom filter cascades, without a join.

A rule is a host and a path prefix. Every url has a bounded set of keys that could be rules: each
suffix of its host at a label border with each prefix of its path whose length some rule has. The
keys of all urls of the corpus are the universe. A cascade answers "is this key listed?" for every
key of the universe: level 0 encodes the listed keys, level 1 the keys of the universe that level 0
takes for listed wrongly, level 2 the listed keys that level 1 holds wrongly, and so on until a level
has no false positive. The number of levels a key passes, odd or even, is the exact answer.
Level 0 is sized by the number of keys so that fewer slip through than are listed: what the driver
gathers is of the size of the rule list, which the caller gives, and doesn't follow the corpus. Listed keys
are told from false positives where the universe is scanned, whatever their number.

There is one cascade for rules that block and one for rules that allow; one scan of the universe, which is
written once, serves both. The rules of a url are those
of its keys that either cascade holds; the longest rule decides (longest text, then longest
host). No rule: ``allow``.

Cases: a null url or one without ``://`` has an empty host and path, and no key; repeated urls are
judged each; an empty table gives no rows; an empty rule list allows all; two rules with one host and path:
block wins. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm import store
from rosterloom.llm import textkernel as tk

#: The rules as they are given: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
HASHES_AT_LEAST = 1


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, lengths: Iterable[int]) -> Column:
    """All keys of a url that could be rules, the longest first: structs of its length, host's length and text."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = sorted(set(lengths), reverse=True)
    heads = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in known]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(heads, lambda p: F.struct((F.char_length(h) + F.char_length(p)).alias("n"), F.char_length(h).alias("h"), F.concat(h, p).alias("key")))))
    return F.when(host != "", F.transform(F.sort_array(pairs, asc=False), lambda s: s["key"])).otherwise(F.array().cast("array<string>"))


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text."""
    data, offsets = tk.column_bytes(texts)
    sizes, out = np.diff(offsets), []
    full = sizes > 0
    for seed in (0, 1):
        got = np.zeros(len(sizes), np.uint64)
        if full.any():
            within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
            values = tk._CODES[seed, False][data] * tk._powers(tk._BASES[seed], int(sizes.max()))[within]
            got[full] = np.add.reduceat(values, offsets[:-1][full])
        out.append(tk.mix(got + sizes.astype(np.uint64)))
    return out[0], out[1]


@dataclass
class Bloom:
    """One level: double hashing over a bit table, eight bits a byte."""

    bits: np.ndarray
    hashes: int
    salt: int

    @classmethod
    def of(cls, texts: list[str], rate: float, salt: int) -> Bloom:
        n = max(1, len(texts))
        size = max(64, int(np.ceil(-n * np.log(rate) / np.log(2) ** 2)))
        out = cls(np.zeros(-(-size // 64) * 8, np.uint8), max(HASHES_AT_LEAST, round(size / n * np.log(2))), salt)
        if texts:
            for at in out._places(*_hashes(pa.array(texts, pa.string()))):
                np.bitwise_or.at(out.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return out

    def _places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        a, b = tk.mix(a + np.uint64(self.salt)), tk.mix(b ^ np.uint64(self.salt)) | np.uint64(1)
        for k in range(self.hashes):
            yield (tk.mix(a + np.uint64(k) * b) % np.uint64(8 * len(self.bits))).astype(np.int64)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in self._places(a, b):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def passed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many levels in a row hold each key."""
        depth, alive = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for level in self.levels:
            alive &= level.holds(a, b)
            depth += alive
        return depth

    def listed(self, texts: pa.Array) -> np.ndarray:
        return self.passed(*_hashes(texts)) % 2 == 1


def _slipped(universe: DataFrame, shared) -> DataFrame:
    """Keys of the universe that are not listed but held by the first level, with the number of the cascade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            hashes = _hashes(keys)
            for k, (level, listed) in enumerate(shared.value):
                false = level.holds(*hashes) & ~pc.is_in(keys, value_set=listed).to_numpy(zero_copy_only=False)
                found = keys.filter(pa.array(false))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), found.cast(pa.string())], ["which", "key"])

    return universe.mapInArrow(run, "which int, key string")


def build(universe: DataFrame, size: int, lists: list[list[str]]) -> list[Cascade]:
    """For each list of keys a cascade that is exact on the distinct keys of ``universe`` (column key; ``size`` of them)."""
    lists = [sorted(set(listed)) for listed in lists]
    starts = [Bloom.of(listed, min(0.5, max(len(listed), 1) * 0.5**0.5 / max(size, 1)), 1) for listed in lists]
    if not any(lists):
        return [Cascade() for _ in lists]
    shared = universe.sparkSession.sparkContext.broadcast([(start, pa.array(listed, pa.string())) for start, listed in zip(starts, lists)])
    false: list[set[str]] = [set() for _ in lists]
    for row in _slipped(universe, shared).distinct().collect():  # of the size of the lists
        false[row["which"]].add(row["key"])
    made = []
    for start, inside, others in zip(starts, lists, false):
        cascade = Cascade([start] if inside else [])
        outside = sorted(others) if inside else []
        while outside:  # the next level encodes what the last holds wrongly; then the two sides change places
            level = Bloom.of(outside, 0.5, 1 + 7919 * len(cascade.levels))
            cascade.levels.append(level)
            a, b = _hashes(pa.array(inside, pa.string()))
            inside, outside = outside, [x for x, y in zip(inside, level.holds(a, b)) if y]
        made.append(cascade)
    return made


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``pages`` judged: the key column, host, path, rule and verdict."""
    rules = list(rules)
    host, path = parts(F.col(url))
    lengths = {len(p) for _, _, p in rules}
    urls = pages.select(F.col(key), F.col(url).alias("url")).select(key, host.alias("host"), path.alias("path"))
    candidates = urls.select(key, "host", "path", keys(F.col("host"), F.col("path"), lengths).alias("keys") if lengths else F.array().cast("array<string>").alias("keys"))
    universe = store.written(pages.sparkSession, candidates.select(F.explode("keys").alias("key")).distinct(), "keys")
    size = universe.count()
    blocked = {h + p for v, h, p in rules if v == "block"}
    allowed = {h + p for v, h, p in rules if v == "allow"} - blocked
    shared = pages.sparkSession.sparkContext.broadcast(build(universe, size, [sorted(blocked), sorted(allowed)]))
    schema = candidates.drop("keys").schema.add("rule", "string").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, allow = shared.value
        for batch in batches:
            found = batch.column("keys")
            flat, at = found.flatten(), np.asarray(found.value_lengths().fill_null(0))
            stop = block.listed(flat) if block.levels else np.zeros(len(flat), bool)
            go = allow.listed(flat) if allow.levels else np.zeros(len(flat), bool)
            row = np.repeat(np.arange(len(batch)), at)
            hit = np.flatnonzero(stop | go)
            rows, firsts = np.unique(row[hit], return_index=True)  # the longest rule of each url comes first
            chosen = hit[firsts]
            rule = np.full(len(batch), -1)
            rule[rows] = chosen
            named = pa.array([None if k < 0 else int(k) for k in rule], pa.int64())
            verdict = np.full(len(batch), "allow", object)
            verdict[rows[stop[chosen]]] = "block"
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (0, 1, 2)], flat.take(named).cast(pa.string()), pa.array(verdict, pa.string())], [key, "host", "path", "rule", "verdict"])

    return candidates.mapInArrow(run, schema)


def oracle(rules: Iterable[tuple[str, str, str]] = RULES) -> str:
    """The same in DuckDB SQL over the table pages."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), split AS (
  SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM named
), rules(verdict, host, path) AS (VALUES {values}
), fits AS (
  SELECT s.*, r.verdict, r.host || r.path AS rule,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict DESC) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1"""
