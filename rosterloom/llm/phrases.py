"""Phrase collocations by counting truncated suffixes with one stack.

Texts, A-Z lower-cased, fall into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. Everything is per
language. A phrase with fewer occurrences than the least wanted is no candidate and in none, so a suffix ends
where the phrase that begins there gets too rare:

1. Each task counts the hashes of all phrases of 1 to ``MOST_WORDS`` words in slots, which saturate at the
   least count; the slots of all tasks are summed. A phrase in a slot below the least count is too rare for certain. The table has
   two to the power ``SLOT_BITS`` slots at any size, of which 2 MB of bits are broadcast; a larger corpus fills it, and more
   suffixes grow to their full length.
2. Each position gives the longest suffix, of ``MOST_WORDS`` words at most, all of whose parts may be frequent. Equal ones of a
   block become one with a count, and those of a language and a hash of the first word, which may be hot, and the second,
   are packed into one row; single words go by their own hash beside them. A task sorts the suffixes of such a bucket in reverse order,
   so each comes before its own prefixes, and one stack of words counts all prefixes in one pass: a word leaves the stack
   with all that was counted since it came. So each phrase is counted in one place.
3. Parts are joined to the candidates from the table of counts, and scores are whole numbers in decimals of 38 digits.

Counts are exact but for collisions of 64-bit hashes. A task holds a block of texts, or the distinct suffixes of one bucket,
of which each is frequent by its hash; rows of a bucket are read one at a time.

Cases: a null language is ``und``, a null text empty; a lang with fewer phrases than asked for returns all; repeated rows
count each; an empty table returns nothing; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.llm import store
from rosterloom.llm import textkernel as tk

LEAST = 100
MOST_WORDS = 5
TOP = 2000
INSIDE_PERCENT = 100
SLOT_BITS = 24
PIECE_BITS = 16
BLOCK_BYTES = 6 << 20
#: A bucket's share of the texts, and the buckets beyond which the shares grow.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1 << 14
#: A task joins equal suffixes of a bucket when it holds so many.
JOIN_AT = 1 << 18
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[0x20, 0x0A]] = True
_FACTORS = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA3B195354A39B70D))


class Block:
    """The words of some texts: hashes, salted with the language, and the piece of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        data = _LOWER[data]
        starts, ends, hashes, counts = [], [], [], []
        for a, b in tk.slices(offsets):  # near the cache
            w = tk.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _GAPS)
            starts.append(w.start + offsets[a]), ends.append(w.end + offsets[a]), hashes.append(w.hashes()), counts.append(w.counts)
        self.data, self.counts = data, np.concatenate(counts)
        self.start, self.end, plain = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.doc = np.repeat(np.arange(len(langs)), self.counts)
        salts = {lang: zlib.crc32(lang.encode()) for lang in set(langs)}
        self.hash = tk.mix(plain + np.array([salts[lang] for lang in langs], _U)[self.doc] * _FACTORS[0])
        self.piece = np.cumsum(_BREAKS[data], dtype=np.int64)[self.start] + self.doc

    def phrases(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on the hash of the phrase at each word and whether one fits there; the last words have none."""
        value = np.zeros(len(self.hash), _U)
        for k in range(min(most, len(self.hash))):
            n = len(self.hash) - k
            value = (value[:n] + self.hash[k:]) * _FACTORS[k % 5]
            value ^= value >> _U(31)
            yield value, self.piece[:n] == self.piece[k:]


def _slots(value: np.ndarray, bits: int) -> np.ndarray:
    return ((value * _FACTORS[1]) >> _U(64 - bits)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[str], Block]]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        for a, b, data, offsets in tk.by_document(batch, limit=limit):
            yield names[a:b], Block(data, offsets, names[a:b])


def _counted(bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint32)
        for _, block in _blocks(batches, tk.SLICE_BYTES):
            for value, fits in block.phrases(most):
                np.add.at(seen, _slots(value[fits], bits), np.uint32(1))
        kind = np.uint8 if least < 256 else np.uint32
        for at in range(0, len(seen), 1 << PIECE_BITS):
            piece = np.minimum(seen[at : at + (1 << PIECE_BITS)], least).astype(kind)
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at >> PIECE_BITS]), pa.array([pa.compress(piece.tobytes(), "zstd", asbytes=True)], pa.binary())], ["piece", "seen"])

    return run


def _frequent(bits: int, least: int):
    """The sums of a task's pieces as bits: whether they reach the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, size, total = np.uint8 if least < 256 else np.uint32, min(bits, PIECE_BITS), {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(pa.decompress(blob.as_buffer(), (1 << size) * np.dtype(kind).itemsize, "zstd"), kind)
                total[piece] = np.minimum(total.get(piece, 0) + got.astype(np.int64), least)
        rows = [(p, np.packbits(x >= least).tobytes()) for p, x in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["piece", "seen"])

    return run


def _suffixes(shared, bits: int, buckets: int, most: int, limit: int):
    """The distinct truncated suffixes of a block with their counts, packed by bucket and language; and how many words a task has seen, in bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, words = shared.value, {}
        for langs, block in _blocks(batches, limit):
            n = len(block.hash)
            for lang, own in zip(langs, block.counts.tolist()):
                words[lang] = words.get(lang, 0) + own
            if not n:
                continue
            length, alive = np.zeros(n, np.int64), np.ones(n, bool)
            for value, fits in block.phrases(most):
                slot = _slots(value, bits)
                alive = alive[: len(value)] & fits & ((frequent[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1)
                length[: len(value)] += alive
            for _ in range(most - 1):  # a phrase is no more frequent than what follows its first word
                length[:-1] = np.minimum(length[:-1], length[1:] + 1)
            key = block.hash.copy()
            for k, (value, _) in enumerate(block.phrases(most), 1):
                at = np.flatnonzero((length[: len(value)] == k) & (k > 1))
                key[at] = value[at] + _U(k)
            begin, size, times = [], [], []
            for at, lengths, keys in ((np.flatnonzero(length > 1), length, key), (np.flatnonzero(length > 0), np.ones(n, np.int64), block.hash)):
                _, one, c = np.unique(keys[at], return_index=True, return_counts=True)
                begin.append(at[one]), size.append(lengths[at[one]]), times.append(c)
            begin, size, times = (np.concatenate(x) for x in (begin, size, times))
            names = sorted(set(langs))
            lang = np.array([names.index(x) for x in langs])[block.doc[begin]]
            deal = block.hash[begin] + np.where(size > 1, block.hash[np.minimum(begin + 1, n - 1)] * _FACTORS[2], _U(0))
            group = (tk.mix(deal) % _U(buckets)).astype(np.int64) * len(names) + lang
            order = np.lexsort((block.hash[begin], group))
            begin, size, times, group = begin[order], size[order], times[order], group[order]
            # the block's words with one space behind each, and of them each suffix with a line end
            wide = block.end - block.start + 1
            place = np.cumsum(wide) - wide
            flat = np.append(block.data, np.uint8(32))[np.minimum(np.repeat(block.start - place, wide) + np.arange(int(wide.sum())), len(block.data))]
            flat[place + wide - 1] = 32
            last = begin + size - 1
            spans = place[last] + wide[last] - place[begin]
            ends = np.cumsum(spans)
            text = flat[np.repeat(place[begin] - (ends - spans), spans) + np.arange(int(ends[-1]) if len(ends) else 0)]
            text[ends - 1] = 10
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                own = text[ends[a] - spans[a] : ends[b - 1]]
                rows.append((int(group[a]) // len(names), names[int(group[a]) % len(names)], b - a, len(own), _zipped(own), _zipped(times[a:b].astype(np.int32))))
            yield _packed_rows(rows)
        yield _packed_rows([(-1, lang, n, 0, b"", b"") for lang, n in words.items()])

    return run


_PACKED = "bucket int, lang string, n bigint, size bigint, text binary, counts binary"


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _PACKED.split(", ")])


def _zipped(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


class Suffixes:
    """The suffixes of one bucket and language: their words' hashes in columns, counts, and texts; equal ones are joined when many came."""

    def __init__(self, most: int):
        self.most, self.held, self.n, self.joined = most, [], 0, 0

    def add(self, text: np.ndarray, counts: np.ndarray) -> None:
        words = tk.Words(text, np.array([0, len(text)]), _ENDS)
        suffix = np.cumsum(text == 10)[words.start]
        first = np.searchsorted(suffix, np.arange(len(counts) + 1))
        place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
        hashes, ends = np.zeros((self.most, len(counts)), _U), np.zeros((self.most, len(counts)), np.int64)
        hashes[place, suffix], ends[place, suffix] = words.hashes() | _U(1), words.end
        self.held.append((hashes, ends - words.start[first[:-1]], words.start[first[:-1]], counts.astype(np.int64), text))
        self.n += len(counts)
        if self.n > JOIN_AT + 2 * self.joined:
            self.sort()

    def sort(self) -> tuple[np.ndarray, ...]:
        """All in reverse order, longer ones before their prefixes, each once."""
        base = np.cumsum([0, *[len(h[4]) for h in self.held]])
        hashes, ends, counts = (np.concatenate([h[k] for h in self.held], -1) for k in (0, 1, 3))
        begin, text = np.concatenate([h[2] + b for h, b in zip(self.held, base)]), np.concatenate([h[4] for h in self.held])
        order = np.lexsort(hashes[::-1])[::-1]
        hashes = hashes[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[:, 1:] != hashes[:, :-1]).any(0)
        at = np.flatnonzero(new)
        counts = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
        hashes, ends, begin = hashes[:, at], ends[:, order[at]], begin[order[at]]
        size = ends.max(0) if len(at) else np.zeros(0, np.int64)
        own = np.cumsum(size) - size
        text = text[np.repeat(begin - own, size) + np.arange(int(size.sum()))]
        self.held, self.n, self.joined = [(hashes, ends, own, counts, text)], len(at), len(at)
        return self.held[0]

    def prefixes(self, least: int) -> tuple[list[str], list[int]]:
        """The phrases with at least ``least`` occurrences. The stack of sorted suffixes as arrays: its k-th word leaves where a row's
        first k words differ from those of the row before, with all that was counted since it came. A bucket has all suffixes that begin with
        two words, and, apart from them, all suffixes of one word."""
        hashes, ends, begin, counts, text = self.sort()
        phrases, found = [], []
        for k in range(self.most):
            rows = np.flatnonzero((hashes[k] != 0) if k else (hashes[1] == 0) if self.most > 1 else hashes[0] != 0)
            if not len(rows):
                continue
            own = hashes[: k + 1, rows]
            came = np.concatenate(([0], np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1))
            total = np.add.reduceat(counts[rows], came)
            for row, n in zip(rows[came[total >= least]].tolist(), total[total >= least].tolist()):
                phrases.append(text[begin[row] : begin[row] + ends[k, row]].tobytes().decode("utf-8", "replace")), found.append(n)
        return phrases, found


def _stacked(least: int, most: int):
    """The frequent phrases of sorted buckets, one bucket and language at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None

        def flush() -> pa.RecordBatch:
            phrases, found = ([None], [own]) if key[0] < 0 else own.prefixes(least)
            return pa.RecordBatch.from_arrays([pa.array([key[1]] * len(found), pa.string()), pa.array(phrases, pa.string()), pa.array(found, pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for bucket, lang, n, size, text, counts in zip(*(batch.column(k) for k in range(6))):
                if (bucket.as_py(), lang.as_py()) != key:
                    if key is not None:
                        yield flush()
                    key = (bucket.as_py(), lang.as_py())
                    own = 0 if key[0] < 0 else Suffixes(most)
                if key[0] < 0:
                    own += n.as_py()
                else:
                    own.add(np.frombuffer(pa.decompress(text.as_buffer(), size.as_py(), "zstd"), np.uint8), np.frombuffer(pa.decompress(counts.as_buffer(), 4 * n.as_py(), "zstd"), np.int32))
        if key is not None:
            yield flush()

    return run


def counts(spark: SparkSession, docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, bits: int = SLOT_BITS) -> DataFrame:
    """lang, phrase, f of every phrase with at least ``least`` occurrences; and a row a language with a null phrase and all its words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = texts.mapInArrow(_counted(bits, least, most), "piece bigint, seen binary")
    frequent = np.zeros(1 << bits - 3, np.uint8)
    for r in pieces.repartition(F.col("piece")).mapInArrow(_frequent(bits, least), "piece bigint, seen binary").collect():  # 2 MB
        at = r["piece"] << PIECE_BITS - 3
        frequent[at : at + (1 << PIECE_BITS - 3)] = np.frombuffer(r["seen"], np.uint8)
    buckets = max(1, min(MOST_BUCKETS, -(-size // bucket_bytes)))
    suffixes = texts.mapInArrow(_suffixes(spark.sparkContext.broadcast(frequent), bits, buckets, most, block_bytes), _PACKED)
    dealt = suffixes.repartition("bucket").sortWithinPartitions("bucket", "lang")
    return store.written(spark, dealt.mapInArrow(_stacked(least, most), "lang string, phrase string, f bigint"), "phrases")


def mine(spark: SparkSession, docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, inside_percent: int = INSIDE_PERCENT, **sizes: int) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score; ``sizes`` as ``counts`` takes them."""
    known = counts(spark, docs, least, most, **sizes)
    words = F.split("phrase", " ")
    held = known.filter(F.col("phrase").isNotNull()).withColumn("words", words)
    wanted = held.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = wanted.select("lang", "phrase", "a", "words", k)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    parts = held.select("lang", "phrase", "f")
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.join(known.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n")), "lang")
    score = F.expr("(cast(a AS decimal(16, 0)) * cast(1000 * n AS decimal(19, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
    lowest = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("cut").alias("cut"))
    # what a longer phrase holds as often, a phrase longer by one word holds as often, so those are enough
    longer = wanted.filter(F.size("words") > 2).select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " "))).alias("phrase"))
    most_held = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(most_held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB SQL over the table documents.
ORACLE = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
pos AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM pos, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= {LEAST}
), c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS k FROM c),
s AS (
  SELECT cut.lang, cut.phrase, a, cut.k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN n ON n.lang = cut.lang
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.ws[1 : cut.k], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.ws[cut.k + 1 :], ' ')
), low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
kept AS (
  SELECT * FROM low WHERE nth = 1 AND NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = low.lang AND len(c.ws) > len(string_split(low.phrase, ' ')) AND 100 * c.a >= {INSIDE_PERCENT} * low.a AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' '))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}"""
