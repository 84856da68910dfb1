"""Packing: token sequences filled by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and a closing id. Whole windows are cut off long documents
first; the rests (shorter than a window) are the items of a number partitioning problem. The
differencing keeps a heap of partial partitions, takes the two with the largest imbalance and joins
them with opposing order, so that imbalances cancel and the windows come out near-equal. If one of
them exceeds the capacity, the window count rises and the block is differenced again. What the
risen count leaves empty (1.7 % of the tokens of sf0.1) is then filled: the least filled windows are cut up
to fill the others exactly, all other pieces stay where the differencing put them, and what remains is laid
out in windows whose lengths are powers of two, which need no padding.

Blocks have at most ``BLOCK_DOCS`` documents or ``BLOCK_IDS`` ids (a longer document is a block of
its own), are made while a partition streams by, and never meet in a shuffle: memory is bounded by
a block, a lost task is run again with the same result, and sequence ids carry the partition id.

Cases: a null or empty text has only the closing id; a special token's own text is that token, as the
tokenizer has it; doc_id may be null or repeated and is carried
as it is; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 4096
CLOSING_ID = 2
BLOCK_DOCS = 1024
BLOCK_IDS = 1 << 22
#: Words of a worker's cache; beyond it the later half (the rarer words) is dropped.
CACHE_WORDS = 500_000

#: Characters for which the fast path below and the tokenizer's own normaliser and splitter agree.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The splitter's pattern, for lower-cased plain text.
_PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Little-endian uint32 ids of each white-space separated word, made when first met."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.letters, self.pieces = tokenizer, _byte_letters(), {}

    def __missing__(self, word: str) -> bytes:
        found = []
        for piece in _PIECE.findall(word.lower()):
            got = self.pieces.get(piece)
            if got is None:
                spelled = "".join(map(self.letters.__getitem__, piece.encode()))
                got = self.pieces[piece] = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled))
            found.append(got)
        self[word] = out = b"".join(found)
        return out

    def trim(self) -> None:
        for table in (self, self.pieces):
            if len(table) > CACHE_WORDS:
                for key in list(table)[CACHE_WORDS // 2 :]:
                    del table[key]

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, text.split()))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(x.to_bytes(4, "little") for x in ids)


def load(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def _join(a: list, b: list, ways: int) -> list:
    """Two partial partitions as one; each is a descending list of (sum, tree) without its zeros."""
    over = len(a) + len(b) - ways
    if over <= 0:
        return sorted(a + b, key=lambda s: -s[0])
    low_a, low_b = a[len(a) - over :], b[len(b) - over :]
    met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(low_a, reversed(low_b))]
    out = sorted(a[: len(a) - over] + b[: len(b) - over] + met, key=lambda s: -s[0])
    return out


def difference(sizes: list[int], ways: int) -> list[tuple[int, object]]:
    """Karmarkar-Karp: a partition of the items into at most ``ways`` parts, as (sum, tree of indices)."""
    heap, ticket = [], 0
    for k, size in enumerate(sizes):
        heap.append((-size, ticket, 0, [(size, k)]))
        ticket += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, base_a, a = heapq.heappop(heap)
        _, _, base_b, b = heapq.heappop(heap)
        # sums are kept whole; the imbalance is that of the sums less their least
        joined = _join(a, b, ways)
        low = joined[-1][0] if len(joined) == ways else 0
        heapq.heappush(heap, (low - joined[0][0], ticket, base_a + base_b, joined))
        ticket += 1
    return heap[0][3] if heap else []


def _leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        todo.extend(reversed(x)) if isinstance(x, tuple) else out.append(x)
    return out


def windows(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length): each id of each document once, no padding at all."""
    out, items = [], []
    for k, n in enumerate(lengths):
        whole = n - n % capacity
        out += [[(k, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            items.append((k, whole, n - whole))
    total = sum(x[2] for x in items)
    ways = -(-total // capacity)
    parts: list = []
    while items:
        parts = difference([x[2] for x in items], ways)
        if parts[0][0] <= capacity:
            break
        ways += max(1, ways // 64)
    filled = [[items[k] for k in _leaves(tree)] for _, tree in parts]
    room = [capacity - s for s, _ in parts]
    last = len(filled) - 1
    for k in range(len(filled)):
        while room[k] and last > k:  # cut from the least filled window
            doc, start, n = filled[last].pop()
            take = min(n, room[k])
            filled[k].append((doc, start + n - take, take))
            if take < n:
                filled[last].append((doc, start, n - take))
            room[k] -= take
            room[last] += take
            if not filled[last]:
                last -= 1
    filled = filled[: last + 1]
    if filled and room[last]:
        left, rest = capacity - room[last], filled.pop()
        while left:
            size = 1 << (left.bit_length() - 1)
            part, need = [], size
            while need:
                doc, start, n = rest.pop()
                take = min(n, need)
                part.append((doc, start + n - take, take))
                if take < n:
                    rest.append((doc, start, n - take))
                need -= take
            out.append(part)
            left -= size
    return out + filled


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Packed pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id,
    offset and ids (binary, little-endian unsigned 32-bit)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    close = closing_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(tokenizer_path)
        here = TaskContext.get()
        sequence = (here.partitionId() if here else 0) << 40
        keys, ids, held = [], [], 0

        def flush():
            nonlocal sequence, held
            lengths = [len(x) // 4 for x in ids]
            rows = [[] for _ in names]
            for parts in windows(lengths, capacity):
                at = 0
                for doc, start, n in parts:
                    for column, value in zip(rows, (keys[doc], start, n, lengths[doc], sequence, at, ids[doc][4 * start : 4 * (start + n)])):
                        column.append(value)
                    at += n
                sequence += 1
            keys.clear(), ids.clear()
            held = 0
            types = [kind, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                keys.append(key)
                ids.append(words.encode(text.as_py() or "") + close)
                held += len(ids[-1]) // 4
                if len(keys) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield flush()
                    words.trim()
        if keys:
            yield flush()

    schema = f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
