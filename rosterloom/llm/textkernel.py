"""Vectorised byte and word kernels over Arrow text columns.

A column of texts is seen as one run of UTF-8 bytes plus offsets, so words, their hashes and the
hashes of word n-grams are made for many documents at once in numpy. All hashes are 64-bit and
depend on the bytes of a word only, never on where it stands. Nulls count as empty texts here;
callers that tell null from empty keep the null mask.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Also everything ASCII that is no letter or digit: what is left are plain word forms.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_codes(seed: int, lower: bool) -> np.ndarray:
    codes = mix(np.arange(256, dtype=_U) + _U(1 + 1000 * seed)) | _U(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {(s, low): _byte_codes(s, low) for s in (0, 1) for low in (False, True)}
_BASES = (0xD6E8FEB86659FD93, 0xA3B195354A39B70D)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


#: Scripts that put no spaces between words: Thai to Lao, Myanmar, Khmer, kana, ideographs, and those beyond the first plane.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it parts words (no letter, mark or number), and whether it is a word of its own."""
    parts, alone = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    parts[[c for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] not in "LMN"]] = True
    for low, high in _UNSPACED:
        alone[low : high + 1] = True
    return parts, alone & ~parts


def character_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks for ``Words``: words are runs of letters, marks and numbers of any script; in scripts without spaces each character is
    a word."""
    inked, opens = ~NOT_ALNUM[data], np.zeros(len(data), bool)
    if len(data) and data.max() >= 0xC0:
        parts, alone = _characters()
        for width, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
            at = np.flatnonzero((data >= low) & (data < high))
            code = (data[at] & (0x7F >> width)).astype(np.int64)
            for k in range(1, width):
                code = code << 6 | data[at + k] & 0x3F
            for k in range(width):
                inked[at[parts[code]] + k] = False
            own = at[alone[code]]
            opens[own] = True
            after = own + width
            opens[after[after < len(data)]] = True
    return inked, opens


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of documents.

    ``start`` and ``end`` are byte positions, ``first`` has for each document the index of its first
    word and one more entry at the end, so document d owns words ``first[d]:first[d + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE, marks: tuple[np.ndarray, np.ndarray] | None = None):
        """``marks`` are, in place of ``gaps``, whether each byte is of a word and whether a word begins there at the latest."""
        self.data, self.offsets = data, offsets
        inked, opens = marks if marks else (~gaps[data], None)
        edge = inked.copy()
        edge[1:] &= ~inked[:-1] if opens is None else ~inked[:-1] | opens[1:]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        edge[cuts] = inked[cuts]
        self.start = np.flatnonzero(edge)
        edge = inked.copy()
        edge[:-1] &= ~inked[1:] if opens is None else ~inked[1:] | opens[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        edge[lasts] = inked[lasts]
        self.end = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with ``lower``, of the word with A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, _U)
        sizes = self.end - self.start
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        within = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
        values = _CODES[seed, lower][self.data[within + np.repeat(self.start, sizes)]]
        values *= _powers(_BASES[seed], int(sizes.max()))[within]
        return mix(np.add.reduceat(values, begins) + sizes.astype(_U) * _U(_ODD))


def ngrams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """At i the hash of the n hashes from i on, by doubling; the last n - 1 entries are not meaningful."""
    mask = (1 << 64) - 1
    base, out, got = _BASES[seed] | 1, None, 0
    power, step, width = base, hashes, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, got = step.copy(), width
            else:  # out covers the first ``got`` words; what follows is the block of ``width`` words
                joined = out * _U(power)
                joined[: max(0, len(joined) - got)] += step[got:]
                out, got = joined, got + width
        left >>= 1
        if left:
            wider = step * _U(power)
            wider[: max(0, len(wider) - width)] += step[width:]
            step, width, power = wider, width * 2, power * power & mask
    return mix(out)


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Whether n words of one document begin at each word."""
    total = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left >= n


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """At i the least of ``width`` values from i on, by doubling; the last entries see fewer values."""
    out, got = values.copy(), 1
    while got < min(width, len(out)):
        step = min(got, width - got, len(out) - 1)
        if not step:
            break
        np.minimum(out[: len(out) - step], out[step:], out=out[: len(out) - step])
        got += step
    return out


def by_document(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for slices of a batch's text column."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(name)))
    for a, b in slices(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
