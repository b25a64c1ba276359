"""Vectorised word scanning over Arrow string columns.

One pass of NumPy over the UTF-8 bytes of a chunk of documents finds the words;
each word and each run of consecutive words gets a 64-bit hash. The hashes only
find candidates: what they are equal for is compared before anything depends on it.
Nothing here depends on Spark; operators call it from ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned together; the arrays of a scan are some forty times as large.
CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word under ``[^\\x20\\x09-\\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of a word under ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 byte offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


class Words:
    """Words of a chunk: byte ranges ``start``/``end`` and the word range ``first[i]:first[i+1]`` of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        inside = letters[self.data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        filled = offsets[:-1][offsets[:-1] < len(data)]
        before[filled] = False
        after = np.empty_like(inside)
        if len(inside):
            after[:-1] = inside[1:]
            after[-1] = False
            ends = offsets[1:][offsets[1:] > 0] - 1
            after[ends] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a sum of mixed numbers of byte and place, so that no order of letters cancels out."""
        place = np.zeros(len(self.data), np.int64)
        place[self.start] = self.start
        place = np.arange(len(self.data)) - np.maximum.accumulate(place) if len(place) else place
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(mix((place.astype(np.uint64) << np.uint64(8)) + self.data + np.uint64(1)), out=sums[1:])
        return mix(sums[self.end] - sums[self.start] + (self.end - self.start).astype(np.uint64))

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """The words, each with one space after it, and where each begins in that; n+1 places."""
        size = self.end - self.start + 1
        at = np.zeros(len(self) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        packed = np.full(at[-1], 32, np.uint8)
        source = np.repeat(self.start - at[:-1], size) + np.arange(at[-1])
        letters = np.ones(at[-1], bool)
        letters[at[1:] - 1] = False
        packed[letters] = self.data[source[letters]]
        return packed.tobytes(), at

    def docs(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def run_starts(self, length: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and word count of each run of ``length`` words; with ``whole``, a shorter non-empty text is one run."""
        counts = np.diff(self.first)
        starts = np.arange(len(self))
        left = np.repeat(self.first[1:], counts) - starts
        keep = left >= length
        size = np.full(len(self), length, np.int64)
        if whole:
            short = (np.repeat(counts, counts) < length) & (starts == np.repeat(self.first[:-1], counts))
            size[short] = left[short]
            keep |= short
        return starts[keep], size[keep]


def run_hashes(word_hash: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """A 64-bit hash of each run of words, from the hashes of the words, taken in one after the other."""
    size = np.broadcast_to(np.asarray(size, np.int64), np.shape(start))
    out = mix(size.astype(np.uint64))
    least = int(size.min()) if len(size) else 0
    for k in range(int(size.max(initial=0))):
        on = slice(None) if k < least else np.flatnonzero(size > k)
        value = (out[on] ^ word_hash[start[on] + k]) * np.uint64(_BASE)
        out[on] = value ^ (value >> np.uint64(29))
    return mix(out)


def mix(value: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    value = value ^ (value >> np.uint64(32))
    for _ in range(2):
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
    return value


_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES) + 1, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _TABLES[base] = have
    return have[:n]


def powers(n: int) -> np.ndarray:
    return _table(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _table(pow(_BASE, -1, 1 << 64), n)


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a per-word array over the word ranges of the documents."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
