"""Hashed words and word shingles of whole Arrow batches, computed on the bytes of all texts at once.

A word's hash is a polynomial in its bytes modulo 2^64, taken from running sums and then mixed; a shingle's hash mixes
the hashes of its words in order. Hashes have 64 bits, so different shingles of one text are told apart but for a
chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
# Bytes of text that are handled at once; one longer text is handled alone.
CHUNK = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, np.uint64(base), dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(CHUNK, 1 << max(n, 1).bit_length()) + 1)[: n + 1]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that are at most CHUNK bytes, or one row. Null texts are empty."""
    column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = max(last, first + 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (one more entry at the end)."""
    inside = _IN_WORD[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts_text = offsets[:-1][offsets[:-1] < len(data)]
    before[starts_text] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends_text = offsets[1:] - 1
    after[ends_text[ends_text >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[:-1], out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts]
    return mix(value ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text's words; a shorter text is one shingle, no words have none."""
    n = len(words)
    if n == 0:
        return words
    span = min(n, size)
    total = np.full(n - span + 1, np.uint64(span), dtype=np.uint64)
    for k in range(span):
        total = total * _BASE + words[k : n - span + 1 + k]
    return mix(total)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a batch."""
    for first, data, offsets in text_chunks(column):
        words, borders = word_hashes(data, offsets)
        for row in range(len(offsets) - 1):
            yield first + row, np.unique(shingle_hashes(words[borders[row] : borders[row + 1]]))
