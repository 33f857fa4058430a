"""Word hashes of a batch of texts, computed on the batch's bytes.

Words are the runs between blanks (0x20, 0x09 to 0x0D), with A-Z lower-cased. A word's 64-bit
hash is its polynomial over the bytes modulo 2**64, taken from one running sum over the
buffer and mixed at the end, so the cost is a few array passes and no object per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15  # any large odd number
SLICE = 1 << 18
WORD_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64 for i below n."""

    def run(x: int) -> np.ndarray:
        out = np.full(n, x, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null reads as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _cut(buf: np.ndarray, offsets: np.ndarray, start: int) -> int:
    """End of the slice from ``start``: a row's end or just after a blank, SLICE bytes on
    if there is one before that, else the first one after it."""
    end = start + SLICE
    if end >= len(buf):
        return len(buf)
    row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
    if row > start:
        return row
    blanks = np.flatnonzero(BLANKS[buf[start:end]])
    if len(blanks):
        return start + int(blanks[-1]) + 1
    row_end = int(offsets[np.searchsorted(offsets, end)])
    while end < row_end:
        blanks = np.flatnonzero(BLANKS[buf[end : end + SLICE]])
        if len(blanks):
            return min(row_end, end + int(blanks[0]) + 1)
        end += SLICE
    return row_end


def hash_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the index of each row's first word (and the end)."""
    hashes, starts_at = [], []
    start = 0
    while start < len(buf):
        end = _cut(buf, offsets, start)
        part = LOWER[buf[start:end]]
        word = ~BLANKS[part]
        edge = np.zeros(len(part) + 1, bool)
        rows = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, end)] - start
        edge[rows] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        size = SLICE
        while size < len(part):
            size *= 2
        powers, inverse = _powers(size)
        sums = np.cumsum(part * powers[: len(part)], dtype=U64)
        value = sums[last] - np.where(first > 0, sums[first - 1], U64(0))
        value = value * inverse[first]
        hashes.append(mix(value + (last - first + 1).astype(U64) * WORD_LENGTH))
        starts_at.append(first + start)
        start = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of fewer words, the whole sequence."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    value = np.full(n - width + 1, U64(width))
    for i in range(width):
        value = value * U64(BASE) + hashes[i : n - width + 1 + i]
    return np.unique(mix(value))
