"""Vectorised word and shingle hashing over Arrow text batches.

Words are maximal runs outside the six ASCII white-space bytes, so a
word boundary never falls inside a UTF-8 character. All functions work on
pieces of a few MB, so memory does not follow the batch or text size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
WINDOW = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; only those of about a piece are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, WINDOW + 1)
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    found = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    if size <= PIECE + 64:
        _POWERS[:] = found
    return found[0], found[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; starts ascending, spans not nested."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + WINDOW)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


@dataclass
class Words:
    """Words of the rows first .. first+rows of a batch: row i has first_word[i] .. first_word[i+1]."""

    first: int
    data: np.ndarray
    row_start: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.row_start) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and row offsets into it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()) if not pa.types.is_binary(column.type) else column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def words_of(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    data, at = text_bytes(column)
    for lo, hi in pieces(data, at):
        part, row = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        space = SPACE[part]
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        edges = row[(row > 0) & (row < len(part))]
        before[edges], after[edges - 1] = True, True
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        yield Words(lo, LOWER[part] if lower else part, row, starts, ends, np.searchsorted(starts, row))


SALTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles of one row's word
    hashes; with fewer words the whole sequence is one; none without words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    m = min(n, width)
    total = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        total += hashes[i : n - m + 1 + i] * SALTS[i % 64]
    return np.unique(mix(total))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a text column."""
    for w in words_of(column):
        hashes = hash_spans(w.data, w.starts, w.ends)
        for i in range(w.rows):
            yield w.first + i, shingles(hashes[w.first_word[i] : w.first_word[i + 1]], width)
