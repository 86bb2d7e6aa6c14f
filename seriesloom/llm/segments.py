"""Texts of any length as byte segments, cut inside a row where a caller allows it.

A segment holds several whole rows, or a part of one long row that ends after
one of the allowed bytes, so memory follows `most` and the longest stretch
without such a byte, not the longest text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import PIECE, pieces, text_bytes


def table_of(members: bytes) -> np.ndarray:
    """Which of the 256 bytes are members."""
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


def cuts(data: np.ndarray, lo: int, hi: int, allowed: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of data[lo:hi] of about `most` bytes, each ending after an allowed byte or at `hi`."""
    while hi - lo > most:
        inside = np.flatnonzero(allowed[data[lo : lo + most]])
        end, look = (lo + int(inside[-1]) + 1 if len(inside) else hi), lo + most
        while not len(inside) and look < hi:
            inside = np.flatnonzero(allowed[data[look : min(look + most, hi)]])
            end, look = (look + int(inside[0]) + 1 if len(inside) else hi), look + most
        yield lo, end
        lo = end
    if hi > lo:
        yield lo, hi


def segments(column: pa.Array, allowed: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, row offsets into them); a long row comes as several segments of one row."""
    data, at = text_bytes(column)
    for lo, hi in pieces(data, at, most):
        if hi - lo > 1 or at[hi] - at[lo] <= most:
            yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            continue
        for a, b in cuts(data, int(at[lo]), int(at[hi]), allowed, most):
            yield lo, hi, data[a:b], np.array([0, b - a])


def runs_of(inside: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes, none of which crosses a row."""
    before, after = np.ones(len(inside), bool), np.ones(len(inside), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    edges = row[(row > 0) & (row < len(inside))]
    before[edges], after[edges - 1] = True, True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
