"""Vectorised words of Arrow text columns.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D.
Whole texts are read in pieces of about ``PIECE`` bytes that never split a
document, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
#: Odd multipliers of the polynomial hashes modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit of 64-bit values over all others, one to one."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def window_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i, and the inverse powers that make a window's sum independent of its place."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return sums, powers(pow(base, -1, 1 << 64), n + 1)


def text_column(column) -> pa.Array:
    """One chunk of large_string without nulls; null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(column, limit: int = PIECE):
    """(first row, row bounds in bytes from 0, bytes) of consecutive rows with about ``limit`` bytes."""
    column = text_column(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        bounds = offsets[row : end + 1]
        yield row, bounds - bounds[0], data[bounds[0] : bounds[-1]]
        row = end


_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the first word of each row (one more at the end). space: for each byte, whether it parts words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z if ``lower``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = (_lower[data] if lower else data).astype(np.uint64) + np.uint64(1)
    sums, back = window_sums(values, BYTE_BASE)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, by its first word; runs may cross rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums, back = window_sums(words, WORD_BASE)
    return mix((sums[n:] - sums[:-n]) * back[: len(words) - n + 1])
