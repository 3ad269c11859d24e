"""Texts of an Arrow column as one byte block, with words and rolling hashes taken by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for many ranges, from one running sum."""
    up, down = _power_table(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; NULL counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    block = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return block, bounds - bounds[0]


def words(block: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more entry at the end)."""
    n = len(block)
    blank = BLANK[block]
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    after = np.ones(n, bool)
    after[:-1] = blank[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def row_numbers(first: np.ndarray) -> np.ndarray:
    """The row of each item, given the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def slabs(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts take about ``most_bytes``; a longer text stays whole in a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = (np.cumsum(sizes) - sizes) // most_bytes
        cuts = np.flatnonzero(np.diff(groups, prepend=-1)) if len(groups) else np.zeros(0, np.int64)
        for start, end in zip(cuts, [*cuts[1:], len(sizes)]):
            yield batch.slice(start, end - start)


def pick(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the leftmost smallest value of at least one window of ``width`` values (sorted, distinct).

    Two equal windows pick the same place, so equal stretches of at least one window share a picked position.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.unique(window_minima(values, width))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window start, the position of the window's leftmost smallest value, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64)
    low = values
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = low[:len(low) - step], low[step:]
        later = right < left
        low = np.where(later, right, left)
        at = np.where(later, at[step:], at[:len(at) - step])
        span += step
    return at[:n]
