"""Texts as bytes: the vectorised helpers that the Python operators share.

A column of texts is handled as one byte array with row offsets, a few
megabytes at a time; a single longer text is a piece of its own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once. Working arrays take about 40 times as much.
CHUNK_BYTES = 1_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def whole(text: Column) -> Column:
    """The text; a null is an empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins (one entry more
    than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes, or of one row."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(rows, max(begin + 1, end))
        yield begin, end
        begin = end


def mixed(values: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads similar ones."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of any spans of one byte array, from sums of its prefixes."""

    _VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._VALUES[data] * Spans._powers[: len(data)], out=self._sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            n = max(n, CHUNK_BYTES + 1)
            steps = np.full(n, _MULTIPLIER, np.uint64)
            steps[0] = 1
            Spans._powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = _INVERSE
            Spans._inverses = np.cumprod(steps, dtype=np.uint64)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the bytes from each start up to its end; equal bytes have equal hashes."""
        found = (self._sums[ends] - self._sums[starts]) * Spans._inverses[starts]
        return mixed(found + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of marked bytes that stay in one row."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    starts = np.flatnonzero(inside & (~before | first[:n]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` neighbours, where its smallest value is
    (the last of equal ones)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # windows of doubling width, then two that overlap
    reach = 1
    best, at = values.copy(), np.arange(len(values))
    while reach * 2 <= width:
        take = best[reach:] <= best[: len(best) - reach]
        at = np.where(take, at[reach:], at[: len(at) - reach])
        best = np.where(take, best[reach:], best[: len(best) - reach])
        reach *= 2
    if reach < width:
        step = width - reach
        take = best[step:] <= best[: len(best) - step]
        at = np.where(take, at[step:], at[: len(at) - step])
    return at[:n]
