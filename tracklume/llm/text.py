"""Words of many texts at once: byte arrays instead of one Python string per word.

The functions work on one Arrow batch inside a task.  A batch is taken in blocks of a few megabytes, so memory does
not depend on how many rows Spark puts into a batch; only a single very long text makes a larger block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: the six white-space bytes that separate words
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLACES = {"table": np.zeros(0, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
BYTE_VALUES[WHITE] = 0
#: the same, with A-Z as a-z
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
#: all ASCII but letters and digits, for words without punctuation
MARKS = np.ones(256, bool)
MARKS[128:] = MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
PLAIN_VALUES = np.where(MARKS, np.uint64(0), LOWER_VALUES)
#: for spans that may hold white space
ALL_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def place_values(n: int) -> np.ndarray:
    """A fixed pseudo-random odd number for each place of a span.

    A hash is the sum of values times the numbers of their places.  Powers of one number would not do: modulo
    ``2 ** 64`` they have a structure by which some long strings of two letters collide whatever the values are.
    """
    if len(_PLACES["table"]) < n:
        _PLACES["table"] = mix(np.arange(1, max(n, 1024, 2 * len(_PLACES["table"])) + 1, dtype=np.uint64) * _MULTIPLIER + np.uint64(7)) | np.uint64(1)
    return _PLACES["table"]


def return_memory() -> None:
    """Give freed memory back to the system, as workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    return_memory()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and where each begins (one more entry than texts); null is empty."""
    column = pc.fill_null(column, pa.scalar("", column.type))
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word, and the number of words before each text (and of all)."""
    inside = ~gap[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    at = borders[borders < len(data)]
    first[at] = inside[at]
    at = borders[borders > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span ``[starts[i], starts[i + 1])``; bytes whose value is 0 do not count at its end."""
    out = np.empty(len(starts), np.uint64)
    bounds = np.append(starts, len(data))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        to = min(to, len(starts))
        begin, end = bounds[at], bounds[to]
        here = bounds[at:to] - begin
        inner = np.arange(end - begin) - np.repeat(here, np.diff(bounds[at : to + 1]))
        terms = values[data[begin:end]] * place_values(int(inner.max()) + 1)[inner]
        out[at:to] = np.add.reduceat(terms, here)
        at = to
    return mix(out)


def word_hashes(column: pa.Array, lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a column, and the number of words before each text (and of all).

    ``lower``: A-Z as a-z; ``plain``: also without ASCII punctuation, which separates words like white space.
    """
    data, offsets = flat(column)
    starts, _, before = word_bounds(data, offsets, MARKS if plain else WHITE)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    return span_hashes(data, starts, PLAIN_VALUES if plain else LOWER_VALUES if lower else BYTE_VALUES), before


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries: entry i covers ``words[i : i + size]``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, value in enumerate(place_values(size)[:size]):
        out += words[i : i + n] * value
    return mix(out)
