"""Whole texts as numpy arrays: blocks of an Arrow batch, word bounds, word hashes and shingle sets.

Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased. All functions work on a
block of many documents at once; a block holds about ``BLOCK_BYTES`` of text, or one longer document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: arrays of 64-bit hashes take some ten to twenty times as much.
BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch between Spark and a worker, where the session keeps the default of 10,000.
BATCH_ROWS = 2000

# An odd base for polynomial hashes and the multipliers of the splitmix64 finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
STEP = 0xD6E8FEB86659FD93

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of polynomial hashes, and of its inverse."""
    return _power(BASE, "base", n), _power(_INVERSE, "inverse", n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def free_name(base: str, columns: list[str]) -> str:
    """A column name that none of these is, whatever their case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def bounded_batches(spark) -> None:
    """Sets smaller Arrow batches for whole texts, unless the session sets a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def trimmed(run: Callable, *clear: Callable[[], None]) -> Callable:
    """``run`` over a task's batches; at its end, or failure, caches are cleared and freed memory goes back to the system.

    Workers wait idle for further tasks, and an executor's memory has to hold them beside Spark and each other.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for done in clear:
                done()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return whole


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with about ``limit`` bytes of text; no row is split or left out."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (with the total last)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[offsets < n]
    before[edge] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word: a polynomial over its bytes from prefix sums, then mixed."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = (LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(BASE, "base", n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, "inverse", n + 1)[starts])


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of each text, with repeats, and each text's offsets into them.

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    bounds = np.zeros(len(n_words) + 1, dtype=np.int64)
    np.cumsum(n_shingles, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], n_shingles)  # word index of each shingle's start
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    out = padded[at]
    short = np.repeat(n_words < k, n_shingles)
    end = np.repeat(first[1:], n_shingles)
    for j in range(1, k):
        part = padded[at + j] * np.uint64(pow(STEP, j, 1 << 64))
        out += np.where(short & (at + j >= end), np.uint64(0), part) if short.any() else part
    return mix(out), bounds


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each group in ascending order, and the new bounds."""
    sizes = np.diff(bounds)
    v = values.copy()
    for i in np.flatnonzero(sizes > 1):
        v[bounds[i] : bounds[i + 1]].sort()
    g = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = v[1:] != v[:-1]
    keep[bounds[:-1][sizes > 0]] = True
    v, g = v[keep], g[keep]
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(np.bincount(g, minlength=len(sizes)), out=out[1:])
    return v, out


def ragged(values: pa.Array | np.ndarray, bounds: np.ndarray) -> pa.LargeListArray | pa.ListArray:
    """Consecutive runs of ``values`` as one list per row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
