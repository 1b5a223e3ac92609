"""Shared parts of the training-data operators: a vectorised text kernel over Arrow buffers, materialising
intermediate tables, and connected components.

The kernel works on the UTF-8 bytes of an Arrow string column without making Python strings: one flat byte
array and document offsets. A block holds whole documents of about ``BLOCK_BYTES`` together (one document at least): small
ones keep the arrays of a block, some tens of times its bytes, out of an executor's way and in a processor's cache.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written

BLOCK_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
#: A random odd 64-bit value for each byte, and one for each place in a tuple of hashes.
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 2**62)) * 4 + 1
INVERSE = pow(BASE, -1, 1 << 64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOW = 12
_letters: list[np.ndarray] = []


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 2 for a letter, 1 for a mark, 0 for the rest; and its lower case if that is one code point."""
    if not _letters:
        kind = np.zeros(0x110000, np.int8)
        lower = np.arange(0x110000, dtype=np.uint32)
        # Of the planes beyond the third one, 0xE has marks (variation selectors) and no letters, the others have neither.
        for c in chain(range(0x40000), range(0xE0000, 0xE1000)):
            ch = chr(c)
            kind[c] = {"L": 2, "M": 1}.get(unicodedata.category(ch)[0], 0)
            if kind[c] and len(low := ch.lower()) == 1:
                lower[c] = ord(low)
        _letters.extend((kind, lower))
    return _letters[0], _letters[1]



def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_pow_low, _ipow_low = _powers(BASE, 1 << _LOW), _powers(INVERSE, 1 << _LOW)
_high: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _high_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    m = 1 << max(10, int(n >> _LOW).bit_length())
    if m not in _high:
        _high[m] = _powers(pow(BASE, 1 << _LOW, 1 << 64), m), _powers(pow(INVERSE, 1 << _LOW, 1 << 64), m)
    return _high[m]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Prefix:
    """Polynomial prefix hashes of a byte array: the hash of any stretch in constant time."""

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None):
        n = len(data)
        high = _high_powers(n)[0]
        codes = BYTE_CODES if fold is None else BYTE_CODES[fold]
        x = codes[data]
        x *= np.multiply.outer(high[: (n >> _LOW) + 1], _pow_low).ravel()[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high = _high_powers(len(self.sums))[1]
        h = self.sums[end] - self.sums[start]
        h *= high[start >> _LOW] * _ipow_low[start & ((1 << _LOW) - 1)]
        return mix(h + (end - start).astype(np.uint64))


def give_back() -> None:
    """Memory that is free but still held by this process, to the system: what a worker keeps after a task is then small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema); a worker's unused memory is given back before a task, when what the last one sent is gone, and after it."""

    def tidy(batches):
        give_back()
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for stretches of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each document the number of words before it (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = space[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def tuples(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive values (the last k-1 places have none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    t = h[:n] * PLACE[0]
    for i in range(1, k):
        t += h[i : i + n] * PLACE[i]
    return mix(t)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, ... for each i in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    full = np.flatnonzero(length)
    s, n = start[full].astype(np.int64), length[full].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    step[first] = s - np.concatenate([[0], s[:-1] + n[:-1] - 1])
    return np.cumsum(step)


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow binary array whose i-th row holds the next counts[i] items of values."""
    off = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    kind, wide = (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(off.astype(wide)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node reachable.

    Alternates large-star and small-star rounds, each written to the shared folder, until no edge changes. The
    number of rounds grows with the logarithm of the longest path; edges never outnumber those at the start.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(limit):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select("v", "m").where("v <> m").toDF("u", "v").union(lower.toDF("u", "v")).distinct()
        edges = written(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
