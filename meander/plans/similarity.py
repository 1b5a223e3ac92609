"""Sums of the link-similarity steps that follow each edge, without bringing the steps together.

The steps of a graph are the sum of its squared degrees: too many to deal out by their ends, which the count of common neighbours asks for. Here a block is a range
of previous vertices with a bounded number of steps, and each list of neighbours goes to a block once, however many vertices of the block it
holds, as gaps and degrees. A block then has every path of two edges from its vertices and counts, weighs and sums them up in memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import SCALE
from ..operators.graph import sequential_blocks
from ..sources.tables import written
from .config import WalkConfig
from .walks import transitions

#: Steps of a block: they bound the entries of its lists, so its memory.
BLOCK_STEPS = 1 << 22
#: Steps that are weighed at a time.
AT_ONCE = 1 << 18
DEALT = "block int, v binary, n binary, first binary, gap binary, deg binary"
SUMS = "prev long, cur long, n_next long, w_sum long, w_next long, top_prob double, ratio_sum double"


def linkscan_sums(adj: DataFrame, block_steps: int = BLOCK_STEPS, at_once: int = AT_ONCE) -> DataFrame:
    """(prev, cur, n_next, w_sum, w_next, top_prob, ratio_sum) for each edge: how many steps follow it, the sums of w, w * next and ratio, and the largest prob, as walks.transitions has them for linkscan.

    A vertex with more than block_steps steps fits no block. Its steps are brought together by their ends, as transitions does it.
    """
    _shuffles_gone(adj)
    near = adj.select(F.explode("nbrs").alias("v"), F.struct(F.col("src").alias("x"), F.col("deg").cast("bigint").alias("d")).alias("e")).groupBy("v").agg(F.sort_array(F.collect_list("e")).alias("e"))
    lists = written(near.select(F.col("v").alias("src"), F.aggregate("e", F.lit(0).cast("bigint"), lambda t, e: t + e["d"]).alias("steps"), F.col("e.x").alias("nbrs"), F.col("e.d").alias("degs")))
    _shuffles_gone(adj)
    least = lists.agg(F.min("src")).first()[0]
    if least is None:
        return adj.sparkSession.createDataFrame([], SUMS)
    blocks = sequential_blocks(lists.select((F.col("src") - least).alias("src"), F.col("steps").alias("deg")), block_steps).orderBy("block_id").collect()
    starts, ends = (np.array([b[c] for b in blocks], np.int64) + least for c in ("start_v", "end_v"))
    fits = np.array([b.n_edges <= block_steps for b in blocks])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _dealt(b, starts, fits)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for block, own in groupby(rows, lambda r: r[0]):
            yield from _sums([[_unpacked(x) for x in r[1:]] for r in own], starts[block], ends[block], at_once)

    dealt = lists.select("src", "nbrs", "degs").mapInArrow(deal, DEALT)
    out = dealt.repartition(len(blocks), "block").sortWithinPartitions("block").mapInArrow(sums, SUMS)
    if fits.all():
        return out
    w = F.col("w")
    heavy = transitions(adj, "linkscan", WalkConfig(), lists.where(F.col("steps") > block_steps).select(F.col("src").alias("v")))
    return out.union(heavy.groupBy("prev", "cur").agg(F.count(F.lit(1)), F.sum(w), F.sum(w * F.col("next")), F.max("prob"), F.sum("ratio")))


def _shuffles_gone(df: DataFrame) -> None:
    """Shuffle files of earlier tables go when the driver collects its garbage: now, not when it happens to."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers from their least one, in as few bytes as the largest needs, by place of the byte."""
    base = int(a.min()) if len(a) else 0
    a = (a - base).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or int(a.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return struct.pack("<bqq", width, base, len(a)) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    width, base, n = struct.unpack_from("<bqq", x)
    planes = np.frombuffer(pa.decompress(x[17:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64) + base


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _dealt(b: pa.RecordBatch, starts: np.ndarray, fits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The lists (src, nbrs, degs) of a batch, packed by the blocks that their members are in."""
    v, x, d = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
    n = b.column(1).value_lengths().to_numpy().astype(np.int64)
    if not len(x):
        return
    at, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    block = np.searchsorted(starts, x, "right") - 1
    # Members are sorted, so those in one block follow each other.
    new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (of[1:] != of[:-1])]) & fits[block])
    new = new[np.argsort(block[new], kind="stable")]
    if not len(new):
        return
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(block[new]) != 0, [True]]))
    gap = np.diff(x, prepend=0)
    gap[at] = 0
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = of[new[i:j]]
        take = _ranges(at[own], n[own])
        packed = [_packed(a) for a in (v[own], n[own], x[at[own]], gap[take], d[take])]
        yield pa.RecordBatch.from_arrays([pa.array([int(block[new[i]])], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], ["block", "v", "n", "first", "gap", "deg"])


def _sums(parts: list[list[np.ndarray]], start: int, end: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """The sums for the edges (prev, cur) with prev in start .. end-1, from the lists of all their neighbours."""
    v, n, first, x, deg = (np.concatenate(a) for a in zip(*parts, strict=True))
    parts.clear()
    at = np.cumsum(n) - n
    x = np.cumsum(x)
    x += np.repeat(first - x[at], n)
    own = np.flatnonzero((x >= start) & (x < end))
    of = np.searchsorted(at, own, "right") - 1
    order = np.lexsort((v[of], x[own]))
    own, of = own[order], of[order]
    prev, cur, prev_deg, cur_deg = x[own], v[of], deg[own], n[of]
    ids, place = np.unique(x, return_inverse=True)
    upto = np.cumsum(cur_deg)
    firsts = np.flatnonzero(np.concatenate([[True], prev[1:] != prev[:-1]]))  # edges where a previous vertex begins
    lasts = np.append(firsts[1:], len(prev))
    k = 0
    while k < len(firsts):
        z = max(k + 1, int(np.searchsorted(upto[lasts - 1], (upto[firsts[k] - 1] if k else 0) + at_once, "right")))
        e = slice(firsts[k], lasts[z - 1])
        m = cur_deg[e]
        take = _ranges(at[of[e]], m)
        row = np.cumsum(np.concatenate([[0], prev[e][1:] != prev[e][:-1]]))
        key = np.repeat(row * len(ids), m) + place[take]
        if (z - k) * len(ids) <= 8 * len(key):
            common = np.bincount(key)[key]
        else:
            _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
            common = counts[where]
        to = x[take]
        whole = 2 + np.repeat(prev_deg[e], m) + deg[take] - common
        ratio = common / whole
        w = np.floor(common * float(SCALE) / whole).astype(np.int64)
        back = np.flatnonzero(to == np.repeat(prev[e], m))
        w[back] = ratio[back] = np.repeat(m == 1, m)[back]
        begin = np.cumsum(m) - m
        total = np.add.reduceat(w, begin)
        if int(np.abs(to).max()) * int(total.max()) >= 1 << 63:
            raise OverflowError("the sum of w * next does not fit 64 bits")
        top = np.divide(np.maximum.reduceat(w, begin), total, out=np.zeros(len(m)), where=total > 0)
        sums = (prev[e], cur[e], m, total, np.add.reduceat(w * to, begin), pa.array(top, pa.float64(), mask=total == 0), np.add.reduceat(ratio, begin))
        yield pa.RecordBatch.from_arrays([pa.array(s) for s in sums], ["prev", "cur", "n_next", "w_sum", "w_next", "top_prob", "ratio_sum"])
        k = z
