"""Graph preparation: cleaning, symmetry, renumbering, adjacency, blocks and partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import row_numbers, running_sum


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each, without loops."""
    e = without_loops(edges.select("src", "dst"))
    return e.union(e.select("dst", "src")).distinct()


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of either list, once each."""
    return a.select("src", "dst").union(b.select("src", "dst")).distinct()


def one_way(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is not there."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def completed(edges: DataFrame) -> DataFrame:
    """edges and what their one-way edges lack, in order."""
    missing = one_way(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(missing).orderBy("src", "dst")


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def relabelled(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges in the new ids of mapping (old, new)."""
    a, b = mapping.select(F.col("old").alias("src"), F.col("new").alias("s")), mapping.select(F.col("old").alias("dst"), F.col("new").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def first_seen_ids(edges: DataFrame, *order: str) -> DataFrame:
    """(old, new): dense ids in the order in which vertices first occur; the source of an edge comes before its target."""
    placed = row_numbers(edges, "_n", *(F.col(c) for c in order))
    ends = placed.select(F.col("src").alias("old"), (F.col("_n") * 2).alias("at")).union(placed.select("dst", F.col("_n") * 2 + 1))
    return row_numbers(ends.groupBy("old").agg(F.min("at").alias("at")), "new", F.col("at")).select("old", "new")


def adjacency(edges: DataFrame, n_vertices: int | None = None) -> DataFrame:
    """(src, deg, nbrs): sorted neighbours of each vertex. With n_vertices, vertices without any have a row too."""
    adj = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    if n_vertices is not None:
        adj = edges.sparkSession.range(n_vertices).toDF("src").join(adj, "src", "left").select("src", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))
    return adj.select("src", F.size("nbrs").alias("deg"), "nbrs")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"))


def offsets(adj: DataFrame) -> DataFrame:
    """(v, beg_pos): edges before each vertex, and a last row with all of them."""
    run = running_sum(adj.select(F.col("src").alias("v"), F.col("deg").cast("bigint").alias("deg")), F.col("deg"), "_to", F.col("v"))
    return run.select("v", (F.col("_to") - F.col("deg")).alias("beg_pos")).union(run.agg(F.max("v") + 1, F.coalesce(F.max("_to"), F.lit(0))))


def vertex_count(edges: DataFrame) -> DataFrame:
    """(n_vertices): the largest id and 1."""
    return edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("n_vertices"))


def distinct_vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def in_block(adj: DataFrame, start_v: int, end_v: int) -> DataFrame:
    """The rows of a block; the range reaches the scan."""
    return adj.where((F.col("src") >= start_v) & (F.col("src") < end_v))


def neighbours_of(adj: DataFrame, vertices: DataFrame, col: str = "v") -> DataFrame:
    """The adjacency rows that some vertices need: fetched by a semi-join on distinct ids."""
    return adj.join(vertices.select(F.col(col).alias("src")).distinct(), "src", "left_semi")


def random_starts(vertices: DataFrame, n: int, seed: int) -> DataFrame:
    """(source): n distinct vertices of the smallest hashes."""
    from ..functions.rng import u32

    return vertices.select(F.col("v").alias("source")).distinct().orderBy(u32(seed, F.col("source")), "source").limit(n)


def sequential_blocks(adj: DataFrame, capacity: int) -> DataFrame:
    """(block_id, start_v, end_v, n_edges): greedy ranges of vertices with at most capacity edges.

    A vertex with more than that is a block of its own. Degrees are sorted and summed up by ranges, in parallel. Each block's start
    depends on the one before, so the running sums, packed by batch, pass one task in order, which jumps from start to start
    by binary search and keeps a few numbers.
    """
    degrees_ = adj.select("src", F.col("deg").cast("bigint").alias("deg"))
    summed = running_sum(degrees_, F.col("deg"), "_to", F.col("src"), keep_range=True).select("_range", "src", "_to")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, v, to = (c.to_numpy() for c in b.columns)
            edges = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]])) if len(r) else [0]
            cuts = [slice(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(v[c][0]) for c in cuts], pa.int64()), *(pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (v, to))], ["first", "v", "to"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, start, before, seen, last, opened = 0, 0, 0, 0, -1, False
        for b in batches:
            out = []
            for v, to in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v, to = np.frombuffer(v, np.int64), np.frombuffer(to, np.int64)
                at = 0 if opened else 1  # a block holds its first vertex, whatever its degree
                opened = True
                while (j := max(at, int(np.searchsorted(to, before + capacity, "right")))) < len(v):
                    sum_ = int(to[j - 1]) if j else seen
                    out.append((block, start, int(v[j]), sum_ - before))
                    block, start, before, at = block + 1, int(v[j]), sum_, j + 1
                seen, last = int(to[-1]), int(v[-1])
            yield rows(out)
        if last >= 0:
            yield rows([(block, start, last + 1, seen - before)])

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["block_id", "start_v", "end_v", "n_edges"])

    parts = summed.mapInArrow(packed, "first long, v binary, to binary")
    return parts.repartition(1).sortWithinPartitions("first").mapInArrow(fold, "block_id int, start_v long, end_v long, n_edges long")


def capacity_of(blocksize_kb: int) -> int:
    """Edges of a block of that size: an edge takes four bytes."""
    return blocksize_kb * 1024 // 4


def default_block_kb(n_vertices: int, walks_per_vertex: int) -> int:
    return 1 << (10 + len(str(n_vertices * walks_per_vertex)))


def with_block(df: DataFrame, blocks: DataFrame, col: str, name: str = "block_id") -> DataFrame:
    """df with the block of a vertex column.

    Ids are cut into cells of one width, about as many as there are blocks; a block has a row for each cell that it touches, so
    the range lookup is an equality join on the cell and a check of the range.
    """
    span, n = blocks.agg(F.max("end_v"), F.count(F.lit(1))).first()
    width = max(1, -(-(span or 0) // max(n, 1)))
    cells = blocks.select(F.col("start_v").alias("_s"), F.col("end_v").alias("_e"), F.col("block_id").alias(name), F.explode(F.expr(f"sequence(start_v div {width}L, (end_v - 1) div {width}L)")).alias("_cell"))
    return df.withColumn("_cell", F.expr(f"`{col}` div {width}L")).join(cells, "_cell").where((F.col(col) >= F.col("_s")) & (F.col(col) < F.col("_e"))).drop("_cell", "_s", "_e")


def by_partition(parts: DataFrame) -> DataFrame:
    """(old, new): ids by partition and then by old id, from parts (vertex, block_id)."""
    return row_numbers(parts, "new", F.col("block_id"), F.col("vertex")).select(F.col("vertex").alias("old"), "new")


def snake_partition(degree: DataFrame, n_blocks: int) -> DataFrame:
    """(v, block_id, new_id): vertices by falling degree dealt to blocks 0 .. B-1, B-1 .. 0 and so on, then numbered by block."""
    dealt = row_numbers(degree, "_rn", F.desc("deg"), F.col("v"))
    r = F.pmod(F.col("_rn"), F.lit(2 * n_blocks))
    block = F.when(r < n_blocks, r).otherwise(2 * n_blocks - 1 - r).cast("int")
    return row_numbers(dealt.withColumn("block_id", block), "new_id", F.col("block_id"), F.col("_rn")).select("v", "block_id", "new_id")


def hot_vertices(degree: DataFrame, capacity: int) -> DataFrame:
    """(v, deg): vertices of the highest degrees until their sum first passes capacity, that vertex included."""
    run = running_sum(degree.select("v", "deg"), F.col("deg"), "_to", F.desc("deg"), F.col("v"))
    return run.where(F.col("_to") - F.col("deg") <= capacity).select("v", "deg")


def neighbour_domains(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, other_block, v): vertices of a block by the blocks that their neighbours are in."""
    both = with_block(with_block(edges, blocks, "src"), blocks, "dst", "other_block")
    return both.select("block_id", "other_block", F.col("src").alias("v")).distinct()


def by_degree(degree: DataFrame) -> DataFrame:
    return degree.orderBy(F.desc("deg"), "v")


def ranked(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n rows of the largest values with their rank from 1; only n rows of each task move."""
    top = df.orderBy(F.desc(value), *ties).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(value), *ties)))
