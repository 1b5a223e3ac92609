"""Sinks: edge lists, partitioner input, adjacency tables, block and activity logs, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import row_numbers


def edge_lines(edges: DataFrame, sep: str = " ") -> DataFrame:
    return edges.orderBy("src", "dst").select(F.concat_ws(sep, "src", "dst").alias("value"))


def write_edges(edges: DataFrame, path: str, sep: str = " ") -> None:
    edge_lines(edges, sep).write.text(path)


def metis_lines(adj: DataFrame) -> DataFrame:
    """(line_no, line): a header of vertices and undirected edges, then the neighbours of each vertex, counted from 1.

    adj has a row for each vertex from 0 on, also for those without neighbours; they give an empty line.
    """
    head = adj.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("deg"), F.lit(0)).alias("e"))
    header = head.select(F.lit(0).cast("bigint").alias("line_no"), F.concat_ws("\t", "v", F.floor(F.col("e") / 2)).alias("line"))
    return header.union(adj.select(F.col("src") + 1, F.array_join(F.transform("nbrs", lambda x: (x + 1).cast("string")), " ")))


def write_metis(adj: DataFrame, path: str) -> None:
    metis_lines(adj).orderBy("line_no").select("line").write.text(path)


def write_adjacency(adj: DataFrame, path: str) -> None:
    """Sorted by vertex within files, so a range of vertices reads few row groups."""
    adj.repartitionByRange("src").sortWithinPartitions("src").write.parquet(path)


def _number_lines(rows: DataFrame, value: str, path: str, *order: str) -> None:
    rows.orderBy(*order).select(F.col(value).cast("string").alias("value")).write.text(path)


def write_block_starts(blocks: DataFrame, path: str) -> None:
    """A line for each start of a block and one for the end of the last: the files of block ranges."""
    ends = blocks.agg(F.max("end_v").alias("v"))
    _number_lines(blocks.select(F.col("start_v").alias("v")).union(ends), "v", path, "v")


def write_partition(parts: DataFrame, path: str) -> None:
    """The block of each vertex of (vertex, block_id), a line each; vertices are numbered from 0 without gaps."""
    _number_lines(parts, "block_id", path, "vertex")


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    """The threshold of each block of (block_id, ths), a line each."""
    _number_lines(thresholds, "ths", path, "block_id")


def write_pair_thresholds(thresholds: DataFrame, path: str) -> None:
    """The thresholds of (block_id, other_block, ths), other_block < block_id: for each block from 1 on a line for each smaller one."""
    _number_lines(thresholds, "ths", path, "block_id", "other_block")


def write_starts(starts: DataFrame, path: str) -> None:
    """The sources of (position, source), a line each."""
    _number_lines(starts, "source", path, "position")


def write_facts(adj: DataFrame, vertices_path: str, degree_path: str) -> None:
    """The number of vertices (largest id and 1) and the largest degree, each a file of one line."""
    adj.agg((F.max("src") + 1).cast("string").alias("value")).write.text(vertices_path)
    adj.agg(F.max("deg").cast("string").alias("value")).write.text(degree_path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Any flat table, with a header."""
    rows.write.csv(path, header=True)


def write_block_log(log: DataFrame, path: str) -> None:
    """(block_id, other_block, nverts, nedges, nwalks, load_time, exec_time) as a block log with the header that its readers know; without other_block a log of static blocks."""
    pairs = "other_block" in log.columns
    names = {"dynamic-block-id" if pairs else "static-block-id": "block_id"} | ({"static-block-id": "other_block"} if pairs else {}) | {"nverts": "nverts", "nedges": "nedges", "nwalks": "nwalks", "load-block-time": "load_time", "exec-block-time": "exec_time"}
    write_csv(log.select(*(F.col(c).alias(n) for n, c in names.items())), path)


def write_use_log(activity: DataFrame, path: str, how: str = "edges") -> None:
    """Activity rows (step, block_id, activated, used_edges, total_vertices, total_edges) as a log of block loads, in the order of step and block.

    how: edges for used and loaded edges, vertices for activated and all vertices. A block that walks leave from in a step is one load.
    """
    used, total = {"edges": (("Used Edges", "used_edges"), ("Total Load Edges", "total_edges")), "vertices": (("Activated Vertices", "activated"), ("Total Vertices", "total_vertices"))}[how]
    numbered = row_numbers(activity, "n", F.col("step"), F.col("block_id")).orderBy("n")
    write_csv(numbered.select(F.col("n").alias("IO Num"), F.col("block_id").alias("Block Id"), F.lit("static-block").alias("Block Type"), *(F.col(c).alias(n) for n, c in (used, total))), path)


def write_metrics(metrics: DataFrame, path: str, how: str = "csv") -> None:
    """Running statistics by key as csv (with a header), json, key=value lines (text), a html table or nothing (null)."""
    if how == "csv":
        metrics.write.csv(path, header=True)
    elif how == "json":
        metrics.write.json(path)
    elif how == "text":
        pairs = [F.concat(F.concat_ws(".", "key", F.lit(c)), F.lit("="), F.col(c).cast("string")) for c in metrics.columns if c != "key"]
        metrics.select(F.explode(F.array_compact(F.array(*pairs))).alias("value")).write.text(path)
    elif how == "html":
        cells = F.concat(*(F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in metrics.columns))
        metrics.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value")).write.text(path)
    elif how == "null":
        metrics.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError(how)
