"""What walks and graphs add up to: visits, scores, top lists, errors, block activity, regression of block logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import with_block


def visits(steps: DataFrame) -> DataFrame:
    """(vertex, cnt): occurrences after the source in (walk_id, step, vertex)."""
    return steps.where("step > 0").groupBy("vertex").agg(F.count(F.lit(1)).alias("cnt"))


def visit_probability(counts: DataFrame) -> DataFrame:
    return counts.select("vertex", (F.col("cnt") / counts.agg(F.sum("cnt")).scalar()).alias("prob"))


def ppr_scores(steps: DataFrame, walks_per_source: int) -> DataFrame:
    """(source_no, vertex, ppr_terminal, ppr_visit): shares of a source's walks that end in a vertex, and of its visits.

    walk_id div walks_per_source is the number of the source.
    """
    s = steps.withColumn("source_no", F.expr(f"walk_id div {walks_per_source}"))
    last = s.groupBy("source_no", "walk_id").agg(F.max_by("vertex", "step").alias("vertex"))
    ends = last.groupBy("source_no", "vertex").agg((F.count(F.lit(1)) / walks_per_source).alias("ppr_terminal"))
    seen = s.where("step > 0").groupBy("source_no", "vertex").agg(F.count(F.lit(1)).alias("n"))
    total = seen.groupBy("source_no").agg(F.sum("n").alias("t"))
    share = seen.join(total, "source_no").select("source_no", "vertex", (F.col("n") / F.col("t")).alias("ppr_visit"))
    return share.join(ends, ["source_no", "vertex"], "full").select("source_no", "vertex", F.coalesce("ppr_terminal", F.lit(0.0)).alias("ppr_terminal"), F.coalesce("ppr_visit", F.lit(0.0)).alias("ppr_visit"))


def mean_relative_error(estimate: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """(n, error): mean of abs(estimate - truth) / truth over the n vertices of the largest true values."""
    top = truth.orderBy(F.desc("prob"), "vertex").limit(n).select("vertex", F.col("prob").alias("acc"))
    both = top.join(estimate, "vertex", "left").select(F.abs(F.coalesce("prob", F.lit(0.0)) - F.col("acc")) / F.col("acc"))
    return both.toDF("e").agg(F.count("e").alias("n"), F.avg("e").alias("error"))


def total_steps(steps: DataFrame) -> DataFrame:
    return steps.agg(F.sum((F.col("step") > 0).cast("bigint")).alias("total_steps"))


def walks_per_block(steps: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, step, n_walks): where walks stand after each step."""
    return with_block(steps, blocks, "vertex").groupBy("block_id", "step").agg(F.count(F.lit(1)).alias("n_walks"))


def block_choice(steps: DataFrame, blocks: DataFrame) -> DataFrame:
    """(most_walks, least_hop): the block with most unfinished walks, and the one that holds the walk of the fewest hops.

    Each walk stands where it is last seen; ties go to the smaller block.
    """
    at = steps.groupBy("walk_id").agg(F.max_by("vertex", "step").alias("vertex"), F.max("step").alias("hop"))
    per = with_block(at, blocks, "vertex").groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min("hop").alias("hop"))
    return per.agg(F.max_by("block_id", F.struct("n", -F.col("block_id"))).alias("most_walks"), F.min_by("block_id", F.struct("hop", "block_id")).alias("least_hop"))


def choose_block(steps: DataFrame, blocks: DataFrame, prob: float, draw: Column, draws: int = 1) -> DataFrame:
    """(i, block_id) for a number of draws: the block of the fewest hops if the draw, from 0 to below 1 and by i, is under prob; else that of most walks."""
    each = block_choice(steps, blocks).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return each.select("i", F.when(draw < prob, F.col("least_hop")).otherwise(F.col("most_walks")).alias("block_id"))


def block_log(steps: DataFrame, blocks: DataFrame, adj: DataFrame) -> DataFrame:
    """(step, block_id, nverts, nedges, nwalks): the loads of a run, a row for each step and block that walks stand in."""
    return walks_per_block(steps, blocks).join(block_sizes(adj, blocks), "block_id").select("step", "block_id", "nverts", "nedges", F.col("n_walks").alias("nwalks"))


def activated(steps: DataFrame, blocks: DataFrame, adj: DataFrame) -> DataFrame:
    """(step, block_id, activated, used_edges, total_vertices, total_edges) of the vertices that walks leave from in a step."""
    marked = steps.select("step", "vertex").distinct()
    used = with_block(marked, blocks, "vertex").join(adj.select(F.col("src").alias("vertex"), "deg"), "vertex")
    per = used.groupBy("step", "block_id").agg(F.count(F.lit(1)).alias("activated"), F.sum("deg").alias("used_edges"))
    return per.join(block_sizes(adj, blocks), "block_id").select("step", "block_id", "activated", "used_edges", F.col("nverts").alias("total_vertices"), F.col("nedges").alias("total_edges"))


def block_sizes(adj: DataFrame, blocks: DataFrame) -> DataFrame:
    return with_block(adj.select("src", "deg"), blocks, "src").groupBy("block_id").agg(F.count(F.lit(1)).alias("nverts"), F.sum("deg").alias("nedges"))


def edge_cut(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(cut, inside, ratio) of the edges by whether their ends are in one block."""
    both = with_block(with_block(edges, blocks, "src"), blocks, "dst", "other")
    cut = F.sum((F.col("block_id") != F.col("other")).cast("bigint"))
    return both.agg(cut.alias("cut"), (F.count(F.lit(1)) - cut).alias("inside"), (cut / F.count(F.lit(1))).alias("ratio"))


def line_graph_size(adj: DataFrame) -> DataFrame:
    """(n_vertices, n_edges) of the graph whose vertices are the undirected edges."""
    return adj.agg(F.expr("sum(deg) div 2").alias("n_vertices"), F.expr("sum(cast(deg as bigint) * (deg - 1)) div 2").alias("n_edges"))


def running_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, count, sum, min, max, avg) by key."""
    v = F.col(value)
    return df.groupBy(F.col(key).alias("key")).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"))


def round_average(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.avg(value).alias("mean"))


def load_thresholds(full: DataFrame, on_demand: DataFrame, least_rows: int = 8) -> DataFrame:
    """(block_id, ths): below that many walks for each vertex, fetching single vertices is faster than loading a block.

    Both logs hold block_id, nverts, nwalks, load_time and exec_time. Time is regressed on walks for each vertex: full
    loads with fewer walks than vertices, single fetches that took less than the full load's intercept. The threshold is
    where the lines meet; 0 for a block with fewer than least_rows rows on either side (counted before the second filter).
    """

    def points(log: DataFrame) -> DataFrame:
        return log.select("block_id", (F.col("nwalks") / F.col("nverts")).alias("x"), (F.col("load_time") + F.col("exec_time")).alias("y"))

    fl, od = points(full).where("x < 1"), points(on_demand)
    line = fl.groupBy("block_id").agg(F.regr_slope("y", "x").alias("a_fl"), F.regr_intercept("y", "x").alias("b_fl"), F.count(F.lit(1)).alias("n_fl"))
    n_od = od.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_od"))
    fits = od.join(line, "block_id").where("y < b_fl").groupBy("block_id").agg(F.regr_slope("y", "x").alias("a_od"), F.regr_intercept("y", "x").alias("b_od"))
    every = full.select("block_id").union(on_demand.select("block_id")).distinct()
    all_ = every.join(line, "block_id", "left").join(n_od, "block_id", "left").join(fits, "block_id", "left")
    enough = (F.coalesce("n_fl", F.lit(0)) >= least_rows) & (F.coalesce("n_od", F.lit(0)) >= least_rows)
    meet = F.try_divide(F.col("b_od") - F.col("b_fl"), F.col("a_fl") - F.col("a_od"))
    return all_.select("block_id", F.coalesce(F.when(enough, meet), F.lit(0.0)).alias("ths"))


def load_decision(walks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(block_id, mode): on_demand where ths > 0, the block is not resident and nwalks < ths * nverts; else full.

    With thresholds by pairs (block_id, other_block, ths) walks have other_block too, and so has the result.
    """
    key = ["block_id", "other_block"] if "other_block" in thresholds.columns else ["block_id"]
    fetch = (F.col("ths") > 0) & (F.col("nwalks") < F.col("ths") * F.col("nverts")) & ~F.col("resident")
    return walks.join(thresholds, key, "left").select(*key, F.when(F.coalesce(fetch, F.lit(False)), "on_demand").otherwise("full").alias("mode"))


def pair_thresholds(full: DataFrame, on_demand: DataFrame, least_rows: int = 8) -> DataFrame:
    """(block_id, other_block, ths) of logs by pairs of blocks, the other block the smaller one, as load_thresholds gives them by block."""
    def keyed(log: DataFrame) -> DataFrame:
        return log.withColumn("block_id", F.struct("block_id", "other_block"))

    return load_thresholds(keyed(full), keyed(on_demand), least_rows).select("block_id.block_id", "block_id.other_block", "ths")
