"""Walk programs as loops of joins.

The frontier has a row for each walk: its number, the previous and the current vertex, the vertices since the last table, and, inside
a segment, the neighbours of the previous vertex. A step joins the current vertex to the adjacency table, which lies in buckets by vertex
so that only the frontier moves, and picks the next vertex by arithmetic on one hash draw, so a rejection loop is not needed: return
vertex, common neighbours and others are classes with a weight each. The neighbours found become those of the previous vertex in the
next step. Every few steps the frontier is written; the same table gives the rows (walk_id, step, vertex) and cuts the lineage. Walks
that have ended keep an id that joins with nothing; a run ends early when all have.

No list of more than hub_degree neighbours travels with a walk. Such a vertex has a row for each neighbour instead, by place: a uniform
step looks one place up, and a second-order step from or after a hub draws some candidates by place, looks up whether they are
neighbours of the previous vertex too, and takes the first that passes the acceptance ratio; walks without one draw again. Keys of these
lookups are single edges, so the edges and the walks of a hub lie in all tasks.

A few walks (on_demand_walks) do not read the whole of a large graph: each step fetches the lists of the vertices that they stand on, by id, and so
only the buckets that hold them. Their number is checked before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import weights
from ..functions.rng import below, u32
from ..sources.tables import in_buckets, written
from .config import WalkConfig

Weigh = Callable[[WalkConfig, Column, Column], weights.Classes]
#: From a frontier, the number of the step and the adjacency rows that it may need to the next frontier.
Step = Callable[[DataFrame, int, DataFrame], DataFrame]
STATE = ("walk_id", "prev", "cur", "done", "trail", "base")
#: Acceptance ratio of a candidate from the degrees of the previous and the current vertex, and whether it is the return vertex or common.
Accept = Callable[[WalkConfig, Column, Column, Column, Column], Column]
#: Candidates that a walk at a hub draws at a time.
TRIES = 16


def _starts(adj: DataFrame, cfg: WalkConfig, starts: DataFrame | None) -> DataFrame:
    """(walk_id, source): of every vertex, or of a list (position, source); repeated sources give walks of their own."""
    who = adj.select(F.col("src").alias("n"), F.col("src").alias("source")) if starts is None else starts.select(F.col("position").alias("n"), "source")
    if cfg.walks_per_vertex < 1:
        return who.where("false").select(F.col("n").alias("walk_id"), "source")
    return who.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(cfg.walks_per_vertex - 1)))).select((F.col("n") * cfg.walks_per_vertex + F.col("r")).cast("bigint").alias("walk_id"), "source")


def _pick(list_: Column, i: Column) -> Column:
    return F.get(list_, i.cast("int"))


def _run(frontier: DataFrame, adj: DataFrame, step: Step, steps: int, segment: int, second_order: bool = False) -> DataFrame:
    """Rows (walk_id, step, vertex) of a frontier moved on by that many steps, or until no walk goes on."""
    parts, at = [], 0
    while True:
        if second_order and at:
            frontier = _at(frontier, adj, "prev", "pn")
        now = min(segment, steps - at)
        for i in range(now):
            frontier = step(frontier, at + i, adj)
        at += now
        frontier = written(frontier.select(*STATE))
        parts.append(frontier.select("walk_id", "base", F.posexplode("trail").alias("i", "vertex")).select("walk_id", (F.col("base") + F.col("i")).alias("step"), "vertex"))
        frontier = frontier.where("not done").withColumn("base", F.col("base") + F.size("trail")).withColumn("trail", F.array().cast("array<bigint>"))
        if at >= steps or frontier.isEmpty():
            return reduce(DataFrame.union, parts)


def _run_few(frontier: DataFrame, adj: DataFrame, step: Step, steps: int, second_order: bool = False) -> DataFrame:
    """The same for walks that are known to be few: they stay with the driver, and a step fetches the lists of their vertices by id."""
    spark, shape = adj.sparkSession, frontier.select(*STATE).schema
    rows = frontier.select(*STATE).toArrow()
    for i in range(steps):
        going = rows.filter(pc.invert(rows.column("done")))
        ids = {v for c in ("cur", "prev") for v in going.column(c).to_pylist()} - {None}
        if not ids:
            break
        near = adj.where(F.col("src").isin(sorted(ids)))
        df = spark.createDataFrame(rows, shape)
        if second_order and i:
            df = _at(df, near, "prev", "pn")
        rows = step(df, i, near).select(*STATE).toArrow()
    return spark.createDataFrame(rows, shape).select("walk_id", F.posexplode("trail").alias("step", "vertex"))


def _frontier(starts: DataFrame) -> DataFrame:
    return starts.select("walk_id", F.lit(None).cast("bigint").alias("prev"), F.col("source").alias("cur"), F.lit(False).alias("done"), F.array("source").alias("trail"), F.lit(0).alias("base"))


def _moved(df: DataFrame, also_stop: Column | None = None) -> DataFrame:
    """df one step on to _new, _n being the neighbours found; a null _new means that the walk ends where it is."""
    go = ~F.col("done") & F.col("_new").isNotNull()
    df = df.withColumn("_go", go if also_stop is None else go & ~also_stop)
    return df.select(
        "walk_id",
        F.when(F.col("_go"), F.col("cur")).otherwise(F.col("prev")).alias("prev"),
        F.when(F.col("_go"), F.col("_new")).otherwise(F.col("cur")).alias("cur"),
        (~F.col("_go")).alias("done"),
        F.when(F.col("_go"), F.array_append("trail", F.col("_new"))).otherwise(F.col("trail")).alias("trail"),
        "base",
        F.when(F.col("_go"), F.col("_n")).alias("pn"),
    )


def _at(df: DataFrame, adj: DataFrame, col: str, name: str) -> DataFrame:
    """df with the neighbours of a vertex column as name; a walk that has ended looks for an id that no vertex has."""
    key = F.when(F.col("done"), -1 - F.col("walk_id")).otherwise(F.col(col))
    return df.withColumn("_k", key).join(adj.select(F.col("src").alias("_k"), F.col("nbrs").alias(name)), "_k", "left").drop("_k")


def _uniform_step(cfg: WalkConfig) -> Step:
    def step(df: DataFrame, i: int, adj: DataFrame) -> DataFrame:
        df = _at(df, adj, "cur", "_n")
        return _moved(df.withColumn("_new", F.when(F.size("_n") > 0, _pick(F.col("_n"), F.pmod(u32(cfg.seed, F.col("walk_id"), i), F.size("_n"))))))

    return step


def choose_by_class(df: DataFrame, u: Column, w: weights.Classes) -> DataFrame:
    """df with _new: the neighbour in _n that the draw u falls on, for walks at cur from prev with neighbours pn.

    Return vertex, common neighbours in order, the others in order. Each array is made once, in a column of its own; without common
    neighbours the others need none: their places are those of _n but the return vertex's.
    """
    # try_divide would make doubles: integer division of non-negative numbers.
    def div(a: Column, b: Column) -> Column:
        return F.floor(a / F.greatest(b, F.lit(1)))

    common, other = F.array_except(F.array_intersect("_n", "pn"), F.array("prev")), F.array_except(F.array_except("_n", F.coalesce("pn", F.array().cast("array<bigint>"))), F.array("prev"))
    place = F.col("_place") + ((F.col("_at") > 0) & (F.col("_place") >= F.col("_at") - 1)).cast("int")
    df = df.withColumn("_common", F.coalesce(common, F.array().cast("array<bigint>")))
    back = F.col("_at") > 0
    df = df.withColumn("_at", F.coalesce(F.array_position("_n", F.col("prev")), F.lit(0)))
    df = df.select("*", F.when(back, w.back).otherwise(F.lit(0)).alias("_b"), w.common.alias("_wc"), w.other.alias("_wo"), (F.size("_n") - F.size("_common") - back.cast("int")).alias("_rest"))
    df = df.withColumn("_some", F.col("_b") + F.size("_common") * F.col("_wc"))
    df = df.withColumn("_draw", below(u, F.col("_some") + F.col("_rest") * F.col("_wo")))
    new = F.when(F.col("_draw") < F.col("_b"), F.col("prev")).when(F.col("_draw") < F.col("_some"), _pick(F.col("_common"), div(F.col("_draw") - F.col("_b"), F.col("_wc"))))
    df = df.withColumn("_place", div(F.col("_draw") - F.col("_some"), F.col("_wo")))
    new = new.when(F.size("_common") == 0, _pick(F.col("_n"), place)).otherwise(_pick(other, F.col("_place")))
    return df.withColumn("_new", F.when(F.size("_n") > 0, new))


def _class_step(cfg: WalkConfig, weigh: Weigh, stop: Callable[[int], Column] | None = None) -> Step:
    first = _uniform_step(cfg)

    def step(df: DataFrame, i: int, adj: DataFrame) -> DataFrame:
        if i == 0:
            return first(df, 0, adj)
        both = _at(df, adj, "cur", "_n")
        w = weigh(cfg, F.size("pn").cast("bigint"), F.size("_n").cast("bigint"))
        return _moved(choose_by_class(both, u32(cfg.seed, F.col("walk_id"), i), w), stop(i) if stop else None)

    return step


def _split(adj: DataFrame, cfg: WalkConfig) -> tuple[DataFrame, DataFrame | None]:
    """adj without the lists of hubs, and the edges of these (src, i, dst); adj as it is and None if there is no hub."""
    if adj.where(F.col("deg") > cfg.hub_degree).isEmpty():
        return adj, None
    light = in_buckets(adj.withColumn("nbrs", F.when(F.col("deg") <= cfg.hub_degree, F.col("nbrs"))), "src")
    return light, written(adj.where(F.col("deg") > cfg.hub_degree).select("src", F.posexplode("nbrs").alias("i", "dst")))


def _with_degree(df: DataFrame, adj: DataFrame, col: str, name: str, degree: str) -> DataFrame:
    key = F.when(F.col("done"), -1 - F.col("walk_id")).otherwise(F.col(col))
    return df.withColumn("_k", key).join(adj.select(F.col("src").alias("_k"), F.col("nbrs").alias(name), F.col("deg").cast("bigint").alias(degree)), "_k", "left").drop("_k")


def _at_place(df: DataFrame, hubs: DataFrame, place: str, name: str) -> DataFrame:
    """df with the neighbour of cur at a place: from the list _n, or from the edges of a hub."""
    far = hubs.select(F.col("src").alias("_hs"), F.col("i").alias("_hi"), F.col("dst").alias("_hd"))
    on = (F.when(F.col("_n").isNull() & ~F.col("done"), F.col("cur")) == F.col("_hs")) & (F.col(place) == F.col("_hi"))
    return df.join(far, on, "left").withColumn(name, F.coalesce(F.get("_n", F.col(place)), F.col("_hd"))).drop("_hs", "_hi", "_hd")


def _accepted(walks: DataFrame, hubs: DataFrame, cfg: WalkConfig, accept: Accept, i: int) -> DataFrame:
    """(walk_id, _new) of walks (walk_id, prev, cur, done, pn, _n, _dp, _dc) from or after hubs: rounds of candidates until each walk has one."""
    found, left, round_ = [], written(walks), 0
    while not left.isEmpty():
        tries = left.withColumn("_t", F.explode(F.sequence(F.lit(round_ * TRIES), F.lit(round_ * TRIES + TRIES - 1))))
        tries = tries.withColumn("_place", below(u32(cfg.seed, F.col("walk_id"), i, "hub", F.col("_t")), F.col("_dc")).cast("int"))
        tries = _at_place(tries, hubs, "_place", "_x")
        near = hubs.select(F.col("src").alias("_hs"), F.col("dst").alias("_hd"), F.lit(True).alias("_hub_common"))
        tries = tries.join(near, (F.when(F.col("pn").isNull(), F.col("prev")) == F.col("_hs")) & (F.col("_x") == F.col("_hd")), "left")
        common = F.coalesce(F.array_contains("pn", F.col("_x")), F.col("_hub_common"), F.lit(False))
        ratio = accept(cfg, F.col("_dp"), F.col("_dc"), F.col("_x") == F.col("prev"), common)
        passed = u32(cfg.seed, F.col("walk_id"), i, "accept", F.col("_t")) < ratio * float(1 << 32)
        took = written(tries.where(passed).groupBy("walk_id").agg(F.min_by("_x", "_t").alias("_new")))
        found.append(took)
        left, round_ = written(left.join(took, "walk_id", "left_anti")), round_ + 1
    return reduce(DataFrame.union, found) if found else walks.select("walk_id", F.col("cur").alias("_new"))


def _run_with_hubs(frontier: DataFrame, adj: DataFrame, hubs: DataFrame, cfg: WalkConfig, steps: int, weigh: Weigh | None = None, accept: Accept | None = None, stop: Callable[[int], Column] | None = None) -> DataFrame:
    """As _run, a table for each step; adj has no lists of hubs. First-order without weigh."""
    parts = []
    for at in range(steps):
        both = _with_degree(frontier, adj, "cur", "_n", "_dc")
        u = u32(cfg.seed, F.col("walk_id"), at)
        if weigh is None or at == 0:
            placed = both.withColumn("_place", F.when(F.col("_dc") > 0, F.pmod(u, F.col("_dc"))).cast("int"))
            frontier = _moved(_at_place(placed, hubs, "_place", "_new"))
        else:
            both = _with_degree(both, adj, "prev", "pn", "_dp")
            heavy = ~F.col("done") & (F.col("_dc") > 0) & (F.col("_n").isNull() | F.col("pn").isNull())
            both = written(both.withColumn("_heavy", F.coalesce(heavy, F.lit(False))))
            light = _moved(choose_by_class(both.where("not _heavy"), u, weigh(cfg, F.col("_dp"), F.col("_dc"))), stop(at) if stop else None)
            rest = both.where("_heavy")
            took = _accepted(rest.select("walk_id", "prev", "cur", "done", "pn", "_n", "_dp", "_dc"), hubs, cfg, accept, at)
            frontier = light.union(_moved(rest.join(took, "walk_id"), stop(at) if stop else None))
        frontier = written(frontier.select(*STATE))
        parts.append(frontier.select("walk_id", "base", F.posexplode("trail").alias("i", "vertex")).select("walk_id", (F.col("base") + F.col("i")).alias("step"), "vertex"))
        frontier = frontier.where("not done").withColumn("base", F.col("base") + F.size("trail")).withColumn("trail", F.array().cast("array<bigint>"))
        if frontier.isEmpty():
            break
    return reduce(DataFrame.union, parts)


def _node2vec_weights(cfg: WalkConfig, deg_prev: Column, deg_cur: Column) -> weights.Classes:
    return weights.node2vec(cfg.p, cfg.q)


def _node2vec_accept(cfg: WalkConfig, deg_prev: Column, deg_cur: Column, back: Column, common: Column) -> Column:
    return weights.node2vec_acceptance(float(cfg.p), float(cfg.q), back, common)


def _ar_weights(cfg: WalkConfig, deg_prev: Column, deg_cur: Column) -> weights.Classes:
    return weights.autoregressive(cfg.alpha, deg_prev, deg_cur)


def _ar_accept(cfg: WalkConfig, deg_prev: Column, deg_cur: Column, back: Column, common: Column) -> Column:
    return weights.autoregressive_acceptance(float(cfg.alpha), deg_prev, deg_cur, common)


def _decayed(cfg: WalkConfig) -> Callable[[int], Column]:
    bound = int(cfg.decay_factor * (1 << 32))
    return lambda i: u32(cfg.seed, F.col("walk_id"), i, "d") > bound


def _few(adj: DataFrame, cfg: WalkConfig, who: DataFrame, starts: DataFrame | None) -> bool:
    """Whether a list of starts gives so few walks, in so large a graph, that lists are fetched by id."""
    if starts is None or int(str(adj._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= cfg.on_demand_bytes:
        return False
    return who.limit(cfg.on_demand_walks + 1).count() <= cfg.on_demand_walks


def deepwalk(adj: DataFrame, cfg: WalkConfig, starts: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """First-order walks of at most walk_length edges; a sink ends one. vertices (v): also those without neighbours start."""
    who = _starts(adj if vertices is None else vertices.select(F.col("v").alias("src")), cfg, starts)
    if _few(adj, cfg, who, starts):
        return _run_few(_frontier(who), adj, _uniform_step(cfg), cfg.walk_length)
    light, hubs = _split(adj, cfg)
    if hubs is not None:
        return _run_with_hubs(_frontier(who), light, hubs, cfg, cfg.walk_length)
    return _run(_frontier(who), adj, _uniform_step(cfg), cfg.walk_length, cfg.segment)


def _second_order(adj: DataFrame, cfg: WalkConfig, weigh: Weigh, accept: Accept, starts: DataFrame | None, edges: int, stop=None) -> DataFrame:
    who = _starts(adj.where("deg > 0"), cfg, starts)
    if starts is not None:
        who = who.join(adj.where("deg > 0").select(F.col("src").alias("source")), "source", "left_semi").select("walk_id", "source")
    if _few(adj, cfg, who, starts):
        return _run_few(_frontier(who), adj, _class_step(cfg, weigh, stop), edges, second_order=True)
    light, hubs = _split(adj, cfg)
    if hubs is not None:
        return _run_with_hubs(_frontier(who), light, hubs, cfg, edges, weigh, accept, stop)
    return _run(_frontier(who), adj, _class_step(cfg, weigh, stop), edges, cfg.segment, second_order=True)


def node2vec(adj: DataFrame, cfg: WalkConfig, starts: DataFrame | None = None) -> DataFrame:
    """One uniform edge and walk_length second-order steps from every vertex that has neighbours."""
    return _second_order(adj, cfg, _node2vec_weights, _node2vec_accept, starts, cfg.walk_length + 1)


def autoregressive(adj: DataFrame, cfg: WalkConfig, starts: DataFrame | None = None) -> DataFrame:
    return _second_order(adj, cfg, _ar_weights, _ar_accept, starts, cfg.walk_length + 1)


def ppr(adj: DataFrame, cfg: WalkConfig, starts: DataFrame) -> DataFrame:
    """node2vec steps, at most walk_length edges, each but the first taken with probability decay_factor."""
    return _second_order(adj, cfg, _node2vec_weights, _node2vec_accept, starts, cfg.walk_length, _decayed(cfg))


def autoregressive_ppr(adj: DataFrame, cfg: WalkConfig, starts: DataFrame) -> DataFrame:
    return _second_order(adj, cfg, _ar_weights, _ar_accept, starts, cfg.walk_length, _decayed(cfg))


def linkscan(adj: DataFrame, cfg: WalkConfig, starts: DataFrame | None = None) -> DataFrame:
    """Steps weighted by the similarity of the previous vertex and the candidate; a vertex of degree 1 sends the walk back.

    Candidates need their own neighbours: those of a walk's current vertex are exploded, joined and brought together again in each step.
    """
    first = _uniform_step(cfg)
    candidates = "array<struct<x:bigint,w:bigint>>"

    def step(df: DataFrame, i: int, adj: DataFrame) -> DataFrame:
        if i == 0:
            return first(df, 0, adj)
        both = _at(df, adj, "cur", "_n")
        each = both.where("not done").select("walk_id", "prev", "pn", F.explode("_n").alias("_x"))
        far = adj.select(F.col("src").alias("_x"), F.col("nbrs").alias("_xn"), F.col("deg").alias("_xd"))
        scored = each.join(far, "_x").withColumn("_c", F.size(F.array_intersect("pn", "_xn")))
        w = F.when(F.col("_x") == F.col("prev"), 0).otherwise(weights.similarity(F.col("_c"), F.size("pn"), F.col("_xd")))
        listed = scored.select("walk_id", F.struct(F.col("_x").alias("x"), w.cast("bigint").alias("w")).alias("_s")).groupBy("walk_id").agg(F.sort_array(F.collect_list("_s")).alias("_l"))
        drawn = both.join(listed, "walk_id", "left").withColumn("_l", F.coalesce("_l", F.array().cast(candidates)))
        drawn = drawn.withColumn("_draw", below(u32(cfg.seed, F.col("walk_id"), i), F.aggregate("_l", F.lit(0).cast("bigint"), lambda t, c: t + c["w"])))
        return _moved(drawn.withColumn("_new", F.when(F.size("_n") == 1, F.col("prev")).otherwise(pick_by_weight(F.col("_l"), F.col("_draw")))))

    who = _starts(adj.where("deg > 0"), cfg, starts)
    return _run(_frontier(who), adj, step, cfg.walk_length + 1, cfg.segment, second_order=True)


def pick_by_weight(candidates: Column, draw: Column) -> Column:
    """x of the candidate (x, w) in which the draw, below the sum of the weights, falls: the first whose running sum passes it, the last if none does.

    Weights of any kind: the exact sampler where no classes are known. Null if all weights are 0.
    """
    empty = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("last"))

    def on(t: Column, c: Column) -> Column:
        to = t["to"] + c["w"]
        return F.struct(to.alias("to"), F.when(t["x"].isNull() & (to > draw) & (c["w"] > 0), c["x"]).otherwise(t["x"]).alias("x"), F.when(c["w"] > 0, c["x"]).otherwise(t["last"]).alias("last"))

    return F.aggregate(candidates, empty, on, lambda t: F.coalesce(t["x"], t["last"]))


def _picks(draw: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda j: _pick(F.col("nbrs"), F.pmod(draw(j), F.size("nbrs")))


def fanout(adj: DataFrame, roots: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(root, level, ordinal, vertex): sizes[l] draws with replacement from the neighbours of each vertex of level l.

    ordinal numbers a level in mixed radix: child j of ordinal o is o * sizes[l] + j. Vertices without neighbours have no
    children.
    """
    level = roots.select(F.col("source").alias("root"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("ordinal"), F.col("source").alias("vertex"))
    parts = [level]
    for i, s in enumerate(sizes):
        near = level.join(adj.where("deg > 0").select(F.col("src").alias("vertex"), "nbrs"), "vertex")
        draw = partial(u32, seed, F.col("root"), i, F.col("ordinal"))
        # Picked before they become rows: a list of neighbours is not copied for each child.
        each = near.select("root", "ordinal", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(s - 1)), _picks(draw))).alias("j", "vertex"))
        level = each.select("root", F.lit(i + 1).alias("level"), (F.col("ordinal") * s + F.col("j")).cast("bigint").alias("ordinal"), "vertex")
        parts.append(level)
    return reduce(DataFrame.union, parts)


def frontier_sample(adj: DataFrame, n_replicas: int, n_roots: int, budget: int, seed: int, segment: int = 5) -> DataFrame:
    """(replica, step, vertex): a list of roots; a slot drawn by degree gives a random neighbour, which takes its place at the end.

    Steps 0 .. n_roots-1 are the roots, drawn with replacement from the vertices with neighbours, in the order of ids. Each step depends on all before,
    so replicas are the unit of parallel work: a replica is a row with its list, and one step of all replicas is a join for the drawn
    vertex's neighbours and one for the new vertex's degree.
    """
    from ..operators.ordered import row_numbers

    numbered = written(row_numbers(adj.where("deg > 0").select("src", "deg"), "n", F.col("src")))
    total = numbered.count()
    if not total or n_roots < 1:
        return adj.sparkSession.createDataFrame([], "replica long, step long, vertex long")
    roots = adj.sparkSession.range(n_replicas).toDF("replica").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_roots - 1))))
    drawn = roots.withColumn("n", F.pmod(u32(seed, F.col("replica"), F.col("slot"), "root"), F.lit(total)).cast("bigint")).join(numbered, "n")
    listed = drawn.groupBy("replica").agg(F.sort_array(F.collect_list(F.struct("slot", F.col("src").alias("v"), F.col("deg").cast("bigint").alias("d")))).alias("live"))
    state = written(listed.select("replica", F.transform("live", lambda x: F.struct(x["v"].alias("v"), x["d"].alias("d"))).alias("live"), F.transform("live", lambda x: x["v"]).alias("trail"), F.lit(0).alias("base")))
    parts, at = [], n_roots
    degree = adj.select(F.col("src").alias("_next"), F.col("deg").cast("bigint").alias("_d"))
    near = adj.select(F.col("src").alias("_from"), F.col("deg").cast("bigint").alias("_deg"), F.col("nbrs").alias("_n"))
    while True:
        parts.append(state.select("replica", "base", F.posexplode("trail").alias("i", "vertex")).select("replica", (F.col("base") + F.col("i")).cast("bigint").alias("step"), "vertex"))
        if at >= budget:
            return reduce(DataFrame.union, parts)
        state = state.withColumn("base", F.col("base") + F.size("trail")).withColumn("trail", F.array().cast("array<bigint>"))
        now = min(segment, budget - at)
        for i in range(at - n_roots, at - n_roots + now):
            k = below(u32(seed, F.col("replica"), i, 0), F.aggregate("live", F.lit(0).cast("bigint"), lambda t, x: t + x["d"]))
            state = state.withColumn("_k", k)
            # Slots whose running sum of degrees does not pass the draw come before the drawn one.
            passed = F.aggregate("live", F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).alias("n")), lambda t, x: F.struct((t["to"] + x["d"]).alias("to"), (t["n"] + (t["to"] + x["d"] <= F.col("_k")).cast("int")).alias("n")), lambda t: t["n"])
            state = state.withColumn("_slot", passed).withColumn("_from", F.get("live", F.col("_slot"))["v"]).join(near, "_from")
            state = state.withColumn("_next", _pick(F.col("_n"), F.pmod(u32(seed, F.col("replica"), i, 1), F.col("_deg")))).drop("_n", "_from", "_deg", "_k").join(degree, "_next")
            rest = F.filter("live", lambda x, j: j != F.col("_slot"))
            state = state.select("replica", F.array_append(rest, F.struct(F.col("_next").alias("v"), F.col("_d").alias("d"))).alias("live"), F.array_append("trail", F.col("_next")).alias("trail"), "base")
        at += now
        state = written(state)


def transitions(adj: DataFrame, kind: str, cfg: WalkConfig, prevs: DataFrame | None = None) -> DataFrame:
    """(prev, cur, next, w, total, prob, ratio): all second-order steps, their integer weights, the weights' sum over next, probabilities and acceptance ratios.

    kind: node2vec, ar or linkscan. prevs (v) bounds the previous vertices; all of them cost the sum of squared degrees. The sums of
    class weights come from sizes, so nothing is brought together by (prev, cur). linkscan brings the paths of two edges together
    by their ends: there are as many as the ends have common neighbours (the graph is undirected).
    """
    t = adj if prevs is None else adj.join(prevs.select(F.col("v").alias("src")), "src", "left_semi")
    pairs = t.select(F.col("src").alias("prev"), F.col("nbrs").alias("pn"), F.col("deg").cast("bigint").alias("pd"), F.explode("nbrs").alias("cur"))
    pairs = pairs.join(adj.select(F.col("src").alias("cur"), F.col("deg").cast("bigint").alias("cd"), F.col("nbrs").alias("cn")), "cur")
    if kind == "linkscan":
        far = adj.select(F.col("src").alias("next"), F.col("deg").cast("bigint").alias("xd"))
        steps = pairs.select("prev", "pd", "cur", "cd", F.explode("cn").alias("next")).join(far, "next")
        back, ends, via = F.col("next") == F.col("prev"), W.partitionBy("prev", "next"), W.partitionBy("prev", "cur")
        c = F.col("_c")
        steps = steps.withColumn("_c", F.count(F.lit(1)).over(ends))
        w = F.when(back, F.when(F.col("cd") == 1, F.lit(1)).otherwise(F.lit(0))).otherwise(weights.similarity(c, F.col("pd"), F.col("xd")))
        ratio = F.when(back, F.when(F.col("cd") == 1, 1.0).otherwise(0.0)).otherwise(c / (2 + F.col("pd") + F.col("xd") - c))
        scored = steps.select("prev", "cur", "next", w.cast("bigint").alias("w"), ratio.alias("ratio")).withColumn("total", F.sum("w").over(via))
        return scored.select("prev", "cur", "next", "w", "total", (F.col("w") / F.col("total")).alias("prob"), "ratio")
    k = weights.node2vec(cfg.p, cfg.q) if kind == "node2vec" else weights.autoregressive(cfg.alpha, F.col("pd"), F.col("cd"))
    pairs = pairs.withColumn("_common", F.array_except(F.array_intersect("cn", "pn"), F.array("prev")))
    returns = F.array_contains("cn", F.col("prev")).cast("int")
    total = returns * k.back + F.size("_common") * k.common + (F.size("cn") - F.size("_common") - returns) * k.other
    steps = pairs.withColumn("total", total.cast("bigint")).select("prev", "pd", "cur", "cd", "total", "_common", F.explode("cn").alias("next"))
    back, common = F.col("next") == F.col("prev"), F.array_contains("_common", F.col("next"))
    w = F.when(back, k.back).when(common, k.common).otherwise(k.other)
    p, q, a = float(cfg.p), float(cfg.q), float(cfg.alpha)
    ratio = weights.node2vec_acceptance(p, q, back, common) if kind == "node2vec" else weights.autoregressive_acceptance(a, F.col("pd"), F.col("cd"), common)
    return steps.select("prev", "cur", "next", w.cast("bigint").alias("w"), "total", ratio.alias("ratio")).select("prev", "cur", "next", "w", "total", (F.col("w") / F.col("total")).alias("prob"), "ratio")


PROGRAMS = {"node2vec": node2vec, "ar": autoregressive, "ppr": ppr, "ar_ppr": autoregressive_ppr, "linkscan": linkscan, "deepwalk": deepwalk}
