"""Registered queries over the co-purchase graph of the sample tables, and the SQL (DuckDB) that gives the same rows."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rng import below, u32, u32_sql
from .operators import graph as G
from .operators import stats as S
from .plans import walks as P
from .plans.config import WalkConfig
from .plans.similarity import linkscan_sums
from .sources import sinks, text
from .sources.tables import copurchase_edges, in_buckets, new_path, supplier_part_edges, table, written

SEED = 42
CAPACITY = 4096
N_BLOCKS = 8
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

RAW = """raw AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
UND = RAW + """, und AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM raw WHERE src <> dst UNION ALL SELECT dst, src FROM raw WHERE src <> dst) z)"""
ADJ = UND + ", adj AS (SELECT src, list(dst ORDER BY dst) AS nbrs, count(*) AS deg FROM und GROUP BY src)"
DIRECTED = RAW + ", und AS (SELECT DISTINCT src, dst FROM raw WHERE src < dst), adj AS (SELECT src, list(dst ORDER BY dst) AS nbrs, count(*) AS deg FROM und GROUP BY src)"
#: Greedy blocks: each start gives the next, the first vertex whose edges no longer fit.
BLOCKS = f""", runs AS (SELECT src, deg, sum(deg) OVER (ORDER BY src) AS upto FROM adj),
starts AS (SELECT CAST(0 AS BIGINT) AS start_v, CAST(0 AS BIGINT) AS before UNION ALL
  SELECT n.src, CAST(n.upto - n.deg AS BIGINT) FROM starts s, LATERAL (SELECT src, upto, deg FROM runs r WHERE r.upto - s.before > {CAPACITY} AND r.src > (SELECT min(src) FROM runs f WHERE f.src >= s.start_v) ORDER BY src LIMIT 1) n),
blocks AS (SELECT CAST(row_number() OVER (ORDER BY start_v) - 1 AS INTEGER) AS block_id, start_v, coalesce(lead(start_v) OVER (ORDER BY start_v), (SELECT max(src) + 1 FROM adj)) AS end_v FROM starts)"""


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = ("WITH RECURSIVE " if recursive else "WITH ") + sql
        return f

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return copurchase_edges(spark, d)


def und(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(raw(spark, d))


def adj(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency table, written once for the steps of a query, in buckets by vertex."""
    return in_buckets(G.adjacency(und(spark, d)), "src")


def directed(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).where("src < dst").distinct()


def blocks(a: DataFrame) -> DataFrame:
    return written(G.sequential_blocks(a, CAPACITY))


def starts(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ids)), "position long, source long")


SOURCES = [0, 7, 7, 42, 99, 150]
CFG = WalkConfig(walk_length=5, p=Fraction(4), q=Fraction(1, 4), seed=SEED)


# Edges

query("g_raw_edges", RAW + " SELECT src, dst FROM raw")(raw)
query("g_self_loops_dropped", RAW + " SELECT src, dst FROM raw WHERE src <> dst")(lambda s, d: G.without_loops(raw(s, d)))
query("g_undirected", UND + " SELECT src, dst FROM und")(und)
query("g_reverse", RAW + " SELECT DISTINCT dst AS src, src AS dst FROM raw")(lambda s, d: G.reversed_edges(raw(s, d)))
query("g_oneway", RAW + " SELECT src, dst FROM raw EXCEPT SELECT dst, src FROM raw")(lambda s, d: G.one_way(raw(s, d)))
query("g_merge", RAW + " SELECT src, dst FROM raw UNION SELECT dst, src FROM raw")(lambda s, d: G.merged(raw(s, d), G.reversed_edges(raw(s, d))))
query("g_completed", RAW + ", e AS (SELECT DISTINCT src, dst FROM raw) SELECT src, dst FROM e UNION ALL (SELECT dst, src FROM e EXCEPT SELECT src, dst FROM e) ORDER BY 1, 2")(lambda s, d: G.completed(raw(s, d).distinct()))
query("g_sorted", RAW + " SELECT src, dst FROM raw ORDER BY src, dst")(lambda s, d: G.sorted_edges(raw(s, d)))
query("g_bipartite", "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")(supplier_part_edges)
query("g_edge_lines", UND + " SELECT concat_ws(' ', src, dst) AS value FROM und")(lambda s, d: sinks.edge_lines(und(s, d)))

SEEN = """, n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS n FROM und), ends AS (SELECT src AS old, 2 * n AS pos FROM n UNION ALL SELECT dst, 2 * n + 1 FROM n),
ids AS (SELECT old, row_number() OVER (ORDER BY min(pos)) - 1 AS new FROM ends GROUP BY old)"""


def seen_ids(s, d):
    return G.first_seen_ids(und(s, d), "src", "dst")


query("g_dense_ids", UND + SEEN + " SELECT old, new FROM ids")(seen_ids)
query("g_relabel", UND + SEEN + " SELECT a.new AS src, b.new AS dst FROM und JOIN ids a ON a.old = src JOIN ids b ON b.old = dst")(lambda s, d: G.relabelled(und(s, d), seen_ids(s, d)))


# Adjacency

def _csv(a: DataFrame) -> DataFrame:
    return a.select("src", F.col("deg").cast("bigint").alias("deg"), F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs_csv"))


query("g_adjacency", ADJ + " SELECT src, deg, array_to_string(nbrs, ',') AS nbrs_csv FROM adj")(lambda s, d: _csv(G.adjacency(und(s, d))))
query("g_offsets", ADJ + " SELECT src AS v, CAST(sum(deg) OVER (ORDER BY src) - deg AS BIGINT) AS beg_pos FROM adj UNION ALL SELECT max(src) + 1, CAST(sum(deg) AS BIGINT) FROM adj")(lambda s, d: G.offsets(G.adjacency(und(s, d))))
query("g_degree_stats", ADJ + " SELECT count(*) AS n, CAST(max(deg) AS BIGINT) AS max_deg, round(avg(deg), 6) AS avg_deg, max(src) + 1 AS n_vertices FROM adj")(
    lambda s, d: G.degrees(und(s, d)).agg(F.count(F.lit(1)).alias("n"), F.max("deg").alias("max_deg"), F.round(F.avg("deg"), 6).alias("avg_deg"), (F.max("v") + 1).alias("n_vertices")))
query("g_vertex_count", RAW + " SELECT max(greatest(src, dst)) + 1 AS n_vertices FROM raw")(lambda s, d: G.vertex_count(raw(s, d)))
query("g_distinct_vertices", RAW + " SELECT count(*) AS n FROM (SELECT src FROM raw UNION SELECT dst FROM raw) z")(lambda s, d: G.distinct_vertices(raw(s, d)).agg(F.count(F.lit(1)).alias("n")))
query("g_block_scan", ADJ + " SELECT src, deg, array_to_string(nbrs, ',') AS nbrs_csv FROM adj WHERE src >= 50 AND src < 120")(lambda s, d: _csv(G.in_block(adj(s, d), 50, 120)))
query("g_needed_vertices", ADJ + " SELECT src, deg, array_to_string(nbrs, ',') AS nbrs_csv FROM adj WHERE src IN (SELECT o_custkey FROM orders)")(lambda s, d: _csv(G.neighbours_of(adj(s, d), table(s, d, "orders").select(F.col("o_custkey").alias("v")))))
query("g_random_starts", ADJ + f" SELECT src AS source FROM adj ORDER BY {u32_sql(str(SEED), 'src')}, src LIMIT 100")(lambda s, d: G.random_starts(G.distinct_vertices(und(s, d)), 100, SEED))
query("g_by_degree", ADJ + " SELECT src AS v, CAST(deg AS BIGINT) AS deg FROM adj ORDER BY deg DESC, src")(lambda s, d: G.by_degree(G.degrees(und(s, d))))

# Partitions and blocks

SNAKE = f""", r AS (SELECT src AS v, (row_number() OVER (ORDER BY deg DESC, src) - 1) AS rn FROM adj), b AS (SELECT v, rn, CASE WHEN rn % {2 * N_BLOCKS} < {N_BLOCKS} THEN rn % {2 * N_BLOCKS} ELSE {2 * N_BLOCKS - 1} - rn % {2 * N_BLOCKS} END AS block_id FROM r)"""
query("g_dorder", ADJ + SNAKE + " SELECT v, CAST(block_id AS INTEGER) AS block_id, row_number() OVER (ORDER BY block_id, rn) - 1 AS new_id FROM b")(lambda s, d: G.snake_partition(G.degrees(und(s, d)), N_BLOCKS))


def _parts(s, d):
    return G.distinct_vertices(und(s, d)).select(F.col("v").alias("vertex"), (F.col("v") % N_BLOCKS).cast("int").alias("block_id"))


PARTS = f", m AS (SELECT src AS old, row_number() OVER (ORDER BY src % {N_BLOCKS}, src) - 1 AS new FROM adj)"
query("g_metis_reorder", ADJ + PARTS + " SELECT a.new AS src, b.new AS dst FROM und JOIN m a ON a.old = src JOIN m b ON b.old = dst")(lambda s, d: G.relabelled(und(s, d), G.by_partition(_parts(s, d))))


@query("g_metis_lines", ADJ + ", n AS (SELECT max(src) + 1 AS v FROM adj) SELECT CAST(0 AS BIGINT) AS line_no, (SELECT v FROM n) || chr(9) || (SELECT CAST(sum(deg) AS BIGINT) // 2 FROM adj) AS line UNION ALL SELECT i + 1, coalesce(array_to_string(list_transform(nbrs, lambda x: x + 1), ' '), '') FROM range((SELECT v FROM n)) t(i) LEFT JOIN adj ON src = i")
def metis_lines(s, d):
    e = und(s, d)
    return sinks.metis_lines(G.adjacency(e, G.vertex_count(e).first()[0]))


@query("g_blocks", ADJ + BLOCKS + " SELECT block_id, start_v, end_v, CAST(sum(deg) AS BIGINT) AS n_edges FROM blocks JOIN adj ON src >= start_v AND src < end_v GROUP BY ALL", recursive=True)
def sequential_blocks(s, d):
    return G.sequential_blocks(G.adjacency(und(s, d)), CAPACITY)


@query("g_block_sizes", ADJ + BLOCKS + " SELECT block_id, count(*) AS nverts, CAST(sum(deg) AS BIGINT) AS nedges FROM blocks JOIN adj ON src >= start_v AND src < end_v GROUP BY ALL", recursive=True)
def block_sizes(s, d):
    a = adj(s, d)
    return S.block_sizes(a, blocks(a))


@query("g_block_of", ADJ + BLOCKS + " SELECT src AS v, block_id FROM blocks JOIN adj ON src >= start_v AND src < end_v", recursive=True)
def block_of(s, d):
    a = adj(s, d)
    return G.with_block(a.select(F.col("src").alias("v")), blocks(a), "v")


@query("g_edge_cut", ADJ + BLOCKS + " SELECT CAST(sum(CASE WHEN a.block_id <> b.block_id THEN 1 ELSE 0 END) AS BIGINT) AS cut, CAST(sum(CASE WHEN a.block_id = b.block_id THEN 1 ELSE 0 END) AS BIGINT) AS inside, round(avg(CASE WHEN a.block_id <> b.block_id THEN 1.0 ELSE 0 END), 6) AS ratio FROM und JOIN blocks a ON src >= a.start_v AND src < a.end_v JOIN blocks b ON dst >= b.start_v AND dst < b.end_v", recursive=True)
def edge_cut(s, d):
    return S.edge_cut(und(s, d), blocks(adj(s, d))).withColumn("ratio", F.round("ratio", 6))


query("g_line_graph", ADJ + " SELECT CAST(sum(deg) AS BIGINT) // 2 AS n_vertices, CAST(sum(deg * (deg - 1)) AS BIGINT) // 2 AS n_edges FROM adj")(lambda s, d: S.line_graph_size(G.adjacency(und(s, d))))
query("g_hot_set", ADJ + f", r AS (SELECT src AS v, deg, sum(deg) OVER (ORDER BY deg DESC, src) AS upto FROM adj) SELECT v, CAST(deg AS BIGINT) AS deg FROM r WHERE upto - deg <= {CAPACITY}")(lambda s, d: G.hot_vertices(G.degrees(und(s, d)), CAPACITY))


@query("g_domains", ADJ + BLOCKS + " SELECT DISTINCT a.block_id, b.block_id AS other_block, src AS v FROM und JOIN blocks a ON src >= a.start_v AND src < a.end_v JOIN blocks b ON dst >= b.start_v AND dst < b.end_v", recursive=True)
def domains(s, d):
    return G.neighbour_domains(und(s, d), blocks(adj(s, d)))


# Samplers

PAIRS = """, pairs AS (SELECT p.src AS prev, p.nbrs AS pn, p.deg AS pd, c.src AS cur, c.nbrs AS cn, c.deg AS cd FROM (SELECT src, nbrs, deg, unnest(nbrs) AS v FROM adj) p JOIN adj c ON c.src = p.v),
steps AS (SELECT *, unnest(cn) AS next FROM pairs)"""
#: All steps of the graph are the sum of its squared degrees; a row for each edge (prev, cur) sums up those that follow it.
STEP_SUMS = "count(*) AS n_next, CAST(sum(w) AS BIGINT) AS w_sum, CAST(sum(w * next) AS BIGINT) AS w_next, round(max(w) / sum(w), 6) AS top_prob, round(sum(CAST(ratio AS DOUBLE)), 4) AS ratio_sum"


def _transition_sql(w: str, ratio: str, more: str = "") -> str:
    return ADJ + PAIRS + f", k AS (SELECT prev, cur, next, CAST({w} AS BIGINT) AS w, {ratio} AS ratio FROM steps {more}) SELECT prev, cur, {STEP_SUMS} FROM k GROUP BY prev, cur"


def _transitions(kind: str, cfg: WalkConfig):
    """The steps from all previous vertices, summed up by edge."""
    def f(s, d):
        w = F.col("w")
        sums = (F.count(F.lit(1)).alias("n_next"), F.sum(w).alias("w_sum"), F.sum(w * F.col("next")).alias("w_next"), F.round(F.max("prob"), 6).alias("top_prob"), F.round(F.sum("ratio"), 4).alias("ratio_sum"))
        return P.transitions(adj(s, d), kind, cfg).groupBy("prev", "cur").agg(*sums)

    return f


N2V_W = "CASE WHEN next = prev THEN 1 WHEN list_contains(pn, next) THEN 4 ELSE 16 END"
N2V_RATIO = "CASE WHEN next = prev THEN 0.0625 WHEN list_contains(pn, next) THEN 0.25 ELSE 1.0 END"
query("s_n2v_transition", _transition_sql(N2V_W, N2V_RATIO))(_transitions("node2vec", CFG))
AR_W = "4 * pd + CASE WHEN list_contains(pn, next) THEN cd ELSE 0 END"
query("s_ar_transition", _transition_sql(AR_W, "(CAST(0.8 AS DOUBLE) / cd + CASE WHEN list_contains(pn, next) THEN CAST(0.2 AS DOUBLE) / pd ELSE 0 END) / (CAST(0.8 AS DOUBLE) / cd + CAST(0.2 AS DOUBLE) / pd)"))(_transitions("ar", CFG))
LINK_W = "CASE WHEN next = prev THEN (CASE WHEN cd = 1 THEN 1 ELSE 0 END) ELSE c * 1048576 // (2 + pd + x.deg - c) END"
LINK_RATIO = "CASE WHEN next = prev THEN (CASE WHEN cd = 1 THEN 1.0 ELSE 0.0 END) ELSE CAST(c AS DOUBLE) / (2 + pd + x.deg - c) END"
query("s_linkscan_transition", _transition_sql(LINK_W, LINK_RATIO, "JOIN (SELECT prev, next, count(*) AS c FROM steps GROUP BY prev, next) z USING (prev, next) JOIN adj x ON x.src = next"))(
    lambda s, d: linkscan_sums(adj(s, d)).withColumns({"top_prob": F.round("top_prob", 6), "ratio_sum": F.round("ratio_sum", 4)}))


@query("s_acceptance", ADJ + PAIRS + f", k AS (SELECT prev, cur, CAST({N2V_RATIO} AS DOUBLE) AS ratio FROM steps) SELECT prev, cur, ratio, count(*) AS n_next FROM k GROUP BY prev, cur, ratio")
def acceptance(s, d):
    """How many next vertices each acceptance ratio holds for, by edge."""
    return P.transitions(adj(s, d), "node2vec", CFG).groupBy("prev", "cur", "ratio").agg(F.count(F.lit(1)).alias("n_next"))


query("s_uniform_neighbour", ADJ + f" SELECT src AS v, nbrs[1 + {u32_sql(str(SEED), 'src', '0')} % deg] AS next FROM adj")(lambda s, d: P.deepwalk(adj(s, d), WalkConfig(walk_length=1, seed=SEED)).where("step = 1").select(F.col("walk_id").alias("v"), F.col("vertex").alias("next")))


@query("s_membership", ADJ + PAIRS + " SELECT prev, cur, CAST(len(list_intersect(pn, cn)) AS INTEGER) AS n_common FROM pairs")
def membership(s, d):
    a = adj(s, d)
    pairs = a.select(F.col("src").alias("prev"), F.col("nbrs").alias("pn"), F.explode("nbrs").alias("cur")).join(a.select(F.col("src").alias("cur"), F.col("nbrs").alias("cn")), "cur")
    return pairs.select("prev", "cur", F.size(F.array_intersect("pn", "cn")).alias("n_common"))


#: Weights of no class: here the degrees of the neighbours. A draw for each vertex.
WEIGHTED = f""", c AS (SELECT a.src, b.src AS x, b.deg AS w, sum(b.deg) OVER (PARTITION BY a.src ORDER BY b.src) AS upto, sum(b.deg) OVER (PARTITION BY a.src) AS total FROM (SELECT src, unnest(nbrs) AS v FROM adj) a JOIN adj b ON b.src = a.v)
SELECT src AS v, min(x) AS next FROM c WHERE upto > ({u32_sql(str(SEED), 'src', "'w'")} * CAST(total AS BIGINT)) // 4294967296 GROUP BY src"""


@query("s_weighted_neighbour", ADJ + WEIGHTED)
def weighted_neighbour(s, d):
    a = adj(s, d)
    near = a.select("src", F.explode("nbrs").alias("x")).join(a.select(F.col("src").alias("x"), F.col("deg").cast("bigint").alias("w")), "x")
    listed = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("c"))
    draw = below(u32(SEED, F.col("src"), "w"), F.aggregate("c", F.lit(0).cast("bigint"), lambda t, c: t + c["w"]))
    return listed.withColumn("k", draw).select(F.col("src").alias("v"), P.pick_by_weight(F.col("c"), F.col("k")).alias("next"))


# Walks. The SQL walks on as long as there is a next vertex; rows (wid, step, prev, cur).

def _walk_sql(init: str, edges: int, weights: tuple[str, str, str], stop: str = "", graph: str = ADJ) -> str:
    """Second-order walks by class weights in terms of pd and cd, degrees of the previous and the current vertex."""
    back, common, other = weights
    u = u32_sql(str(SEED), "w.wid", "w.step")
    return f"""{graph}, w(wid, step, prev, cur) AS (
  SELECT wid, CAST(1 AS BIGINT), source, nbrs[1 + {u32_sql(str(SEED), 'wid', '0')} % deg] FROM ({init}) z JOIN adj ON src = source
  UNION ALL
  SELECT wid, step + 1, cur, CASE WHEN k < b THEN prev WHEN k < b + len(common) * {common} THEN common[1 + (k - b) // {common}] ELSE other[1 + (k - b - len(common) * {common}) // {other}] END
  FROM (SELECT *, (u * (b + len(common) * {common} + len(other) * {other})) // 4294967296 AS k
    FROM (SELECT w.wid, w.step, w.prev, w.cur, p.deg AS pd, c.deg AS cd, CASE WHEN list_contains(c.nbrs, w.prev) THEN {back} ELSE 0 END AS b, list_sort(list_filter(c.nbrs, lambda x: x <> w.prev AND list_contains(p.nbrs, x))) AS common,
        list_sort(list_filter(c.nbrs, lambda x: x <> w.prev AND NOT list_contains(p.nbrs, x))) AS other, {u} AS u
      FROM w JOIN adj c ON c.src = w.cur JOIN adj p ON p.src = w.prev WHERE w.step < {edges} {stop}) y) q)
SELECT wid AS walk_id, step, cur AS vertex FROM w UNION ALL SELECT wid, 0, source FROM ({init}) z JOIN adj ON src = source"""


ALL = "SELECT src AS wid, src AS source FROM adj"
TWO = "SELECT src * 2 + r AS wid, src AS source FROM adj, (VALUES (0), (1)) v(r)"
LISTED = "SELECT position * 20 + r AS wid, source FROM (VALUES " + ", ".join(f"({i}, CAST({v} AS BIGINT))" for i, v in enumerate(SOURCES)) + ") v(position, source), range(20) t(r)"
DECAY = f"AND {u32_sql(str(SEED), 'w.wid', 'w.step', chr(39) + 'd' + chr(39))} <= {int(Fraction(17, 20) * (1 << 32))}"
N2V, BFS, AR = ("1", "4", "16"), ("16", "4", "1"), ("(4 * pd)", "(4 * pd + cd)", "(4 * pd)")


def _walks(df: DataFrame) -> DataFrame:
    return df.select("walk_id", F.col("step").cast("bigint").alias("step"), "vertex")


query("w_node2vec", _walk_sql(ALL, 6, N2V), True)(lambda s, d: _walks(P.node2vec(adj(s, d), CFG)))
query("w_node2vec_bfs", _walk_sql(TWO, 6, BFS), True)(lambda s, d: _walks(P.node2vec(adj(s, d), WalkConfig(walk_length=5, walks_per_vertex=2, p=Fraction(1, 4), q=Fraction(4)))))
query("w_ar", _walk_sql(ALL, 6, AR), True)(lambda s, d: _walks(P.autoregressive(adj(s, d), CFG)))
query("w_ppr", _walk_sql(LISTED, 10, N2V, DECAY), True)(lambda s, d: _walks(ppr_walks(s, d)))
query("w_ar_ppr", _walk_sql(LISTED, 10, AR, DECAY), True)(lambda s, d: _walks(P.autoregressive_ppr(adj(s, d), WalkConfig(walk_length=10, walks_per_vertex=20), starts(s, SOURCES))))


def ppr_walks(s, d):
    return P.ppr(adj(s, d), WalkConfig(walk_length=10, walks_per_vertex=20, p=CFG.p, q=CFG.q), starts(s, SOURCES))


def _deepwalk_sql(graph: str, who: str, edges: int) -> str:
    return f"""{graph}, w(wid, step, cur) AS (SELECT v, CAST(0 AS BIGINT), v FROM ({who}) z UNION ALL
  SELECT wid, step + 1, nbrs[1 + {u32_sql(str(SEED), 'wid', 'step')} % deg] FROM w JOIN adj ON src = cur WHERE step < {edges}) SELECT wid AS walk_id, step, cur AS vertex FROM w"""


query("w_deepwalk", _deepwalk_sql(ADJ, "SELECT src AS v FROM adj", 8), True)(lambda s, d: _walks(P.deepwalk(adj(s, d), WalkConfig(walk_length=8))))


@query("w_deepwalk_directed", _deepwalk_sql(DIRECTED, "SELECT src AS v FROM und UNION SELECT dst FROM und", 8), True)
def deepwalk_directed(s, d):
    e = written(directed(s, d))
    return _walks(P.deepwalk(written(G.adjacency(e)), WalkConfig(walk_length=8), vertices=G.distinct_vertices(e)))


LINK_STEP = "CASE WHEN x.src = w.prev THEN 0 ELSE len(list_intersect(p.nbrs, x.nbrs)) * 1048576 // (2 + p.deg + x.deg - len(list_intersect(p.nbrs, x.nbrs))) END"


def _linkscan_step(i: int) -> str:
    """Step i as tables of its own: window functions do not stand in the recursive part."""
    return f""", s{i} AS (SELECT w.wid, w.cur, w.prev, c.deg AS cd, x.src AS x, {LINK_STEP} AS wt FROM w{i} w JOIN adj c ON c.src = w.cur JOIN adj p ON p.src = w.prev JOIN und e ON e.src = w.cur JOIN adj x ON x.src = e.dst),
t{i} AS (SELECT *, sum(wt) OVER (PARTITION BY wid ORDER BY x) AS upto, ({u32_sql(str(SEED), 'wid', str(i))} * CAST(sum(wt) OVER (PARTITION BY wid) AS BIGINT)) // 4294967296 AS k FROM s{i}),
w{i + 1} AS (SELECT wid, any_value(cur) AS prev, CASE WHEN any_value(cd) = 1 THEN any_value(prev) ELSE min(CASE WHEN upto > k THEN x END) END AS cur FROM t{i} GROUP BY wid)"""


LINKSCAN = ADJ + f", w1 AS (SELECT src AS wid, src AS prev, nbrs[1 + {u32_sql(str(SEED), 'src', '0')} % deg] AS cur FROM adj)" + _linkscan_step(1) + _linkscan_step(2) + " SELECT wid AS walk_id, CAST(0 AS BIGINT) AS step, wid AS vertex FROM w1" + "".join(f" UNION ALL SELECT wid, {i}, cur FROM w{i}" for i in (1, 2, 3))
query("w_linkscan", LINKSCAN)(lambda s, d: _walks(P.linkscan(adj(s, d), WalkConfig(walk_length=2))))

FANOUT = [5, 3, 2]


def _fanout_sql() -> str:
    sql = ADJ + ", l0 AS (SELECT src AS root, CAST(0 AS BIGINT) AS ordinal, src AS vertex FROM adj)"
    for i, n in enumerate(FANOUT):
        sql += f", l{i + 1} AS (SELECT root, CAST(ordinal * {n} + j AS BIGINT) AS ordinal, nbrs[1 + {u32_sql(str(SEED), 'root', str(i), 'ordinal', 'j')} % deg] AS vertex FROM l{i} JOIN adj ON src = vertex, range({n}) t(j))"
    return sql + " UNION ALL".join(f" SELECT root, {i} AS level, ordinal, vertex FROM l{i}" for i in range(len(FANOUT) + 1))


@query("w_fanout", _fanout_sql())
def fanout(s, d):
    """The sampled neighbourhood of every vertex that has neighbours."""
    a = adj(s, d)
    return P.fanout(a, a.where("deg > 0").select(F.col("src").alias("source")), FANOUT, SEED)


REPLICAS, ROOTS, BUDGET = 8, 5, 12


def _frontier_sql() -> str:
    """Step by step: the list of a replica, in the order of places, and its running degrees."""
    slots = f"SELECT r AS replica, CAST(j AS BIGINT) AS place, src AS vertex, deg, nbrs FROM (SELECT r, j, {u32_sql(str(SEED), 'r', 'j', chr(39) + 'root' + chr(39))} % (SELECT count(*) FROM adj) AS n FROM range({REPLICAS}) a(r), range({ROOTS}) b(j)) z JOIN numbered USING (n)"
    sql = ADJ + f", numbered AS (SELECT *, row_number() OVER (ORDER BY src) - 1 AS n FROM adj), f0 AS ({slots})"
    for i in range(BUDGET - ROOTS):
        k = f"({u32_sql(str(SEED), 'replica', str(i), '0')} * CAST(sum(deg) OVER (PARTITION BY replica) AS BIGINT)) // 4294967296"
        sql += f""", r{i} AS (SELECT *, sum(deg) OVER (PARTITION BY replica ORDER BY place) AS upto, {k} AS k FROM f{i}),
n{i} AS (SELECT replica, CAST({ROOTS + i} AS BIGINT) AS place, nbrs[1 + {u32_sql(str(SEED), 'replica', str(i), '1')} % deg] AS vertex FROM r{i} WHERE k < upto AND k >= upto - deg),
f{i + 1} AS (SELECT replica, place, vertex, deg, nbrs FROM r{i} WHERE NOT (k < upto AND k >= upto - deg) UNION ALL SELECT replica, place, vertex, deg, nbrs FROM n{i} JOIN adj ON src = vertex)"""
    return sql + " SELECT replica, place AS step, vertex FROM f0" + "".join(f" UNION ALL SELECT replica, place, vertex FROM n{i}" for i in range(BUDGET - ROOTS))


query("w_frontier", _frontier_sql())(lambda s, d: P.frontier_sample(adj(s, d), REPLICAS, ROOTS, BUDGET, SEED))

# The bipartite graph of suppliers and parts, whose suppliers are hubs.

HUBS = """e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), und AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
adj AS (SELECT src, list(dst ORDER BY dst) AS nbrs, count(*) AS deg FROM und GROUP BY src)"""
query("w_node2vec_hubs", _walk_sql(ALL, 4, N2V, graph=HUBS), True)(lambda s, d: _walks(P.node2vec(in_buckets(G.adjacency(supplier_part_edges(s, d)), "src"), WalkConfig(walk_length=3, p=CFG.p, q=CFG.q))))

# Results

N2V_STEPS = "w_node2vec"


def _steps(s, d):
    return QUERIES[N2V_STEPS](s, d)


def _over(sql: str, tail: str) -> str:
    """The rows of a walk query as the table st."""
    head, last = sql.rsplit("\nSELECT wid AS walk_id", 1)
    return head + ", st AS (SELECT wid AS walk_id" + last + ")" + tail


W_SQL, PPR_SQL = _walk_sql(ALL, 6, N2V), _walk_sql(LISTED, 10, N2V, DECAY)
VISITS = ", vis AS (SELECT vertex, count(*) AS cnt FROM st WHERE step > 0 GROUP BY vertex)"
query("r_visits", _over(W_SQL, VISITS + " SELECT vertex, cnt FROM vis"), True)(lambda s, d: S.visits(_steps(s, d)))
query("r_visit_prob", _over(W_SQL, VISITS + " SELECT vertex, round(cnt / (SELECT sum(cnt) FROM vis), 9) AS prob FROM vis"), True)(lambda s, d: S.visit_probability(S.visits(_steps(s, d))).withColumn("prob", F.round("prob", 9)))
query("r_top_visits", _over(W_SQL, VISITS + " SELECT vertex, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, vertex) AS INTEGER) AS rank FROM vis ORDER BY cnt DESC, vertex LIMIT 100"), True)(lambda s, d: G.ranked(S.visits(_steps(s, d)), "cnt", 100, "vertex"))
PPR_SCORES = """, l AS (SELECT walk_id // 20 AS source_no, arg_max(vertex, step) AS vertex FROM st GROUP BY walk_id), e AS (SELECT source_no, vertex, count(*) / 20 AS ppr_terminal FROM l GROUP BY ALL),
n AS (SELECT walk_id // 20 AS source_no, vertex, count(*) AS n FROM st WHERE step > 0 GROUP BY ALL), f AS (SELECT source_no, vertex, n / sum(n) OVER (PARTITION BY source_no) AS ppr_visit FROM n)
SELECT source_no, vertex, round(coalesce(ppr_terminal, 0), 9) AS ppr_terminal, round(coalesce(ppr_visit, 0), 9) AS ppr_visit FROM e FULL JOIN f USING (source_no, vertex)"""
query("r_ppr", _over(PPR_SQL, PPR_SCORES), True)(lambda s, d: S.ppr_scores(ppr_walks(s, d), 20).select("source_no", "vertex", F.round("ppr_terminal", 9).alias("ppr_terminal"), F.round("ppr_visit", 9).alias("ppr_visit")))
TRUTH = ", acc AS (SELECT src AS vertex, deg / (SELECT sum(deg) FROM adj) AS acc FROM adj ORDER BY deg DESC, src LIMIT 100)"


@query("r_rel_error", _over(W_SQL, VISITS + TRUTH + " SELECT count(*) AS n, round(avg(abs(coalesce(cnt / (SELECT sum(cnt) FROM vis), 0) - acc) / acc), 6) AS error FROM acc LEFT JOIN vis USING (vertex)"), True)
def rel_error(s, d):
    a = adj(s, d)
    truth = S.visit_probability(a.select(F.col("src").alias("vertex"), F.col("deg").alias("cnt")))
    found = S.visit_probability(S.visits(P.node2vec(a, CFG)))
    return S.mean_relative_error(found, truth, 100).withColumn("error", F.round("error", 6))


query("r_total_steps", _over(W_SQL, " SELECT count(*) AS total_steps FROM st WHERE step > 0"), True)(lambda s, d: S.total_steps(_steps(s, d)))


def _with_blocks(f):
    def g(s, d):
        a = adj(s, d)
        return f(written(P.node2vec(a, CFG)), blocks(a), a)

    return g


B_SQL = _over(_walk_sql(ALL, 6, N2V, graph=ADJ + BLOCKS), "")
PLACED = ", pl AS (SELECT * FROM st JOIN blocks ON vertex >= start_v AND vertex < end_v)"
query("r_walks_per_block", B_SQL + PLACED + " SELECT block_id, step, count(*) AS n_walks FROM pl GROUP BY ALL", True)(_with_blocks(lambda st, b, a: S.walks_per_block(_walks(st), b)))
query("r_activated", B_SQL + PLACED + ", sz AS (SELECT block_id, count(*) AS nv, CAST(sum(deg) AS BIGINT) AS ne FROM blocks JOIN adj ON src >= start_v AND src < end_v GROUP BY ALL), dv AS (SELECT DISTINCT step, vertex, block_id FROM pl) SELECT step, block_id, count(*) AS activated, CAST(sum(deg) AS BIGINT) AS used_edges, any_value(nv) AS total_vertices, any_value(ne) AS total_edges FROM dv JOIN adj ON src = vertex JOIN sz USING (block_id) GROUP BY step, block_id", True)(_with_blocks(lambda st, b, a: S.activated(_walks(st), b, a)))
query("r_block_choice", B_SQL + ", la AS (SELECT walk_id, arg_max(vertex, step) AS vertex, max(step) AS hop FROM st GROUP BY walk_id), pb AS (SELECT block_id, count(*) AS n, min(hop) AS hop FROM la JOIN blocks ON vertex >= start_v AND vertex < end_v GROUP BY ALL) SELECT (SELECT block_id FROM pb ORDER BY n DESC, block_id LIMIT 1) AS most_walks, (SELECT block_id FROM pb ORDER BY hop, block_id LIMIT 1) AS least_hop", True)(_with_blocks(lambda st, b, a: S.block_choice(_walks(st), b)))

STAT = "SELECT event_type AS key, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1"
query("r_metrics", "z AS (SELECT 1) " + STAT)(lambda s, d: S.running_stats(table(s, d, "events"), "event_type", "value").withColumn("sum", F.round("sum", 4)).withColumn("avg", F.round("avg", 6)))
query("r_round_average", "z AS (SELECT 1) SELECT event_type AS key, round(avg(value), 6) AS mean FROM events GROUP BY 1")(lambda s, d: S.round_average(table(s, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6)))

# Learned loading. A block log made of order lines: supplier as block, quantity and price as sizes and times.
LOG = "SELECT l_suppkey % 8 AS block_id, 100 AS nverts, CAST(l_quantity * 3 AS BIGINT) AS nwalks, CAST({a} AS DOUBLE) AS load_time, CAST({b} AS DOUBLE) AS exec_time FROM lineitem WHERE l_linenumber = {n}"
FULL = LOG.format(a="2 + l_discount", b="l_quantity * 0.03 + l_tax", n=1)
DEMAND = LOG.format(a="l_discount", b="0.5 + l_quantity * 0.12", n=2)
THRESHOLDS = f"""fl0 AS ({FULL}), od0 AS ({DEMAND}), fl AS (SELECT block_id, nwalks / nverts AS x, load_time + exec_time AS y FROM fl0 WHERE nwalks < nverts), od AS (SELECT block_id, nwalks / nverts AS x, load_time + exec_time AS y FROM od0),
line AS (SELECT block_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n FROM fl GROUP BY 1), n_od AS (SELECT block_id, count(*) AS m FROM od GROUP BY 1),
fit AS (SELECT block_id, regr_slope(y, x) AS a2, regr_intercept(y, x) AS b2 FROM od JOIN line USING (block_id) WHERE y < b GROUP BY 1),
th AS (SELECT block_id, coalesce(CASE WHEN n >= 8 AND m >= 8 THEN (b2 - b) / (a - a2) END, 0) AS ths FROM (SELECT block_id FROM fl0 UNION SELECT block_id FROM od0) e LEFT JOIN line USING (block_id) LEFT JOIN n_od USING (block_id) LEFT JOIN fit USING (block_id))"""


def _thresholds(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("meander_lineitem")
    full, demand = (s.sql(x.replace("FROM lineitem", "FROM meander_lineitem")) for x in (FULL, DEMAND))
    return S.load_thresholds(full, demand)


def _decision(lines: DataFrame, s, d):
    return S.load_decision(lines.selectExpr("l_suppkey % 8 AS block_id", "l_partkey % 100 AS nwalks", "100 AS nverts", "l_linenumber = 4 AS resident"), _thresholds(s, d))


query("l_thresholds", THRESHOLDS + " SELECT block_id, round(ths, 6) AS ths FROM th")(lambda s, d: _thresholds(s, d).withColumn("ths", F.round("ths", 6)))
WALKS = "l_suppkey % 8 AS block_id, l_partkey % 100 AS nwalks, 100 AS nverts, l_linenumber = 4 AS resident"
MODE = "CASE WHEN ths > 0 AND nwalks < ths * nverts AND NOT resident THEN 'on_demand' ELSE 'full' END AS mode"
query("l_decision", THRESHOLDS + f", wk AS (SELECT {WALKS} FROM lineitem) SELECT block_id, {MODE} FROM wk JOIN th USING (block_id)")(
    lambda s, d: S.load_decision(table(s, d, "lineitem").selectExpr(*WALKS.split(", ")), _thresholds(s, d)))

#: Thresholds by pairs of blocks: the block and a smaller one.
PAIRED = "SELECT *, block_id % 3 AS other_block FROM ({log}) q WHERE block_id >= 3"
PAIR_SQL = THRESHOLDS.replace(f"fl0 AS ({FULL})", f"fl0 AS ({PAIRED.format(log=FULL)})").replace(f"od0 AS ({DEMAND})", f"od0 AS ({PAIRED.format(log=DEMAND)})")


def _pair_thresholds(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("meander_lineitem")
    full, demand = (s.sql(PAIRED.format(log=x.replace("FROM lineitem", "FROM meander_lineitem"))) for x in (FULL, DEMAND))
    return S.pair_thresholds(full, demand)


query("l_pair_thresholds", PAIR_SQL + " SELECT block_id, block_id % 3 AS other_block, round(ths, 6) AS ths FROM th")(lambda s, d: _pair_thresholds(s, d).withColumn("ths", F.round("ths", 6)))
query("l_pair_decision", PAIR_SQL + f", wk AS (SELECT {WALKS} FROM lineitem) SELECT block_id, block_id % 3 AS other_block, {MODE} FROM wk JOIN th USING (block_id)")(
    lambda s, d: S.load_decision(table(s, d, "lineitem").selectExpr(*WALKS.split(", ")).where("block_id >= 3").withColumn("other_block", F.col("block_id") % 3), _pair_thresholds(s, d)))


# Files: written to the shared folder and read back.

def _file(s: SparkSession, write) -> str:
    path = new_path(s)
    write(path)
    return path


query("f_edge_file", UND + " SELECT src, dst FROM und")(lambda s, d: text.read_edges(s, _file(s, lambda p: sinks.write_edges(und(s, d), p, "\t"))))
query("f_dense_ids", UND + SEEN + " SELECT old, new FROM ids")(lambda s, d: G.first_seen_ids(text.read_edges(s, _file(s, lambda p: sinks.write_edges(und(s, d), p)), numbered=True), "line"))
query("f_starts_file", "z AS (SELECT o_custkey AS source, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) SELECT position, source FROM z WHERE position < 100")(
    lambda s, d: text.read_starts(s, _file(s, lambda p: sinks.write_starts(table(s, d, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("source")), p)), 100))
query("f_partition_file", f"z AS (SELECT p_partkey AS v FROM part), n AS (SELECT row_number() OVER (ORDER BY v) - 1 AS vertex, v % {N_BLOCKS} AS block_id FROM z) SELECT vertex, CAST(block_id AS INTEGER) AS block_id FROM n")(
    lambda s, d: text.read_partition(s, _file(s, lambda p: sinks.write_partition(table(s, d, "part").select(F.col("p_partkey").alias("vertex"), (F.col("p_partkey") % N_BLOCKS).alias("block_id")), p))))
query("f_threshold_file", THRESHOLDS + " SELECT row_number() OVER (ORDER BY block_id) - 1 AS line, round(ths, 6) AS value FROM th")(
    lambda s, d: text.read_numbers(s, _file(s, lambda p: sinks.write_thresholds(_thresholds(s, d), p))).withColumn("value", F.round("value", 6)))
query("f_pair_threshold_file", "z AS (SELECT a AS block_id, b AS other_block, a / 8 + b / 64 AS ths FROM range(8) x(a), range(8) y(b) WHERE b < a) SELECT CAST(block_id AS INTEGER) AS block_id, CAST(other_block AS INTEGER) AS other_block, ths FROM z")(
    lambda s, d: text.read_pair_thresholds(s, _file(s, lambda p: sinks.write_pair_thresholds(s.range(8).toDF("block_id").join(s.range(8).toDF("other_block"), F.col("other_block") < F.col("block_id")).withColumn("ths", F.col("block_id") / 8 + F.col("other_block") / 64), p))))


@query("f_block_range_file", ADJ + BLOCKS + " SELECT block_id, start_v, end_v FROM blocks", recursive=True)
def block_range_file(s, d):
    return text.read_block_starts(s, _file(s, lambda p: sinks.write_block_starts(blocks(adj(s, d)), p)))


@query("f_facts", ADJ + " SELECT max(src) + 1 AS n_vertices, CAST(max(deg) AS BIGINT) AS max_deg FROM adj")
def facts(s, d):
    n, deg = new_path(s), new_path(s)
    sinks.write_facts(adj(s, d), n, deg)
    one, two = (text.read_numbers(s, p, "bigint") for p in (n, deg))
    return one.join(two.withColumnRenamed("value", "max_deg"), "line").select(F.col("value").alias("n_vertices"), "max_deg")


@query("f_adjacency_file", ADJ + " SELECT src, deg, array_to_string(nbrs, ',') AS nbrs_csv FROM adj")
def adjacency_file(s, d):
    return _csv(s.read.parquet(_file(s, lambda p: sinks.write_adjacency(G.adjacency(und(s, d)), p))))


query("f_metis_file", "z AS (SELECT 1), " + ORACLE_SQL["g_metis_lines"].removeprefix("WITH "))(
    lambda s, d: text.numbered_lines(s, _file(s, lambda p: sinks.write_metis(G.adjacency(und(s, d), G.vertex_count(und(s, d)).first()[0]), p)), keep_all=True).select(F.col("line").alias("line_no"), F.col("value").alias("line")))


@query("f_block_log", B_SQL + PLACED + ", sz AS (SELECT block_id, count(*) AS nverts, CAST(sum(deg) AS BIGINT) AS nedges FROM blocks JOIN adj ON src >= start_v AND src < end_v GROUP BY ALL), ld AS (SELECT step, block_id, count(*) AS nwalks FROM pl GROUP BY ALL) SELECT block_id, nverts, nedges, nwalks, CAST(nedges / 1000 AS DOUBLE) AS load_time, CAST(nwalks / 1000 AS DOUBLE) AS exec_time FROM ld JOIN sz USING (block_id)", True)
@_with_blocks
def block_log(st, b, a):
    """The loads of a run with times of a made-up disk: a thousand edges, or walks, a second."""
    log = S.block_log(_walks(st), b, a).withColumns({"load_time": F.col("nedges") / 1000, "exec_time": F.col("nwalks") / 1000})
    return text.read_block_log(a.sparkSession, _file(a.sparkSession, lambda p: sinks.write_block_log(log, p)))


USED = ORACLE_SQL["r_activated"].removeprefix("WITH RECURSIVE ")


def _use_log(how: str):
    @_with_blocks
    def f(st, b, a):
        path = _file(a.sparkSession, lambda p: sinks.write_use_log(S.activated(_walks(st), b, a), p, how))
        log = a.sparkSession.read.csv(path, header=True, inferSchema=True)
        return log.toDF("io_num", "block_id", "block_type", "used", "total").withColumns({c: F.col(c).cast("bigint") for c in ("io_num", "block_id", "used", "total")})

    return f


def _use_sql(used: str, total: str) -> str:
    head, last = USED.rsplit(" SELECT step, block_id, count(*) AS activated", 1)
    return head + ", ac AS (SELECT step, block_id, count(*) AS activated" + last + f") SELECT row_number() OVER (ORDER BY step, block_id) - 1 AS io_num, CAST(block_id AS BIGINT) AS block_id, 'static-block' AS block_type, {used} AS used, {total} AS total FROM ac"


query("f_edge_use_log", _use_sql("used_edges", "total_edges"), True)(_use_log("edges"))
query("f_vertex_use_log", _use_sql("activated", "total_vertices"), True)(_use_log("vertices"))


@query("f_metrics_files", "z AS (SELECT 1), m AS (" + STAT + ") SELECT 'csv' AS how, key, count, max FROM m UNION ALL SELECT 'json', key, count, max FROM m UNION ALL SELECT 'text', key, count, max FROM m")
def metrics_files(s, d):
    m = S.running_stats(table(s, d, "events"), "event_type", "value")
    path = {how: _file(s, lambda p, how=how: sinks.write_metrics(m, p, how)) for how in ("csv", "json", "text")}
    pairs = s.read.text(path["text"]).select(F.regexp_extract("value", "^(.*)\\.([a-z]+)=(.*)$", 1).alias("key"), F.regexp_extract("value", "^(.*)\\.([a-z]+)=(.*)$", 2).alias("c"), F.regexp_extract("value", "^(.*)\\.([a-z]+)=(.*)$", 3).alias("x"))
    found = {"csv": s.read.csv(path["csv"], header=True), "json": s.read.json(path["json"]), "text": pairs.groupBy("key").pivot("c", ["count", "max"]).agg(F.first("x"))}
    parts = [f.select(F.lit(how).alias("how"), "key", F.col("count").cast("bigint").alias("count"), F.col("max").cast("double").alias("max")) for how, f in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


#: Block sizes by the rule for a setting of 0, for some numbers of walks for each vertex.
query("g_default_blocks", ADJ + ", n AS (SELECT max(src) + 1 AS v FROM adj) SELECT r AS walks_per_vertex, CAST(pow(2, 10 + length(CAST(v * r AS VARCHAR))) AS BIGINT) AS blocksize_kb, CAST(pow(2, 10 + length(CAST(v * r AS VARCHAR))) AS BIGINT) * 256 AS capacity FROM n, (VALUES (1), (10), (1000)) t(r)")(
    lambda s, d: (lambda v: s.createDataFrame([(r, (kb := G.default_block_kb(v, r)), G.capacity_of(kb)) for r in (1, 10, 1000)], "walks_per_vertex int, blocksize_kb long, capacity long"))(G.vertex_count(raw(s, d)).first()[0]))


@query("r_choose_block", B_SQL + f", la AS (SELECT walk_id, arg_max(vertex, step) AS vertex, max(step) AS hop FROM st GROUP BY walk_id), pb AS (SELECT block_id, count(*) AS n, min(hop) AS hop FROM la JOIN blocks ON vertex >= start_v AND vertex < end_v GROUP BY ALL), dr AS (SELECT i, {u32_sql(str(SEED), 'i', chr(39) + 'block' + chr(39))} / 4294967296 AS u FROM range(16) t(i)) SELECT CAST(i AS INTEGER) AS i, CASE WHEN u < 0.2 THEN (SELECT block_id FROM pb ORDER BY hop, block_id LIMIT 1) ELSE (SELECT block_id FROM pb ORDER BY n DESC, block_id LIMIT 1) END AS block_id FROM dr", True)
@_with_blocks
def choose_block(st, b, a):
    """Sixteen draws of the choice, one for each number."""
    return S.choose_block(_walks(st), b, 0.2, u32(SEED, F.col("i"), "block") / F.lit(1 << 32), 16)
