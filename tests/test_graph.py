"""Hand-worked values on a toy graph, invariants of walks, sources and sinks."""

from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from meander import catalogue
from meander.operators import graph as G
from meander.operators import stats as S
from meander.plans import walks as P
from meander.plans.config import WalkConfig
from meander.plans.similarity import linkscan_sums
from meander.sources import sinks, tables, text
from meander.sources.tables import in_buckets, written

TOY = [(0, 1), (0, 2), (1, 2), (1, 3), (3, 4)]


@pytest.fixture(scope="module")
def toy(spark):
    return G.undirected(spark.createDataFrame(TOY, "src long, dst long")).cache()


@pytest.fixture(scope="module")
def adj(toy):
    return G.adjacency(toy, 5).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_offsets_and_degrees(adj):
    assert [r.beg_pos for r in G.offsets(adj).orderBy("v").collect()] == [0, 2, 5, 7, 9, 10]
    assert adj.agg({"deg": "max"}).first()[0] == 3


def test_blocks_partitions_and_cut(spark, toy, adj):
    assert rows(G.sequential_blocks(adj, 4), "start_v", "end_v") == [(0, 1), (1, 2), (2, 4), (4, 5)]
    two = spark.createDataFrame([(0, 0, 3), (1, 3, 5)], "block_id int, start_v long, end_v long")
    assert S.edge_cut(toy, two).first()[0] == 2 and S.edge_cut(toy, two).first()[2] == pytest.approx(0.2)
    got = {r.v: (r.block_id, r.new_id) for r in G.snake_partition(G.degrees(toy), 2).collect()}
    assert {v: n for v, (_, n) in got.items()} == {1: 0, 3: 1, 4: 2, 0: 3, 2: 4}
    assert rows(G.hot_vertices(G.degrees(toy), 4), "v") == [(0,), (1,)]
    assert S.line_graph_size(adj).first() == (5, 6)


def test_metis_lines(adj):
    assert [r.line for r in sinks.metis_lines(adj).orderBy("line_no").collect()] == ["5\t5", "2 3", "1 3 4", "1 2", "2 5", "4"]


@pytest.mark.parametrize(("kind", "want"), [("node2vec", (1 / 21, 4 / 21, 16 / 21)), ("ar", (8 / 27, 11 / 27, 8 / 27)), ("linkscan", (0, 0.5, 0.5))])
def test_transitions(adj, kind, want):
    cfg = WalkConfig(p=Fraction(4), q=Fraction(1, 4))
    got = {r.next: r.prob for r in P.transitions(adj, kind, cfg).where("prev = 0 and cur = 1").collect()}
    assert [got[0], got[2], got[3]] == pytest.approx(want, abs=1e-5)


def test_degree_one_returns(adj):
    assert [r.next for r in P.transitions(adj, "linkscan", WalkConfig()).where("prev = 3 and cur = 4 and w > 0").collect()] == [3]


@pytest.mark.parametrize(("block_steps", "at_once"), [(1 << 23, 1 << 20), (1 << 23, 50), (400, 1 << 20), (400, 30), (40, 1 << 20)])
def test_linkscan_sums_by_block(spark, block_steps, at_once):
    """Rings, a hub, a clique and a pair under scattered ids, below 0 too: few and many blocks, and vertices that fit none."""
    ring = [(i, (i + k) % 200) for i in range(200) for k in (1, 7)]
    ends = [*ring, *((500, i) for i in range(0, 200, 3)), *((i, j) for i in range(300, 312) for j in range(300, i)), (600, 601)]
    edges = spark.createDataFrame([((a * 7919 % 1009 - 300) << 20, (b * 7919 % 1009 - 300) << 20) for a, b in ends], "src long, dst long")
    a = G.adjacency(G.undirected(edges)).cache()
    w = F.col("w")
    want = P.transitions(a, "linkscan", WalkConfig()).groupBy("prev", "cur").agg(F.count("w"), F.sum("w"), F.sum(w * F.col("next")), F.round(F.max("prob"), 12), F.round(F.sum("ratio"), 9))
    got = linkscan_sums(a, block_steps, at_once)
    assert rows(got.withColumns({"top_prob": F.round("top_prob", 12), "ratio_sum": F.round("ratio_sum", 9)})) == rows(want)


def test_linkscan_sums_of_no_edges(spark):
    assert linkscan_sums(G.adjacency(spark.createDataFrame([], "src long, dst long"))).count() == 0


def test_linkscan_query_deals_no_steps_out(spark):
    """Only lists of neighbours move; windows over the steps, of which there are as many as the sum of squared degrees, filled the disk."""
    plan = catalogue.QUERIES["s_linkscan_transition"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and "Generate" not in plan


def paths(df):
    out = {}
    for r in df.orderBy("walk_id", "step").collect():
        out.setdefault(r.walk_id, []).append(r.vertex)
    return out


@pytest.mark.parametrize("program", ["node2vec", "ar", "linkscan", "deepwalk"])
def test_walks_follow_edges(adj, program):
    got = paths(P.PROGRAMS[program](adj, WalkConfig(walk_length=5)))
    edges = {e for a, b in TOY for e in ((a, b), (b, a))}
    assert len(got) == 5 and {len(p) for p in got.values()} == {6 if program == "deepwalk" else 7}
    assert all(e in edges for p in got.values() for e in zip(p, p[1:], strict=False))


def test_ppr_lengths_repeated_and_lonely_sources(spark, adj):
    starts = spark.createDataFrame([(0, 0), (1, 0), (2, 99)], "position long, source long")
    got = paths(P.ppr(adj, WalkConfig(walk_length=5, walks_per_vertex=50), starts))
    assert len(got) == 100 and all(2 <= len(p) <= 6 for p in got.values())
    assert paths(P.ppr(adj, WalkConfig(walks_per_vertex=0), starts)) == {}


def test_step_distribution_matches_transition_table(adj, spark):
    cfg = WalkConfig(walk_length=1, walks_per_vertex=4000, p=Fraction(4), q=Fraction(1, 4))
    starts = spark.createDataFrame([(0, 0)], "position long, source long")
    got = paths(P.node2vec(adj, cfg, starts))
    seen = Counter(p[2] for p in got.values() if p[1] == 1)
    n = sum(seen.values())
    chi = sum((seen[v] - n * p) ** 2 / (n * p) for v, p in ((0, 1 / 21), (2, 4 / 21), (3, 16 / 21)))
    assert chi < 13.8  # 0.001 at two degrees of freedom


@pytest.mark.parametrize("program", ["node2vec", "ar"])
def test_steps_at_hubs(adj, program):
    """All vertices of two neighbours or more as hubs: the same chances as the table of transitions has."""
    cfg = WalkConfig(walk_length=1, walks_per_vertex=3000, p=Fraction(4), q=Fraction(1, 4), hub_degree=1)
    got = paths(P.PROGRAMS[program](adj, cfg))
    assert len(got) == 15_000
    want = {(r.prev, r.cur, r.next): r.prob for r in P.transitions(adj, program, cfg).collect()}
    seen = Counter(tuple(p) for p in got.values())
    for prev, cur in {k[:2] for k in want}:
        n = sum(c for k, c in seen.items() if k[:2] == (prev, cur))
        cells = [(seen[k], n * x) for k, x in want.items() if k[:2] == (prev, cur)]
        assert n and sum((o - e) ** 2 / e for o, e in cells) < 16.3  # 0.001 at three degrees of freedom, the most there are


def test_hubs_first_order_and_decay(adj, spark):
    plain = WalkConfig(walk_length=5)
    assert paths(P.deepwalk(adj, plain)) == paths(P.deepwalk(adj, WalkConfig(walk_length=5, hub_degree=1)))
    starts = spark.createDataFrame([(0, 0), (1, 3)], "position long, source long")
    got = paths(P.ppr(adj, WalkConfig(walk_length=5, walks_per_vertex=40, on_demand_walks=0, hub_degree=2), starts))
    few = paths(P.ppr(adj, WalkConfig(walk_length=5, walks_per_vertex=40, on_demand_bytes=0), starts))
    many = paths(P.ppr(adj, WalkConfig(walk_length=5, walks_per_vertex=40, on_demand_walks=0), starts))
    assert few == many and {w: len(p) for w, p in got.items()} == {w: len(p) for w, p in many.items()}


def test_adjacency_stays_where_it_is(spark, toy):
    """Without broadcasts a step moves the frontier only: one exchange a step, none for the first."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = in_buckets(G.adjacency(toy), "src")
        step, f = P._class_step(WalkConfig(), P._node2vec_weights), P._frontier(P._starts(a, WalkConfig(), None))
        for i in range(4):
            f = step(f, i, a)
        plan = f.select(*P.STATE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert plan.count("SortMergeJoin") == 4 and plan.count("Exchange") == 3 and plan.count("Bucketed: true") == 5


def test_pick_by_weight(spark):
    df = spark.sql("SELECT d, array(named_struct('x', 5L, 'w', 0L), named_struct('x', 6L, 'w', 2L), named_struct('x', 7L, 'w', 3L), named_struct('x', 8L, 'w', 0L)) AS c FROM range(6) t(d)")
    assert [r[0] for r in df.orderBy("d").select(P.pick_by_weight(F.col("c"), F.col("d"))).collect()] == [6, 6, 7, 7, 7, 7]


def test_lines_keep_their_order(spark, tmp_path):
    """Line numbers of a file that many splits read, comments left out."""
    (tmp_path / "e.txt").write_text("".join(f"{i} {(i * 7919) % 100_003}\n" + ("# c\n" if i % 5 == 0 else "") for i in range(20_000)))
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = text.read_edges(spark, str(tmp_path / "e.txt"), numbered=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert len(got) == 20_000 and all(r.line == r.src for r in got)
    (tmp_path / "f.txt").write_text("7 3\n3 9\n9 7\n1 3\n")
    ids = G.first_seen_ids(text.read_edges(spark, str(tmp_path / "f.txt"), numbered=True), "line")
    assert rows(ids, "old", "new") == [(1, 3), (3, 1), (7, 0), (9, 2)]


def test_block_lookup_and_blocks_of_any_graph(spark):
    """Greedy blocks and the block of each vertex against a plain loop, with gaps, hubs and blocks much smaller than a cell."""
    degrees = {v: (v * 37 % 11) + (500 if v % 97 == 0 else 1) for v in range(3, 5000, 3)}
    a = spark.createDataFrame([(v, d, [0]) for v, d in degrees.items()], "src long, deg int, nbrs array<long>").repartition(7)
    want, start, edges, last = [], 0, 0, -1
    for v, d in degrees.items():
        if last >= 0 and edges + d > 60 and v > start:
            want.append((start, v, edges))
            start, edges = v, 0
        edges, last = edges + d, v
    want.append((start, last + 1, edges))
    b = written(G.sequential_blocks(a, 60))
    assert rows(b, "start_v", "end_v", "n_edges") == want and rows(b, "block_id") == [(i,) for i in range(len(want))]
    got = {r.src: r.block_id for r in G.with_block(a.select("src"), b, "src").collect()}
    assert got == {v: next(i for i, (s, e, _) in enumerate(want) if s <= v < e) for v in degrees}


def test_block_log_feeds_the_training(spark, tmp_path):
    rows_ = [(0, 1, 100, 500, n, 2.0, n / 100) for n in range(10, 100, 10)]
    log = spark.createDataFrame(rows_, "block_id int, other_block int, nverts long, nedges long, nwalks long, load_time double, exec_time double")
    sinks.write_block_log(log, str(tmp_path / "full"))
    sinks.write_block_log(log.withColumns({"load_time": F.lit(0.5), "exec_time": F.col("nwalks") * 0.04}), str(tmp_path / "demand"))
    assert spark.read.csv(str(tmp_path / "full"), header=True).columns == ["dynamic-block-id", "static-block-id", "nverts", "nedges", "nwalks", "load-block-time", "exec-block-time"]
    full, demand = (text.read_block_log(spark, str(tmp_path / x)) for x in ("full", "demand"))
    assert S.load_thresholds(full, demand).first().ths == pytest.approx(0.5)
    assert S.pair_thresholds(full, demand).first() == (0, 1, pytest.approx(0.5))
    sinks.write_block_log(log.drop("other_block"), str(tmp_path / "static"))
    assert text.read_block_log(spark, str(tmp_path / "static")).columns == ["block_id", "nverts", "nedges", "nwalks", "load_time", "exec_time"]


def test_pair_thresholds_in_rows(spark, tmp_path):
    (tmp_path / "t.txt").write_text("0.1\n0.2 0.3\n0.4 0.5 0.6\n")
    assert rows(text.read_pair_thresholds(spark, str(tmp_path / "t.txt"))) == [(1, 0, 0.1), (2, 0, 0.2), (2, 1, 0.3), (3, 0, 0.4), (3, 1, 0.5), (3, 2, 0.6)]


def test_fanout_of_the_usual_sizes(adj, spark):
    got = {r["level"]: r["count"] for r in P.fanout(adj, adj.select(F.col("src").alias("source")), [50, 20, 10, 5], 7).groupBy("level").count().collect()}
    assert got == {0: 5, 1: 250, 2: 5000, 3: 50_000, 4: 250_000}


def test_no_machine_local_folder_on_a_cluster(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda k, v=None: v)

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(Cluster)


def test_sinks_end_first_order_walks(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    got = paths(P.deepwalk(G.adjacency(edges), WalkConfig(walk_length=5), vertices=G.distinct_vertices(edges)))
    assert got == {0: [0, 1, 2], 1: [1, 2], 2: [2]}


def test_frontier_is_a_walk_of_lists(adj):
    got = {}
    for r in P.frontier_sample(adj, 3, 2, 6, 1).collect():
        got.setdefault(r.replica, {})[r.step] = r.vertex
    edges = {e for a, b in TOY for e in ((a, b), (b, a))}
    for steps in got.values():
        assert sorted(steps) == [0, 1, 2, 3, 4, 5]
        live = [steps[0], steps[1]]
        for i in range(2, 6):
            took = [v for v in live if (v, steps[i]) in edges]
            assert took
            live.remove(took[0]) if len(set(took)) == 1 else None
            if len(set(took)) > 1:
                break
            live.append(steps[i])


def test_fanout(adj, spark):
    got = P.fanout(adj, spark.range(2).toDF("source"), [3, 2], 7)
    assert Counter(r.level for r in got.collect()) == {0: 2, 1: 6, 2: 12}


def test_edge_list_source(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n% head\n\n0 1\n1\t2 9.5\n2,3\n")
    assert rows(text.read_edges(spark, str(tmp_path / "e.txt"))) == [(0, 1), (1, 2), (2, 3)]
    (tmp_path / "c.txt").write_text("# only\n")
    assert text.read_edges(spark, str(tmp_path / "c.txt")).count() == 0
    (tmp_path / "bad.txt").write_text("0 x\n")
    assert text.read_edges(spark, str(tmp_path / "bad.txt"), strict=False).count() == 0
    with pytest.raises(Exception, match="not an edge"):
        text.read_edges(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "n.txt").write_text("# c\n5\n7\n5\n")
    assert rows(text.read_starts(spark, str(tmp_path / "n.txt"), 2)) == [(0, 5), (1, 7)]
    assert text.read_settings("a = 1\n# x\nb=2", b=3) == {"a": "1", "b": "3"}
    assert WalkConfig.from_settings({"walk-length": "80", "decay-factor": "0.85"}).decay_factor == Fraction(17, 20)


def test_sinks_round_trip(spark, toy, adj, tmp_path):
    sinks.write_edges(toy, str(tmp_path / "e"))
    assert rows(text.read_edges(spark, str(tmp_path / "e"))) == rows(toy)
    sinks.write_adjacency(adj, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 5
    m = S.running_stats(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double"), "k", "v")
    assert rows(m) == [("a", 2, 4.0, 1.0, 3.0, 2.0)]
    for how in ("csv", "json", "text", "html", "null"):
        sinks.write_metrics(m, str(tmp_path / how), how)
    assert "a.max=3.0" in [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]


def test_threshold_of_exact_lines(spark):
    xs = [i / 100 for i in range(1, 10)]
    log = lambda f: spark.createDataFrame([(0, 1000, int(x * 1000), f(x), 0.0) for x in xs], "block_id int, nverts long, nwalks long, load_time double, exec_time double")
    assert S.load_thresholds(log(lambda x: 2 + x), log(lambda x: 0.5 + 4 * x)).first().ths == pytest.approx(0.5)
    assert S.load_thresholds(log(lambda x: 2 + x).limit(3), log(lambda x: 0.5 + 4 * x)).first().ths == 0


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert G.adjacency(G.undirected(none)).count() == 0 and P.node2vec(G.adjacency(none), WalkConfig()).count() == 0
    assert rows(G.undirected(spark.createDataFrame([(1, 1), (0, 1), (0, 1)], "src long, dst long"))) == [(0, 1), (1, 0)]
