"""MinHash near-duplicates by SetSketch registers.

A document's set is its distinct word shingles (64-bit hashes). Each register keeps the smallest of one hash function over
the set, placed on an exponential scale and truncated to 16 bits: register = floor(1 - log_b(least)), least being the
minimum of exponential variables. Such registers merge by maximum, and equal ones are as frequent as shared elements.

1. sketch        one pass over the texts; rows with equal sets collapse to one node with the smallest id
2. band          r registers at a time are hashed; nodes meet in a bucket where a band is equal
3. star          each member of a bucket meets its smallest member; the likelihood of the joint register comparison
                 estimates the similarity, low estimates go
4. verify        the rest is compared on full sets, rebuilt from the texts of the documents that share a bucket
5. components    of verified links
6. the rest      a bucket whose members are in several components may hide more links: they meet in tiles of bounded size,
                 pairs inside a component and pairs that an earlier band also joins left out; a component of more than a tile
                 has tiles of its own, which are not held against each other; those that pass the estimate and a bound on the
                 intersection from 16-bit hashes of the sets go through 4

No bucket is capped: step 6 is the exact way for what the stars leave. A pair shares no band with probability
(1 - 0.8^6)^32 = 6e-5 at similarity 0.8 and 3e-7 at 0.85.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import FOLD, Prefix, binary_rows, components, in_arrow, mix, text_blocks, tuples, word_spans, written

REGISTERS = 192
ROWS = 6
LOG_B = np.log(1.001)
TOP = 65535
TILE = 256
#: Pairs that are estimated together.
PAIRS = 1 << 13
#: Pairs whose estimate is this much (in standard errors of a register comparison at the threshold) under it are not verified.
ERRORS = 5.0

_rng = np.random.default_rng(77)
_MULTIPLY = (_rng.integers(1, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_FLIP = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]


def shingle_sets(column, words: int):
    """For each text of an Arrow column its sorted distinct shingle hashes; none for a text without words."""
    for _, _, data, off in text_blocks(column):
        start, end, first = word_spans(data, off)
        h = Prefix(data, FOLD).of(start, end)
        runs = tuples(h, words)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                yield mix(tuples(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def registers(s: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(least, ((low[None, i : i + 4096] ^ _FLIP) * _MULTIPLY).min(axis=1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(value) / LOG_B) + TOP // 4, 0, TOP).astype(np.uint16)


def sketch(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, digest of the set, registers) for each row."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            sizes = np.array([len(s) for s in sets], np.int64)
            digest = np.array([(mix(s).sum(), mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum()) for s in sets], np.uint64).reshape(-1, 2)
            regs = np.array([registers(s) if len(s) else np.zeros(REGISTERS, np.uint16) for s in sets], np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), binary_rows(digest.ravel(), np.full(len(sets), 2)), binary_rows(regs.ravel(), np.full(len(sets), REGISTERS))], ["id", "n_shingles", "digest", "regs"])

    return in_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n_shingles long, digest binary, regs binary")


def _matrix(column, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def bands(nodes: DataFrame) -> DataFrame:
    """(key, band, id): one row for each band of each node."""
    n = REGISTERS // ROWS

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                regs = _matrix(batch.column(1), REGISTERS, np.uint16).astype(np.uint64).reshape(-1, n, ROWS)
                key = np.broadcast_to(np.arange(n, dtype=np.uint64), regs.shape[:2]).copy()
                for i in range(ROWS):
                    key = mix(key ^ regs[:, :, i])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(regs))), pa.array(np.repeat(batch.column(0).to_numpy(), n))], ["key", "band", "id"])

    return in_arrow(nodes.select("id", "regs"), run, "key long, band int, id long")


def estimate(n1, n2, plus, minus, same) -> np.ndarray:
    """Jaccard similarity of most likelihood, given set sizes and how many registers are above, below and equal."""
    u = n1 / (n1 + n2)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    b = np.exp(LOG_B)

    def p(x):
        return -np.log(np.maximum(1 - np.maximum(x, 0) * (b - 1) / b, 1e-300)) / LOG_B

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(k > 0, k * np.log(np.maximum(q, 1e-12)), 0) for k, q in ((plus, up), (minus, down), (same, 1 - up - down))]
        return parts[0] + parts[1] + parts[2]

    low, high, g = np.zeros_like(top), top.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(25):  # the likelihood has one peak
        a, c = high - g * (high - low), low + g * (high - low)
        left = likelihood(a) > likelihood(c)
        low, high = np.where(left, low, a), np.where(left, c, high)
    return (low + high) / 2


def _likely(n1, n2, r1: np.ndarray, r2: np.ndarray, least: float) -> np.ndarray:
    plus, minus = (r1 > r2).sum(-1), (r1 < r2).sum(-1)
    return estimate(n1.astype(float), n2.astype(float), plus, minus, REGISTERS - plus - minus) >= least


def _pairs_likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b, n1, n2 = (batch.column(i).to_numpy() for i in range(4))
                ok = _likely(n1, n2, _matrix(batch.column(4), REGISTERS, np.uint16), _matrix(batch.column(5), REGISTERS, np.uint16), least)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    one = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n1"), F.col("regs").alias("r1"))
    two = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("n2"), F.col("regs").alias("r2"))
    return in_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "r1", "r2"), run, "a long, b long")


def _group_pairs(edges: np.ndarray, part: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int):
    """Places (i, j) in stretches of about PAIRS pairs: those of each group edges[k] .. edges[k+1] whose sizes and components allow a link."""
    out, size = [], 0
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = np.arange(a, z)
        left, right = (own, own) if p[a] == q[a] else (own[part[a:z] == p[a]], own[part[a:z] == q[a]])
        fits = (comp[left][:, None] != comp[right]) & (100 * np.minimum.outer(n[left], n[right]) >= percent * np.maximum.outer(n[left], n[right]))
        i, j = np.nonzero(np.triu(fits, 1) if p[a] == q[a] else fits)
        for at in range(0, len(i), PAIRS):
            out.append((left[i[at : at + PAIRS]], right[j[at : at + PAIRS]]))
            size += len(out[-1][0])
            if size >= PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
                out, size = [], 0
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _may_reach(i: np.ndarray, j: np.ndarray, n: np.ndarray, low: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether the pairs' intersections can be large enough, by the 16-bit hashes of their sets."""
    ok, flags = np.zeros(len(i), bool), np.zeros(1 << 16, bool)
    order = np.argsort(i, kind="stable")
    at = None
    for k in order.tolist():
        if i[k] != at:
            if at is not None:
                flags[low[at]] = False
            at = i[k]
            flags[low[at]] = True
        both = int(np.count_nonzero(flags[low[j[k]]])) + min(n[at] - len(low[at]), n[j[k]] - len(low[j[k]]))
        ok[k] = 100 * both >= percent * (n[at] + n[j[k]] - both)
    return ok


def _in_parts(members: DataFrame) -> DataFrame:
    """members (key, band, id, comp, n) with part and, a row for each, the other parts of their bucket that they have to meet.

    A bucket is cut into parts of about TILE members. Those of a component with more than TILE members fill parts of their own and
    meet all but these; so a large group of copies costs what it has to be held against, not its square.
    """
    key = W.partitionBy("key")
    large = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).where(F.col("m") > TILE).withColumn("own", F.ceil(F.col("m") / TILE).cast("int"))
    large = large.withColumn("small", F.ceil((F.col("n") - F.sum("m").over(key)) / TILE).cast("int"))
    large = large.withColumn("first", (F.col("small") + F.sum("own").over(key.orderBy("comp")) - F.col("own")).cast("int")).withColumn("total", (F.col("small") + F.sum("own").over(key)).cast("int"))
    every = F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int")
    placed = members.join(large.select("key", "comp", "first", "own"), ["key", "comp"], "left").join(large.select("key", "small", "total").distinct(), "key", "left")
    placed = placed.withColumn("small", F.coalesce("small", every)).withColumn("total", F.coalesce("total", every)).withColumn("h", F.xxhash64("id", "key"))
    part = F.when(F.col("first").isNotNull(), F.col("first") + F.pmod("h", "own")).otherwise(F.pmod("h", "small")).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda x: F.col("first").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("own")))
    return placed.select("key", "band", "id", "comp", part.alias("part"), F.explode(met).alias("other"))


def _in_tiles(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Likely pairs (a, b) of members (key, part, other, band, id, comp, n_shingles, regs, low) of one bucket in different components.

    Groups stand in order in a task, and the pairs of many small ones are estimated together. low: the distinct 16-bit hashes of a
    set. No more elements can be common than low hashes are, and those that one set lost by collisions.
    """
    dealt = members.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "band", "id", "comp", "n_shingles", "regs", "low")

    def pairs(table: pa.Table) -> pa.RecordBatch:
        key, p, q, part, band, ids, comp, n = (table.column(c).to_numpy() for c in ("key", "p", "q", "part", "band", "id", "comp", "n_shingles"))
        regs = _matrix(table.column("regs"), REGISTERS, np.uint16)
        low = [np.frombuffer(x, np.uint16) for x in table.column("low").to_pylist()]
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True]]))
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _group_pairs(edges, part, p, q, n, comp, percent):
            # Pairs that an earlier band joins have met there.
            joined = (regs[i] == regs[j]).reshape(len(i), -1, ROWS).all(axis=2)
            first = np.where(joined.any(axis=1), joined.argmax(axis=1), joined.shape[1]) >= band[i]
            i, j = i[first], j[first]
            if len(i):
                ok = _likely(n[i], n[j], regs[i], regs[j], least)
                i, j = i[ok], j[ok]
                ok = _may_reach(i, j, n, low, percent)
                a_out.append(np.minimum(ids[i[ok]], ids[j[ok]]))
                b_out.append(np.maximum(ids[i[ok]], ids[j[ok]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])

    def run(batches):
        open_ = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if open_ is None else [*open_.to_batches(), batch])
            group = [table.column(c).to_numpy() for c in ("key", "p", "q")]
            same = np.logical_and.reduce([g == g[-1] for g in group]) if len(table) else np.zeros(0, bool)
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on in the next batch
            if whole:
                yield pairs(table.slice(0, whole))
            open_ = table.slice(whole)
        if open_ is not None and len(open_):
            yield pairs(open_)

    order = ["key", "p", "q"]
    return in_arrow(dealt.repartition(*order).sortWithinPartitions(*order), run, "a long, b long").distinct()


def _full_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, s): the sets of the wanted ids as sorted 64-bit hashes. One shuffle of the texts, at every size."""

    def sets(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(1), words))
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_rows(values, np.array([len(s) for s in found], np.int64))], ["id", "s"])

    return in_arrow(texts.hint("merge").join(wanted.hint("merge"), "id", "left_semi").select("id", "text"), sets, "id long, s binary").dropDuplicates(["id", "s"])


def _low(full: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            low = [np.unique(np.frombuffer(s.as_buffer(), np.uint64).astype(np.uint16)).tobytes() for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary()), pa.array([s.as_buffer().size // 8 for s in batch.column(1)], pa.int64())], ["id", "low", "n_shingles"])

    return in_arrow(full, run, "id long, low binary, n_shingles long")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            if any(ok):
                yield batch.select([0, 1]).filter(pa.array(ok))

    one, two = full.toDF("a", "s1"), full.toDF("b", "s2")
    return in_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "s1", "s2"), compare, "a long, b long").distinct()


def _of_mixed_buckets(members: DataFrame) -> DataFrame:
    """(key, band, id, comp, n) of the members whose bucket has several components; n: members of the bucket."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    return members.join(mixed.select("key", "n"), "key")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df; other columns are not looked at.

    Linked are rows whose sets agree in at least percent % of their union. component_id is the smallest id reachable;
    kept says that the row has it. Null or empty texts and texts without words have an empty set and are linked with
    nothing. Rows with the same id count as one document: they share a component. A row without an id is linked with nothing:
    its component_id is null and it is kept. An empty table gives an empty result.
    """
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    drawn = written(sketch(named, words, "id"))
    sized = drawn.where("id is not null and n_shingles > 0")
    sets = sized.groupBy("digest").agg(F.min("id").alias("rep"))
    nodes = sized.groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "regs")).alias("x")).select("x.*")
    nodes = written(nodes)
    least = percent / 100 - ERRORS * float(np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS))

    met = bands(nodes)
    buckets = met.groupBy("key").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(met.join(buckets, "key").select("key", "band", "id", "c", "n"))
    full = written(_full_sets(named.where("id is not null"), met.select("id").distinct(), words))
    stars = met.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_verified(_pairs_likely(stars, nodes, least), full, percent))
    found = components(links)

    placed = met.where("n > 2").join(found, met.id == found.node, "left").select("key", "band", "id", F.coalesce("component", "id").alias("comp"))
    rest = _in_parts(written(_of_mixed_buckets(placed))).join(nodes.select("id", "n_shingles", "regs"), "id").join(_low(full), ["id", "n_shingles"])
    more = written(_in_tiles(rest, least, percent))
    if not more.isEmpty():
        links = links.union(written(_verified(more, full, percent)))
    # Rows of one id with different sets are one document.
    split = sized.join(sets, "digest").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    same = sized.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    final = components(links.union(split.join(same.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")))
    out = drawn.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(sets, "digest", "left")
    out = out.withColumn("node", F.coalesce("rep", "id")).join(final, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
