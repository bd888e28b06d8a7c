"""Triangles, clustering coefficients, and neighbourhood similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import GraphError, PropertyGraph
from graphloom.plans.session import cut

#: Edges that one block of the adjacency matrix should hold at most; a task takes three blocks at a time, about 300 MB of arrays.
BLOCK_EDGES = 1_500_000
#: Pairs that a task should be sent, if that leaves it a whole number of groups of three blocks.
TASK_EDGES = 500_000
#: Ranges of ids at most.
RANGES = 1024
#: Wedges that are tested at once.
WEDGES = 1 << 21


def _simple(g: PropertyGraph) -> DataFrame:
    """a < b once for each pair of nodes that an edge joins."""
    return _pairs(g).distinct()


def _pairs(g: PropertyGraph) -> DataFrame:
    """a < b for each edge but loops, parallel and reciprocal ones repeated."""
    return g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


def _blocks_of(table: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and block (range of a times the number of ranges, plus range of b) of the pairs, in order of the blocks."""
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    block = np.searchsorted(bounds, a, "right") * (len(bounds) + 1) + np.searchsorted(bounds, b, "right")
    order = np.argsort(block, kind="stable")
    return a[order], b[order], block[order]


def _plan(pairs: DataFrame) -> tuple[np.ndarray, list[tuple[int, int, int]], int]:
    """Bounds of the ranges of ids, the ranges (i <= j <= k) that may hold triangles, and the pairs to send for all of them.

    Ranges have about as many ends of edges each. As few are taken as keep each block (pairs between two
    ranges) within BLOCK_EDGES. Where edges join near ids, few blocks other than the diagonal have
    pairs, and a pair goes to few tasks, however many ranges there are. Else blocks shrink with the square of
    the number of ranges, and a pair goes to as many tasks as there are ranges. Only bounds and block sizes come to the driver.
    """
    at = [k / RANGES for k in range(1, RANGES)]
    n, *ends = pairs.agg(F.count("*"), *[F.percentile_approx(c, at, F.lit(8 * RANGES)) for c in ("a", "b")]).first()
    fine = 1
    while fine < RANGES and fine * BLOCK_EDGES < 8 * n:
        fine *= 2
    bounds = np.zeros(0, np.int64)
    if fine > 1:
        bounds = np.unique(np.sort(np.array(ends, np.int64).ravel())[:: 2 * RANGES // fine][1:])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            block, m = np.unique(_blocks_of(x, bounds)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(m, pa.int64())], ["block", "m"])

    sizes = pairs.mapInArrow(count, "block long, m long").groupBy("block").agg(F.sum("m").alias("m")).collect()
    block, m = (np.array([r[k] for r in sizes], np.int64) for k in (0, 1))
    i, j = np.divmod(block, len(bounds) + 1)
    step = len(bounds) + 1  # of so many ranges one is made
    while step > 1:
        wide = (i // step) * (len(bounds) + 1) + j // step
        if np.bincount(np.unique(wide, return_inverse=True)[1], m).max(initial=0) <= BLOCK_EDGES:
            break
        step = (step + 1) // 2
    there: dict[tuple[int, int], int] = {}
    for x, y, k in zip((i // step).tolist(), (j // step).tolist(), m.tolist()):
        there[x, y] = there.get((x, y), 0) + k
    after: dict[int, list[int]] = {}
    for x, y in sorted(there):
        after.setdefault(x, []).append(y)
    triples = [(x, y, z) for x, ys in sorted(after.items()) for y in ys for z in after.get(y, ()) if (x, z) in there]
    return bounds[step - 1 :: step], triples, sum(there[b] for x, y, z in triples for b in {(x, y), (x, z), (y, z)})


def _listed(parts: dict[tuple[int, int], np.ndarray], ids: np.ndarray, at: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triangles x < y < z with ends in the ranges at, as places in ids. parts: sorted keys (place of a times the number of ids, plus that of b) of each block.

    Of an edge (x, y) the shorter of the two lists of z is read, and each z is looked up in the other.
    """
    n = len(ids)
    xy, xz, yz = parts[at[0], at[1]], parts[at[0], at[2]], parts[at[1], at[2]]
    x, y = np.divmod(xy, n)
    first = [np.searchsorted(xz, x * n + y, "right"), np.searchsorted(yz, y * n)]  # z of x that follow y, and z of y
    length = [np.searchsorted(xz, (x + 1) * n) - first[0], np.searchsorted(yz, (y + 1) * n) - first[1]]
    for near, far, apex, other, mine in ((xz, yz, y, 0, length[0] < length[1]), (yz, xz, x, 1, length[0] >= length[1])):
        rows = np.flatnonzero(mine & (length[0] > 0) & (length[1] > 0))
        size, start = length[other][rows], first[other][rows]
        total = np.cumsum(size)
        lo = 0
        while lo < len(rows):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + WEDGES, "right")))
            s, r = size[lo:hi], rows[lo:hi]
            run = np.arange(int(s.sum())) + np.repeat(start[lo:hi] - (total[lo:hi] - s - before), s)
            z = near[run] % n
            edge = np.repeat(r, s)
            key = apex[edge] * n + z
            place = np.searchsorted(far, key)
            hit = np.flatnonzero(far[np.minimum(place, len(far) - 1)] == key)
            yield x[edge[hit]], y[edge[hit]], z[hit]
            lo = hi


def _rows(parts: dict[tuple[int, int], np.ndarray], ids: np.ndarray, at: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    for t in _listed(parts, ids, at):
        yield pa.RecordBatch.from_arrays([pa.array(ids[c]) for c in t], ["u", "v", "w"])


def _total(parts: dict[tuple[int, int], np.ndarray], ids: np.ndarray, at: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([sum(len(t[0]) for t in _listed(parts, ids, at))], pa.int64())], ["t"])


def _per_node(parts: dict[tuple[int, int], np.ndarray], ids: np.ndarray, at: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    m = np.zeros(len(ids), np.int64)
    for t in _listed(parts, ids, at):
        for c in t:
            m += np.bincount(c, minlength=len(ids))
    some = np.flatnonzero(m)
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(m[some])], ["id", "t"])


def _per_edge(parts: dict[tuple[int, int], np.ndarray], ids: np.ndarray, at: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    n, m = len(ids), {k: np.zeros(len(v), np.int64) for k, v in parts.items()}
    for t in _listed(parts, ids, at):
        for p, q in ((0, 1), (0, 2), (1, 2)):
            block = at[p], at[q]
            m[block] += np.bincount(np.searchsorted(parts[block], t[p] * n + t[q]), minlength=len(m[block]))
    for block, keys in parts.items():
        some = np.flatnonzero(m[block])
        a, b = np.divmod(keys[some], n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(m[block][some])], ["a", "b", "s"])


_FORMS = {"rows": (_rows, "u long, v long, w long"), "total": (_total, "t long"), "nodes": (_per_node, "id long, t long"), "edges": (_per_edge, "a long, b long, s long")}


def _triangles(pairs: DataFrame, form: str) -> DataFrame:
    """What form makes of the triangles of each three ranges of ids; pairs (a < b), a checkpoint as they are read several times, may repeat.

    Pairs are packed by blocks of the adjacency matrix, and only packed blocks are exchanged: no wedge
    leaves the task that makes it. A task holds three blocks at a time.
    """
    make, schema = _FORMS[form]
    bounds, triples, load = _plan(pairs)
    spark = pairs.sparkSession
    if not triples:
        return spark.createDataFrame([], schema)
    width = len(bounds) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b, block = _blocks_of(pa.Table.from_batches(some).combine_chunks().to_batches()[0], bounds)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = [*cuts[1:].tolist(), len(block)]
            data = [np.concatenate([a[s:e], b[s:e]]).tobytes() for s, e in zip(cuts.tolist(), ends)]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int64()), pa.array(data, pa.binary())], ["block", "data"])

        some, n = [], 0
        for x in batches:
            if x.num_rows:
                some.append(x)
                n += x.num_rows
            if n >= BLOCK_EDGES // 4:
                yield packed(some)
                some, n = [], 0
        if n:
            yield packed(some)

    def solve(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, list[np.ndarray]] = {}
        at = None
        for x in group:
            for t, block, d in zip(x.column("task").to_pylist(), x.column("block").to_pylist(), x.column("data")):
                at = triples[t]
                data.setdefault(block, []).append(np.frombuffer(d.as_buffer(), np.int64).reshape(2, -1).copy())
        edges = {k: np.concatenate(v, axis=1) for k, v in data.items()}
        data.clear()
        ids = np.unique(np.concatenate([e.ravel() for e in edges.values()]))
        parts = {divmod(k, width): np.unique(np.searchsorted(ids, e[0]) * len(ids) + np.searchsorted(ids, e[1])) for k, e in edges.items()}
        edges.clear()
        yield from make(parts, ids, at)

    wanted = [(t, b) for t, (x, y, z) in enumerate(triples) for b in sorted({x * width + y, x * width + z, y * width + z})]
    wanted = spark.createDataFrame(pa.table([pa.array([w[k] for w in wanted], pa.int64()) for k in (0, 1)], names=["task", "block"]))
    parts = min(len(triples), max(int(spark.conf.get("spark.sql.shuffle.partitions")), load // TASK_EDGES))
    sent = pairs.mapInArrow(pack, "block long, data binary").join(F.broadcast(wanted), "block").repartition(parts, "task")
    return sent.groupBy("task").applyInArrow(solve, schema)


def triangles_of(pairs: DataFrame) -> DataFrame:
    """u < v < w of every triangle of the simple graph of pairs (a < b), once."""
    return _triangles(cut(pairs.select("a", "b")), "rows")


def support(pairs: DataFrame) -> DataFrame:
    """a, b and s: the number of triangles that each pair (a < b) is a side of; those in none have no row. pairs: a checkpoint."""
    return _triangles(pairs, "edges").groupBy("a", "b").agg(F.sum("s").alias("s"))


def triangles(g: PropertyGraph) -> DataFrame:
    """u, v, w of every triangle, once, on the underlying simple graph."""
    return triangles_of(_pairs(g))


def triangle_count(g: PropertyGraph) -> DataFrame:
    return _triangles(cut(_pairs(g)), "total").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("triangles"))


def local_clustering(g: PropertyGraph) -> DataFrame:
    """id and coefficient: 2 T / (d (d - 1)), 0 below degree 2, on the underlying simple graph."""
    p = cut(_simple(g))
    t = _triangles(p, "nodes").groupBy("id").agg(F.sum("t").alias("t"))
    d = p.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    joined = g.nodes.select("id").join(d, "id", "left").join(t, "id", "left")
    value = F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return joined.select("id", value.alias("coefficient"))


def jaccard(g: PropertyGraph, base: int) -> DataFrame:
    """id and similarity of every node's out-neighbours with base's; 1 if both have none.

    Parallel edges of the other node count each, as its degree does.
    """
    if not g.nodes.where(F.col("id") == base).take(1):
        raise GraphError(f"no node {base}")
    mine = g.edges.where(F.col("src") == base)
    size = mine.select("dst").distinct().count()  # one number
    near = mine.select("dst").distinct().withColumn("hit", F.lit(1))
    per = g.edges.select("src", "dst").join(near, "dst", "left").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"), F.coalesce(F.sum("hit"), F.lit(0)).alias("i"))
    joined = g.nodes.select("id").join(per, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("i", F.lit(0)).alias("i"))
    union = F.col("d") + size - F.col("i")
    return joined.select("id", F.when(union == 0, 1.0).otherwise(F.col("i") / union).alias("similarity"))


def jaccard_statistics(sim: DataFrame, base: int) -> DataFrame:
    return sim.where(F.col("id") != base).agg(F.max("similarity").alias("max_similarity"), F.min("similarity").alias("min_similarity"), F.avg("similarity").alias("average_similarity"))
