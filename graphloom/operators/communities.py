"""Connected components of a graph, label propagation, Louvain and Leiden clusterings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.components import min_label
from graphloom.plans.session import cut


def connected_components(g: PropertyGraph) -> DataFrame:
    """id and component: the least node id that edges, in either direction, reach."""
    labels = min_label(g.edges.select("src", "dst"))
    return g.nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def group_statistics(labels: DataFrame, column: str) -> DataFrame:
    """total, non_trivial, largest and largest_ratio of the groups of a labelling."""
    sizes = labels.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("total"), F.count_if(F.col("n") > 1).alias("non_trivial"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("largest_ratio"))


def component_violations(g: PropertyGraph, labels: DataFrame) -> int:
    a = labels.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("a <> b").count()


def cdlp(g: PropertyGraph, max_iterations: int = 10, symmetric: bool = False) -> DataFrame:
    """id and community: in each round a node takes its neighbours' most frequent label, the least on ties."""
    edges = cut(g.neighbours(symmetric).groupBy("src", "dst").agg(F.count("*").alias("m")))
    state = cut(g.nodes.select("id", F.col("id").alias("label")))
    for _ in range(max_iterations):
        votes = edges.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("m").alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select("id", (-F.col("b.l")).alias("new"))
        nxt = cut(state.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("changed")))
        state = nxt.select("id", "label")
        if not nxt.where("changed").take(1):
            break
    return state.withColumnRenamed("label", "community")


def _undirected(g: PropertyGraph, weight: str) -> DataFrame:
    """Both directions of every edge, parallel weights summed."""
    e = g.with_default_weight(weight).undirected(weight)
    return e.groupBy("src", "dst").agg(F.sum(F.col(weight).cast("double")).alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, column: str = "cluster") -> DataFrame:
    """modularity of a labelling over weighted edges that hold both directions: (inner - sum of a^2 / 2m) / 2m."""
    a = labels.select(F.col("id").alias("src"), F.col(column).alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col(column).alias("b"))
    e = edges.join(a, "src").join(b, "dst")
    per = e.groupBy(F.col("a")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"))
    total = F.sum("degree")
    return per.agg(((F.sum("inner") - F.sum(F.col("degree") * F.col("degree")) / total) / total).alias("modularity"))


#: Once a level has no more edges than this (both directions counted), one task finishes the clustering:
#: about 100 MB of arrays. The same rules run there, so where the hand-over happens doesn't change a result.
LOCAL_EDGES = 2_000_000
#: Rounds without a move after which a refinement is settled: each of four hash bits gave both halves a turn.
QUIET = 8
_SCALE = float(1 << 20)


def turn_bit(node: Column, turn: int) -> Column:
    """Which half of the nodes a node belongs to in a pair of turns: a high bit of a multiplicative hash."""
    mixed = F.pmod(F.pmod(node, F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
    return F.shiftright(mixed, 31 - turn // 2 % 16).bitwiseAND(F.lit(1))


def _moves(edges: DataFrame, totals: DataFrame, start: DataFrame, turn: int, two_m: float, resolution: float) -> DataFrame:
    """start (id, cluster, degree) after the nodes whose turn it is moved to the best neighbouring cluster."""
    near = edges.where("src <> dst").where(turn_bit(F.col("src"), turn) == turn % 2)
    near = near.join(start.select(F.col("id").alias("dst"), F.col("cluster").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("to"))
    near = near.join(start, "id").join(totals.select(F.col("cluster").alias("c"), F.col("total").alias("ac"), F.col("members").alias("mc")), "c")
    own = near.where("c = cluster").select("id", F.col("to").alias("own"))
    mine = totals.select("cluster", F.col("total").alias("ao"), F.col("members").alias("mo"))
    offers = near.where("c <> cluster").join(own, "id", "left").join(mine, "cluster")
    gain = F.col("to") - F.coalesce("own", F.lit(0.0)) - resolution * F.col("degree") * (F.col("ac") - (F.col("ao") - F.col("degree"))) / two_m
    offers = offers.withColumn("gain", F.floor(gain * _SCALE + 0.5))
    # Two single nodes don't swap: one may only join the other if that has the smaller label.
    offers = offers.where((F.col("gain") > 0) & ((F.col("mo") > 1) | (F.col("mc") > 1) | (F.col("c") < F.col("cluster"))))
    best = offers.groupBy("id").agg(F.max(F.struct("gain", (-F.col("c")).alias("m"))).alias("b")).select("id", (-F.col("b.m")).alias("new"))
    return start.join(best, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"), "degree")


def _totals(state: DataFrame) -> DataFrame:
    return state.groupBy("cluster").agg(F.sum("degree").alias("total"), F.count("*").alias("members"))


def _with_degrees(edges: DataFrame, state: DataFrame) -> DataFrame:
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    return cut(state.join(degree, "id", "left").select("id", "cluster", F.coalesce("degree", F.lit(0.0)).alias("degree")))


def _move_phase(edges: DataFrame, start: DataFrame, two_m: float, threshold: float, max_iterations: int, resolution: float) -> tuple[DataFrame, float]:
    """The best labels that rounds of moves met, and their modularity; stops when two rounds gain no more than threshold."""
    state = best = _with_degrees(edges, start)
    q = top = modularity(edges, state).first()[0] or 0.0
    for turn in range(max_iterations):
        # A label's total is a sum over two columns of state, so it needs no checkpoint of its own.
        state = cut(_moves(edges, _totals(state), state, turn, two_m, resolution))
        if turn % 2 or turn + 1 == max_iterations:
            now = modularity(edges, state).first()[0] or 0.0
            if now > top:
                best, top = state, now
            if now - q <= threshold:
                break
            q = now
    return best.select("id", "cluster"), top


def _coarse(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("id").alias("src"), F.col("cluster").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("cluster").alias("b"))
    return cut(edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))


def _refined(edges: DataFrame, labels: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """Sub-clusters (id, cluster) within each cluster; nodes join only sub-clusters they have an edge to, so each is connected.

    In a round, nodes that are still alone and whose turn it is join the best sub-cluster of a node
    whose turn it is not; those stay, so what is joined can't move away. Ends after QUIET rounds
    without a move.
    """
    a = labels.select(F.col("id").alias("src"), F.col("cluster").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("cluster").alias("b"))
    inner = cut(edges.where("src <> dst").join(a, "src").join(b, "dst").where("a = b").select("src", "dst", "w"))
    sub = _with_degrees(edges, labels.select("id", F.col("id").alias("cluster")))
    turn = quiet = 0
    while quiet < QUIET:
        full = sub.join(_totals(sub), "cluster").withColumn("goes", (F.col("members") == 1) & (turn_bit(F.col("id"), turn) == turn % 2))
        near = inner.join(full.where("goes").select(F.col("id").alias("src"), F.col("degree").alias("d")), "src").join(full.where("not goes").select(F.col("id").alias("dst"), F.col("cluster").alias("c"), F.col("total").alias("t")), "dst")
        offers = near.groupBy(F.col("src").alias("id"), "c").agg(F.floor((F.sum("w") - resolution * F.first("d") * F.first("t") / two_m) * _SCALE + 0.5).alias("gain")).where("gain > 0")
        best = cut(offers.groupBy("id").agg(F.max(F.struct("gain", (-F.col("c")).alias("m"))).alias("b")).select("id", (-F.col("b.m")).alias("new")))
        if best.isEmpty():
            quiet += 1
        else:
            quiet = 0
            sub = cut(sub.join(best, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"), "degree"))
        turn += 1
    return sub.select("id", "cluster")


class _Level:
    """One level in arrays: the same rules as above over node numbers, which ascend with the ids."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        self.ids, self.src, self.dst, self.w = ids, src, dst, w
        self.n = len(ids)
        self.degree = np.bincount(src, weights=w, minlength=self.n)
        self.hash = (ids % (1 << 31)).astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32)
        self.outer = np.flatnonzero(src != dst)

    def turn_of(self, turn: int) -> np.ndarray:
        return (self.hash >> np.uint64(31 - turn // 2 % 16) & np.uint64(1)).astype(np.int64) == turn % 2

    def modularity(self, label: np.ndarray) -> float:
        total = np.bincount(label, weights=self.degree, minlength=self.n)
        same = label[self.src] == label[self.dst]
        return float((self.w[same].sum() - (total * total).sum() / total.sum()) / total.sum())

    def sums(self, at: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight from each node to each target label over the edges at, as node, label, weight, by node and label."""
        key, place = np.unique(self.src[at] * self.n + target, return_inverse=True)
        return key // self.n, key % self.n, np.bincount(place, weights=self.w[at], minlength=len(key))

    def best(self, node: np.ndarray, label: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's label of the greatest gain, the least on ties."""
        order = np.lexsort((label, -gain, node))
        node, label = node[order], label[order]
        first = np.concatenate([np.ones(min(1, len(node)), bool), node[1:] != node[:-1]])
        return node[first], label[first]

    def move(self, label: np.ndarray, turn: int, two_m: float, resolution: float) -> np.ndarray:
        at = self.outer[self.turn_of(turn)[self.src[self.outer]]]
        node, c, to = self.sums(at, label[self.dst[at]])
        total = np.bincount(label, weights=self.degree, minlength=self.n)
        members = np.bincount(label, minlength=self.n)
        mine = label[node]
        own = np.zeros(self.n)
        own[node[c == mine]] = to[c == mine]
        d = self.degree[node]
        gain = np.floor((to - own[node] - resolution * d * (total[c] - (total[mine] - d)) / two_m) * _SCALE + 0.5)
        ok = (c != mine) & (gain > 0) & ((members[mine] > 1) | (members[c] > 1) | (c < mine))
        who, new = self.best(node[ok], c[ok], gain[ok])
        label = label.copy()
        label[who] = new
        return label

    def phase(self, label: np.ndarray, two_m: float, threshold: float, max_iterations: int, resolution: float) -> tuple[np.ndarray, float]:
        best, q = label, self.modularity(label)
        top = q
        for turn in range(max_iterations):
            label = self.move(label, turn, two_m, resolution)
            if turn % 2 or turn + 1 == max_iterations:
                now = self.modularity(label)
                if now > top:
                    best, top = label, now
                if now - q <= threshold:
                    break
                q = now
        return best, top

    def refined(self, label: np.ndarray, two_m: float, resolution: float) -> np.ndarray:
        inner = self.outer[label[self.src[self.outer]] == label[self.dst[self.outer]]]
        sub = np.arange(self.n)
        turn = quiet = 0
        while quiet < QUIET:
            total = np.bincount(sub, weights=self.degree, minlength=self.n)
            goes = (np.bincount(sub, minlength=self.n)[sub] == 1) & self.turn_of(turn)
            at = inner[goes[self.src[inner]] & ~goes[self.dst[inner]]]
            node, c, to = self.sums(at, sub[self.dst[at]])
            gain = np.floor((to - resolution * self.degree[node] * total[c] / two_m) * _SCALE + 0.5)
            who, new = self.best(node[gain > 0], c[gain > 0], gain[gain > 0])
            quiet = 0 if len(who) else quiet + 1
            sub = sub.copy()
            sub[who] = new
            turn += 1
        return sub

    def coarse(self, label: np.ndarray) -> tuple[_Level, np.ndarray]:
        """The level of the labels, and each node's number in it."""
        known, up = np.unique(label, return_inverse=True)
        k = len(known)
        key, place = np.unique(up[self.src] * k + up[self.dst], return_inverse=True)
        return _Level(self.ids[known], key // k, key % k, np.bincount(place, weights=self.w, minlength=len(key))), up


def _finish(level: _Level, label: np.ndarray, q: float | None, two_m: float, rule: _Rule) -> np.ndarray:
    """Final labels (node numbers) of a level's nodes, from the labels to begin with."""
    result, member, first = label, np.arange(level.n), level
    while True:
        found, now = level.phase(label, two_m, rule.threshold, rule.max_iterations, rule.resolution)
        named = found[member]
        if q is not None and now - q <= rule.total_threshold:
            if now > q:
                result = np.searchsorted(first.ids, level.ids[named])
            break
        result, q = np.searchsorted(first.ids, level.ids[named]), now
        base = level.refined(found, two_m, rule.resolution) if rule.refine else found
        nxt, up = level.coarse(base)
        if rule.refine:
            parent = np.full(nxt.n, np.iinfo(np.int64).max)
            np.minimum.at(parent, up, found)
            # A parent's label is its least node's sub-cluster, which is one of the level's nodes.
            label = _named(parent)
        else:
            label = np.arange(nxt.n)
        done = nxt.n <= max(rule.min_graph_size, 1) or nxt.n == level.n
        member, level = up[member], nxt
        if done:
            break
    return result


def _named(group: np.ndarray) -> np.ndarray:
    """Each place's group, named by the group's least place."""
    _, first, place = np.unique(group, return_index=True, return_inverse=True)
    return first[place]


@dataclass(frozen=True)
class _Rule:
    threshold: float
    total_threshold: float
    max_iterations: int
    min_graph_size: int
    resolution: float
    refine: bool


def _finished_in_one_task(edges: DataFrame, start: DataFrame, q: float | None, two_m: float, rule: _Rule) -> DataFrame:
    """node and cluster, by arrays, for a level of at most LOCAL_EDGES edges; start: id and cluster."""
    rows = start.select(F.col("id").alias("a"), F.col("cluster").alias("b"), F.lit(None).cast("double").alias("w"))
    rows = rows.unionAll(edges.select(F.col("src"), F.col("dst"), F.col("w")))

    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        w = table.column("w").to_numpy()
        node = np.isnan(w)
        order = np.argsort(a[node])
        ids = a[node][order]
        label = _named(b[node][order])
        src, dst, w = np.searchsorted(ids, a[~node]), np.searchsorted(ids, b[~node]), w[~node]
        order = np.lexsort((dst, src))  # sums don't depend on the order of the rows
        done = _finish(_Level(ids, src[order], dst[order], w[order]), label, q, two_m, rule)
        return pa.table([pa.array(ids), pa.array(ids[done])], names=["node", "cluster"])

    return cut(rows.groupBy(F.lit("all").alias("one")).applyInArrow(run, "node long, cluster long"))


def _cluster(g: PropertyGraph, weight: str, rule: _Rule) -> DataFrame:
    edges = cut(_undirected(g, weight))
    ids = g.nodes.select("id").distinct()
    size, total = edges.agg(F.count("*"), F.sum("w")).first()
    if not total or ids.count() <= rule.min_graph_size:
        return ids.select("id", F.lit(None).cast("long").alias("cluster"))
    member = cut(ids.select("id", F.col("id").alias("node")))  # original node -> node of the current level
    start, q, result = ids.select("id", F.col("id").alias("cluster")), None, None
    while True:
        if size <= LOCAL_EDGES:
            named = member.join(_finished_in_one_task(edges, start, q, total, rule), "node")
            result = cut(named.select("id", "cluster"))
            break
        labels, now = _move_phase(edges, start, total, rule.threshold, rule.max_iterations, rule.resolution)
        named = member.join(labels.select(F.col("id").alias("node"), "cluster"), "node")
        if q is not None and now - q <= rule.total_threshold:
            if now > q:
                result = cut(named.select("id", "cluster"))
            break
        result, q = cut(named.select("id", "cluster")), now
        base = _refined(edges, labels, total, rule.resolution) if rule.refine else labels
        before = start.count()
        member = cut(member.join(base.select(F.col("id").alias("node"), F.col("cluster").alias("up")), "node").select("id", F.col("up").alias("node")))
        if rule.refine:
            parents = base.join(labels.withColumnRenamed("cluster", "parent"), "id").groupBy(F.col("cluster").alias("id")).agg(F.min("parent").alias("parent"))
            least = parents.groupBy("parent").agg(F.min("id").alias("cluster"))
            start = cut(parents.join(least, "parent").select("id", "cluster"))
        else:
            start = cut(base.select(F.col("cluster").alias("id")).distinct().select("id", F.col("id").alias("cluster")))
        edges = _coarse(edges, base)
        size = edges.count()
        nodes = start.count()
        if nodes <= max(rule.min_graph_size, 1) or nodes == before:
            break
    # Clusters are named by their least member.
    least = result.groupBy("cluster").agg(F.min("id").alias("name"))
    return result.join(least, "cluster").select("id", F.col("name").alias("cluster"))


def louvain(g: PropertyGraph, weight: str = "w", threshold: float = 1e-4, total_threshold: float = 1e-4, max_iterations: int = 1000, min_graph_size: int = 0) -> DataFrame:
    """id and cluster by synchronous Louvain; null where the graph has min_graph_size nodes or fewer.

    Half of the nodes, by a hash, move in a round, so neighbours don't chase each other; ties go to
    the least cluster, so the result is the same every time. Levels follow each other until one
    gains no more than total_threshold or no longer merges anything.
    """
    return _cluster(g, weight, _Rule(threshold, total_threshold, max_iterations, min_graph_size, 1.0, False))


def leiden(g: PropertyGraph, weight: str = "w", threshold: float = 1e-4, total_threshold: float = 1e-4, max_iterations: int = 1000, min_graph_size: int = 0, resolution: float = 1.0) -> DataFrame:
    """id and cluster by Louvain moves with a refinement before each coarsening.

    A cluster that moves have left in pieces is given as one cluster per piece.
    """
    found = cut(_cluster(g, weight, _Rule(threshold, total_threshold, max_iterations, min_graph_size, resolution, True)))
    a = found.select(F.col("id").alias("src"), F.col("cluster").alias("a"))
    b = found.select(F.col("id").alias("dst"), F.col("cluster").alias("b"))
    inside = g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("a = b").select("src", "dst")
    pieces = min_label(inside)
    return found.join(pieces, "id", "left").select("id", F.when(F.col("cluster").isNotNull(), F.coalesce("label", "id")).alias("cluster"))


def clustering_statistics(g: PropertyGraph, labels: DataFrame, weight: str = "w") -> DataFrame:
    """total, non_trivial, largest, largest_ratio and modularity of clusters."""
    edges = _undirected(g, weight)
    return group_statistics(labels, "cluster").join(modularity(edges, labels))  # one row each


def clustering_violations(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """missing: nodes without a cluster; misnamed: clusters whose name isn't their least member; split: clusters of more than one connected piece."""
    a = labels.select(F.col("id").alias("src"), F.col("cluster").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("cluster").alias("b"))
    inside = min_label(g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("a = b").select("src", "dst"))
    pieces = labels.join(inside, "id", "left").groupBy("cluster").agg(F.min("id").alias("least"), F.count_distinct(F.coalesce("label", "id")).alias("pieces"))
    wrong = pieces.agg(F.count_if(F.col("least") != F.col("cluster")).alias("misnamed"), F.count_if(F.col("pieces") > 1).alias("split"))
    missing = g.nodes.select("id").join(labels.where("cluster is not null"), "id", "left_anti").agg(F.count("*").alias("missing"))
    return missing.join(wrong)  # one row each
