"""Breadth-first search, shortest paths and k shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import GraphError, PropertyGraph
from graphloom.operators.loops import NotSettled
from graphloom.plans.session import cut

#: What the compatible form of an unreached node's 32-bit parent or distance is.
UNREACHED = (2**32 - 1) // 4


def _require(g: PropertyGraph, node: int) -> None:
    if not g.nodes.where(F.col("id") == node).take(1):
        raise GraphError(f"no node {node}")


def bfs(g: PropertyGraph, source: int, max_depth: int | None = None) -> DataFrame:
    """id, level, parent of the nodes reached; of the parents one level up the least is given.

    A round joins the frontier with the edges, drops what was visited and keeps the least parent by
    a partial aggregate; only an emptiness test comes to the driver.
    """
    _require(g, source)
    # Laid out by source once, so a round exchanges its frontier and not the edges.
    edges = cut(g.edges.select("src", "dst").repartition("src"))
    frontier = g.nodes.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("level"), F.col("id").alias("parent")).distinct()
    frontier = visited = cut(frontier)
    level = 0
    while max_depth is None or level < max_depth:
        level += 1
        step = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(visited, "id", "left_anti").select("id", F.lit(level).cast("long").alias("level"), "parent"))
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
        if level % 8 == 0:
            visited = cut(visited)
    return visited


def bfs_statistics(reached: DataFrame) -> DataFrame:
    return reached.agg(F.count("*").alias("n_reached_nodes"))


def bfs_violations(g: PropertyGraph, source: int, reached: DataFrame) -> int:
    """Rows that break the rules: wrong root, a parent that is no in-neighbour one level up, or an edge that skips a level."""
    lv = reached.select("id", "level")
    root = reached.where((F.col("id") == source) & ((F.col("level") != 0) | (F.col("parent") != source))).count()
    tree = reached.where(F.col("id") != source).join(g.edges.select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct(), ["parent", "id"], "left_semi")
    tree = tree.join(lv.select(F.col("id").alias("parent"), F.col("level").alias("up")), "parent").where("level = up + 1")
    missing = reached.where(F.col("id") != source).count() - tree.count()
    far = g.edges.select("src", "dst").join(lv.withColumnsRenamed({"id": "src", "level": "a"}), "src").join(lv.withColumnsRenamed({"id": "dst", "level": "b"}), "dst", "left")
    return root + missing + far.where("b is null or b > a + 1").count()


def sssp(g: PropertyGraph, source: int, weight: str = "w", max_rounds: int = 10_000) -> DataFrame:
    """id and dist of the nodes reached, for weights of at least 0; only improved nodes are relaxed again."""
    _require(g, source)
    g = g.with_default_weight(weight)
    kind = g.edges.schema[weight].dataType
    edges = cut(g.edges.groupBy("src", "dst").agg(F.min(weight).alias("w")))
    if edges.where("w < 0").take(1):
        raise GraphError("negative weight")
    state = cut(g.nodes.where(F.col("id") == source).select("id", F.lit(0).cast(kind).alias("dist"), F.lit(True).alias("changed")).distinct())
    for _ in range(max_rounds):
        offers = edges.join(state.where("changed").select(F.col("id").alias("src"), "dist"), "src").groupBy(F.col("dst").alias("id")).agg(F.min((F.col("dist") + F.col("w")).cast(kind)).alias("offer"))
        both = state.join(offers, "id", "full")
        better = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
        state = cut(both.select("id", F.when(better, F.col("offer")).otherwise(F.col("dist")).alias("dist"), better.alias("changed")))
        if not state.where("changed").take(1):
            return state.select("id", "dist")
    raise NotSettled("distances did not settle")


def sssp_statistics(dist: DataFrame) -> DataFrame:
    return dist.agg(F.count("*").alias("n_reached_nodes"), F.max("dist").alias("max_distance"), F.avg("dist").alias("average_visited_distance"))


def sssp_violations(g: PropertyGraph, source: int, dist: DataFrame, weight: str = "w") -> int:
    """Edges that could still shorten a distance, and a source whose distance isn't 0."""
    d = dist.select("id", "dist")
    e = g.edges.select("src", "dst", F.col(weight).alias("w")).join(d.withColumnsRenamed({"id": "src", "dist": "a"}), "src").join(d.withColumnsRenamed({"id": "dst", "dist": "b"}), "dst", "left")
    return e.where("b is null or a + w < b").count() + dist.where((F.col("id") == source) & (F.col("dist") != 0)).count()


def k_shortest_paths(g: PropertyGraph, source: int, target: int, k: int, weight: str = "w", simple: bool = False, symmetric: bool = True) -> DataFrame:
    """rank, weight and path of the k lightest walks (or simple paths) from source to target.

    A round extends each open walk by an edge. A node keeps its k lightest walks, which is enough
    for walks; simple paths are pruned only by the weight of the k-th path found so far. Weights must
    be above 0 for walks to end.
    """
    edges = g.with_default_weight(weight).neighbours(symmetric, weight).select("src", "dst", F.col(weight).alias("w"))
    spark = g.nodes.sparkSession
    open_ = spark.createDataFrame([(source, 0, [source])], "node long, weight long, path array<long>")
    w = Window.partitionBy("node").orderBy("weight", "path")
    best = cut(open_)
    while True:  # ends as walks grow heavier than the k-th best, or simple paths run out of nodes
        step = open_.join(edges, open_.node == edges.src).select(F.col("dst").alias("node"), (F.col("weight") + F.col("w")).alias("weight"), "path", "dst")
        if simple:
            step = step.where(~F.array_contains("path", F.col("dst")))
            step = step.where(F.element_at("path", -1) != target)
        step = step.select("node", "weight", F.concat("path", F.array("dst")).alias("path")).distinct()
        if simple:
            found = best.where(F.col("node") == target).orderBy("weight", "path").limit(k).agg(F.count("*"), F.max("weight")).first()
            if found[0] >= k:
                step = step.where(F.col("weight") <= found[1])
            new = cut(step)
            best = cut(best.where(F.col("node") == target).unionAll(new.where(F.col("node") == target)))
        else:
            both = best.withColumn("new", F.lit(False)).unionAll(step.withColumn("new", F.lit(True)))
            ranked = cut(both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k))
            new, best = ranked.where("new").select("node", "weight", "path"), ranked.select("node", "weight", "path")
        if not new.take(1):
            break
        open_ = new
    out = best.where((F.col("node") == target) & ((F.size("path") > 1) | F.lit(source == target))).orderBy("weight", "path").limit(k)
    return out.select(F.row_number().over(Window.orderBy("weight", "path")).cast("long").alias("rank"), "weight", F.array_join("path", ",").alias("path"))
