"""k-core, k-truss and maximal independent sets, by rounds of removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import GraphError, PropertyGraph
from graphloom.operators.loops import NotSettled
from graphloom.plans.session import cut


def k_core(g: PropertyGraph, k: int, symmetric: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """id and alive: whether the node is in the k-core. Degrees count both directions unless symmetric."""
    edges = cut(g.neighbours(symmetric).groupBy("src", "dst").agg(F.count("*").alias("m")))
    ids = g.nodes.select("id")
    for _ in range(max_rounds):
        weak = edges.groupBy(F.col("src").alias("id")).agg(F.sum("m").alias("d")).where(F.col("d") < k).select("id")
        weak = cut(weak)
        if weak.isEmpty():
            break
        edges = cut(edges.join(weak.withColumnRenamed("id", "src"), "src", "left_anti").join(weak.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    else:
        raise NotSettled("the core did not settle")
    live = edges.select(F.col("src").alias("id")).distinct().withColumn("alive", F.lit(True))
    return ids.join(live, "id", "left").select("id", (F.coalesce("alive", F.lit(False)) | F.lit(k <= 0)).alias("alive"))


def k_truss(g: PropertyGraph, k: int, max_rounds: int = 10_000) -> DataFrame:
    """src and dst (src < dst) of the edges left in the k-truss of the underlying simple graph."""
    if k <= 2:
        raise GraphError("k must be at least 3")
    from . import triangles

    live = cut(g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    # As long as many edges are weak, their triangles are only counted, not listed.
    left = live.count()
    while left:
        before, live = left, cut(triangles.support(live).where(F.col("s") >= k - 2).select("a", "b"))
        left = live.count()
        if left in (0, before):
            return live.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        if left > 0.9 * before:
            break
    # Then triangles are listed once, as rows of three sides; rounds only drop the sides that are too weak.
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    sides = cut(triangles.triangles_of(live).select(pair("u", "v").alias("x"), pair("v", "w").alias("y"), pair("u", "w").alias("z")))
    for _ in range(max_rounds):
        support = sides.select(F.explode(F.array("x", "y", "z")).alias("p")).groupBy("p").agg(F.count("*").alias("s"))
        weak = cut(support.where(F.col("s") < k - 2).select("p"))
        if weak.isEmpty():
            break
        for side in "xyz":
            sides = sides.join(weak.withColumnRenamed("p", side), side, "left_anti")
        sides = cut(sides)
    else:
        raise NotSettled("the truss did not settle")
    return sides.select(F.explode(F.array("x", "y", "z")).alias("p")).select(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).distinct()


def independent_set(g: PropertyGraph, order: str = "id", max_rounds: int = 10_000) -> DataFrame:
    """id and member: the maximal independent set that takes nodes by id, or by a hash of it.

    Nodes with a loop are never members. In a round every open node that comes before all its open
    neighbours joins, and its neighbours close.
    """
    edges = g.undirected().where("src <> dst").distinct()
    loops = g.edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    rank = F.col("id") if order == "id" else F.pmod(F.pmod("id", F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
    open_ = cut(g.nodes.select("id").join(loops, "id", "left_anti").withColumn("r", F.struct(rank.alias("h"), "id")))
    members = None
    edges = cut(edges)
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        near = edges.join(open_.select(F.col("id").alias("src")), "src", "left_semi").join(open_.select(F.col("id").alias("dst"), F.col("r").alias("o")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("o").alias("first"))
        win = cut(open_.join(near, "id", "left").where("first is null or r < first").select("id"))
        closed = edges.join(win.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).unionAll(win)
        open_ = cut(open_.join(closed.distinct(), "id", "left_anti"))
        members = win if members is None else members.unionAll(win)
    else:
        raise NotSettled("the independent set did not settle")
    if members is None:
        return g.nodes.select("id", F.lit(False).alias("member"))
    return g.nodes.select("id").join(members.withColumn("m", F.lit(True)), "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("member"))


def independent_set_violations(g: PropertyGraph, flags: DataFrame) -> int:
    """Adjacent members, and nodes without a loop that could still be added."""
    m = flags.where("member").select("id")
    e = g.undirected().where("src <> dst").distinct()
    inside = e.join(m.withColumnRenamed("id", "src"), "src", "left_semi").join(m.withColumnRenamed("id", "dst"), "dst", "left_semi").count()
    covered = e.join(m.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    loops = g.edges.where("src = dst").select(F.col("src").alias("id"))
    free = flags.where("not member").select("id").join(covered.unionAll(loops).distinct(), "id", "left_anti").count()
    return inside + free
