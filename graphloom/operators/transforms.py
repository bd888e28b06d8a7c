"""Graph rewrites: cleaning, orientation, overlays, degree limits, splits, renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def clean(g: PropertyGraph) -> PropertyGraph:
    """Without self-loops, and with the edge of least id of each (src, dst)."""
    least = g.edges.where("src <> dst").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id")).select("edge_id")
    return PropertyGraph(g.nodes, g.edges.join(least, "edge_id", "left_semi"))


def triangular(g: PropertyGraph) -> PropertyGraph:
    """One direction of a symmetric graph: src <= dst."""
    return PropertyGraph(g.nodes, g.edges.where("src <= dst"))


def hash_weights(g: PropertyGraph, low: int, high: int, name: str = "w", seed: int = 1) -> PropertyGraph:
    """A weight in [low, high] for every edge, fixed by its ends and the seed."""
    mixed = (F.col("src") * 2654435761 + F.col("dst") * 40503 + seed) % 1000003
    return PropertyGraph(g.nodes, g.edges.drop(name).withColumn(name, F.lit(low) + mixed * 7919 % 1000003 % (high - low + 1)))


def low_degree(g: PropertyGraph, most: int) -> PropertyGraph:
    """Without the nodes of out-degree above most and their edges, numbered anew."""
    few = g.out_degree().where(F.col("out_degree") <= most).select("id")
    return PropertyGraph(g.nodes.join(few, "id", "left_semi"), g.edges)._renumbered(["id"])


def by_ascending_degree(g: PropertyGraph) -> PropertyGraph:
    """Nodes numbered by ascending (out-degree, id)."""
    h = PropertyGraph(g.nodes.join(g.out_degree().withColumnRenamed("out_degree", "_degree"), "id"), g.edges)._renumbered(["_degree", "id"])
    return PropertyGraph(h.nodes.drop("_degree"), h.edges)


def shuffled(g: PropertyGraph, seed: int = 1) -> PropertyGraph:
    """Nodes numbered in a fixed pseudo-random order."""
    return g._renumbered([F.xxhash64("id", F.lit(seed)), F.col("id")])


def remap(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The nodes listed in ids (column id), numbered by ascending id, and the edges among them."""
    return PropertyGraph(g.nodes.join(ids.select("id").distinct(), "id", "left_semi"), g.edges)._renumbered(["id"])


def overlay(g: PropertyGraph, shape: str, weight: int) -> DataFrame:
    """src, dst, w of the graph's edges and those of a ring, line or binary tree over nodes 0..N-1."""
    spark, n = g.nodes.sparkSession, g.nodes.count()
    i = F.col("id")
    if shape == "ring":
        extra = spark.range(n).select(i.alias("src"), ((i + 1) % n).alias("dst"))
    elif shape == "line":
        extra = spark.range(max(0, n - 1)).select(i.alias("src"), (i + 1).alias("dst"))
    elif shape == "tree":
        extra = spark.range(1, max(1, n)).select(F.floor((i - 1) / 2).alias("src"), i.alias("dst"))
    else:
        raise ValueError(shape)
    return g.edges.select("src", "dst", F.col("w").cast("long").alias("w")).unionAll(extra.withColumn("w", F.lit(weight).cast("long")))


def split(g: PropertyGraph, parts: int, by: str = "src") -> DataFrame:
    """Edges with part: which of N equal ranges of node ids the end lies in; for partitionBy on write."""
    top = g.nodes.agg(F.max("id").alias("top"))
    top = top.first()[0] or 0  # one number
    return g.edges.withColumn("part", F.floor(F.col(by) * parts / (top + 1)))


def sort_by_weight(g: PropertyGraph, weight: str = "w") -> DataFrame:
    """Edges with place: their rank by weight among their source's edges."""
    w = Window.partitionBy("src").orderBy(weight, "edge_id")
    return g.edges.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
