"""Statistics of a graph's shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def summary(g: PropertyGraph) -> DataFrame:
    n = g.nodes.agg(F.count("*").alias("nodes"))
    e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    return n.join(e)  # one row each


def max_degree_node(g: PropertyGraph) -> DataFrame:
    """id and out_degree of the node with the most out-edges; the least id wins ties."""
    return g.out_degree().agg(F.max(F.struct("out_degree", (-F.col("id")).alias("m"))).alias("s")).select((-F.col("s.m")).alias("id"), F.col("s.out_degree").alias("out_degree"))


def histogram(values: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """value and nodes: how many rows have each value, or each bin of equal width, by its number."""
    if bins:
        width = values.agg(F.ceil((F.max(column) + 1) / bins)).first()[0] or 1  # one number
        values = values.withColumn(column, F.floor(F.col(column) / width))
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("nodes"))


def sparsity(g: PropertyGraph, columns: int) -> DataFrame:
    """The occupied cells (row, col) of the adjacency matrix cut into columns x columns blocks."""
    n = g.nodes.agg(F.max("id")).first()[0]
    width = -(-((n or 0) + 1) // columns)
    return g.edges.select(F.floor(F.col("src") / width).alias("row"), F.floor(F.col("dst") / width).alias("col")).distinct()


def degrees(g: PropertyGraph, weight: str | None = None) -> DataFrame:
    """id, out_degree, in_degree."""
    return g.out_degree(weight=weight).join(g.in_degree(weight=weight), "id")


def assortativity(g: PropertyGraph, source: str = "out_degree", target: str = "in_degree", weight: str | None = None) -> DataFrame:
    """Pearson correlation over edges of a degree of the source with one of the target."""
    d = degrees(g, weight)
    x = d.select(F.col("id").alias("src"), F.col(source).cast("double").alias("x"))
    y = d.select(F.col("id").alias("dst"), F.col(target).cast("double").alias("y"))
    return g.edges.select("src", "dst").join(x, "src").join(y, "dst").agg(F.corr("x", "y").alias("assortativity"))


def power_law(g: PropertyGraph) -> DataFrame:
    """Whether degrees look like a power law: 10 nodes and a mean of 10 at least, and mean / 1.3 above the median.

    Taken over all nodes with out-edges, where a sample would be cheaper but not reproducible.
    """
    d = g.out_degree()
    n = d.agg(F.count("*").alias("n"), F.avg("out_degree").alias("mean_all"))
    s = d.where("out_degree > 0").agg(F.avg("out_degree").alias("mean"), F.expr("percentile(out_degree, 0.5)").alias("median"))
    return n.join(s).select((F.coalesce((F.col("n") >= 10) & (F.col("mean_all") >= 10) & (F.col("mean") / 1.3 > F.col("median")), F.lit(False))).alias("power_law"))


def source_nodes(g: PropertyGraph, k: int = 1, seed: int = 1) -> DataFrame:
    """k nodes with out-edges, the first in a fixed pseudo-random order."""
    return g.edges.select(F.col("src").alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)
