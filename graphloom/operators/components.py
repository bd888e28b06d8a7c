"""Connected components over an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.session import cut


def _mark(e: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(e.agg(F.count("*"), F.sum(h)).first())


def min_label(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """id and label for every end of an edge (src, dst): the least id that its component has.

    Alternates two rewrites until nothing changes. First every vertex points its larger neighbours
    at the least vertex it sees; then every vertex points its smaller neighbours and itself there.
    Each keeps components whole, and the number of rounds grows with the logarithm of the size, not
    with the diameter. State is one row per edge, written to the shared checkpoint folder each
    round; only a count and a digest come to the driver. Minima are aggregated before they are
    joined back, so a vertex with very many neighbours is never one task's group.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        now = _mark(nxt)
        e, before, mark = nxt, mark, now
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionAll(roots.select("id", F.col("id").alias("label")))
