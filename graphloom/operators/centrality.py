"""PageRank and betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.plans.session import cut

#: PageRank rounds between two checkpoints.
FUSED = 5


def pagerank(g: PropertyGraph, alpha: float = 0.85, tolerance: float | None = 1e-3, max_iterations: int = 1000) -> DataFrame:
    """id and rank, not normalised: 1 - alpha plus alpha times what in-neighbours share out.

    Dangling mass is dropped; parallel edges count each. With tolerance None, exactly
    max_iterations rounds are made from 1/N; else rounds go on from 1 until FUSED of them together
    move the ranks by at most the tolerance in sum. A round moves one partial sum per edge's end; shares
    are computed once, with the edges.
    """
    out = g.edges.groupBy("src").agg(F.count("*").alias("d"))
    edges = cut(g.edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("d")).alias("share")))
    n = g.nodes.count()
    nodes = cut(g.nodes.select("id"))
    state = cut(nodes.select("id", F.lit(1.0 if tolerance is not None else 1.0 / max(n, 1)).alias("rank")))

    def step(ranks: DataFrame) -> DataFrame:
        gained = edges.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
        return nodes.join(gained, "id", "left").select("id", (F.lit(1 - alpha) + alpha * F.coalesce("s", F.lit(0.0))).alias("rank"))

    done = 0
    while done < max_iterations:
        rounds = min(FUSED, max_iterations - done)
        nxt = state
        for _ in range(rounds):
            nxt = step(nxt)
        done += rounds
        if tolerance is None:
            state = cut(nxt)
            continue
        moved = cut(nxt.join(state.withColumnRenamed("rank", "old"), "id"))
        change = moved.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        state = moved.select("id", "rank")
        if change <= tolerance:
            break
    return state


def pagerank_statistics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.max("rank").alias("max_rank"), F.min("rank").alias("min_rank"), F.avg("rank").alias("average_rank"))


def betweenness(g: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """id and score: shortest-path shares through each node from the sources (all nodes if None).

    Unweighted, along out-edges, not normalised; parallel edges make parallel paths. All sources
    advance together: the state is one row per source and node reached, forward by levels with path
    counts, then backward over the edges of the shortest-path graphs.
    """
    edges = cut(g.edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("m")))
    start = (g.nodes if sources is None else sources).select("id").distinct()
    frontier = cut(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma")))
    visited, dags, level = frontier, [], 0
    while True:
        level += 1
        reach = edges.join(frontier.select("s", F.col("v").alias("src"), F.col("sigma").alias("su")), "src")
        dag = cut(reach.join(visited.select("s", F.col("v").alias("dst")), ["s", "dst"], "left_anti").select("s", "src", "dst", "m", "su"))
        frontier = cut(dag.groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("su") * F.col("m")).alias("sigma")).select("s", "v", F.lit(level).alias("level"), "sigma"))
        if frontier.isEmpty():
            break
        dags.append((dag, frontier))
        visited = visited.unionAll(frontier)
    total, below = None, None
    for dag, front in reversed(dags):
        mine = front.select("s", F.col("v").alias("dst"), F.col("sigma").alias("sv"))
        if below is None:
            mine = mine.withColumn("delta", F.lit(0.0))
        else:
            mine = mine.join(below.select("s", F.col("v").alias("dst"), "delta"), ["s", "dst"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        share = F.sum(F.col("su") * F.col("m") / F.col("sv") * (1 + F.col("delta"))).alias("delta")
        below = cut(dag.join(mine, ["s", "dst"]).groupBy("s", F.col("src").alias("v")).agg(share))
        part = below.where("s <> v").groupBy("v").agg(F.sum("delta").alias("score"))
        total = part if total is None else total.unionAll(part)
    if total is None:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    summed = total.groupBy(F.col("v").alias("id")).agg(F.sum("score").alias("score"))
    return g.nodes.select("id").join(summed, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def betweenness_statistics(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max("score").alias("max_centrality"), F.min("score").alias("min_centrality"), F.avg("score").alias("average_centrality"))
