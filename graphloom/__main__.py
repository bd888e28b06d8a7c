"""Command line: python -m graphloom ALGORITHM INPUT OUTPUT runs an algorithm over a graph and writes its result as Parquet."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .graph import PropertyGraph
from .operators import apps, centrality, communities, peeling, stats, traversal, triangles
from .sources import ingest

READERS = {
    "graph": lambda spark, path: PropertyGraph.read(spark, path),
    "edgelist": lambda spark, path: ingest.read_edge_list(spark, path),
    "weighted-edgelist": lambda spark, path: ingest.read_edge_list(spark, path, weighted=True),
    "csv": lambda spark, path: ingest.read_csv(spark, path),
    "dimacs": ingest.read_dimacs,
    "mtx": ingest.read_matrix_market,
    "pbbs": ingest.read_pbbs,
    "graphml": ingest.read_graphml,
}
ALGORITHMS = {
    "bfs": lambda g, a: traversal.bfs(g, a.source),
    "sssp": lambda g, a: traversal.sssp(g, a.source, a.weight),
    "k-shortest-paths": lambda g, a: traversal.k_shortest_paths(g, a.source, a.target, a.k, a.weight, symmetric=a.symmetric),
    "components": lambda g, a: communities.connected_components(g),
    "pagerank": lambda g, a: centrality.pagerank(g, a.alpha, a.tolerance, a.max_iterations),
    "betweenness": lambda g, a: centrality.betweenness(g),
    "label-propagation": lambda g, a: communities.cdlp(g, a.max_iterations, a.symmetric),
    "louvain": lambda g, a: communities.louvain(g, a.weight, max_iterations=a.max_iterations),
    "leiden": lambda g, a: communities.leiden(g, a.weight, max_iterations=a.max_iterations),
    "k-core": lambda g, a: peeling.k_core(g, a.k, a.symmetric),
    "k-truss": lambda g, a: peeling.k_truss(g, a.k),
    "independent-set": lambda g, a: peeling.independent_set(g),
    "triangles": lambda g, a: triangles.triangle_count(g),
    "clustering": lambda g, a: triangles.local_clustering(g),
    "jaccard": lambda g, a: triangles.jaccard(g, a.source),
    "spanning-forest": lambda g, a: apps.spanning_forest(g, a.weight),
    "max-flow": lambda g, a: apps.max_flow(g, a.source, a.target, a.weight),
    "random-walks": lambda g, a: apps.random_walks(g, a.length, symmetric=a.symmetric),
    "summary": lambda g, a: stats.summary(g),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("algorithm", choices=sorted(ALGORITHMS))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", choices=sorted(READERS), default="graph")
    p.add_argument("--source", type=int, default=0)
    p.add_argument("--target", type=int, default=1)
    p.add_argument("--k", type=int, default=3)
    p.add_argument("--length", type=int, default=5)
    p.add_argument("--weight", default="w")
    p.add_argument("--alpha", type=float, default=0.85)
    p.add_argument("--tolerance", type=float, default=1e-3)
    p.add_argument("--max-iterations", type=int, default=1000)
    p.add_argument("--symmetric", action="store_true", help="the graph has every edge both ways")
    return p


def run(spark: SparkSession, arguments: list[str] | None = None) -> DataFrame:
    a = parser().parse_args(arguments)
    began = time.time()
    ALGORITHMS[a.algorithm](READERS[a.format](spark, a.input), a).write.mode("errorifexists").parquet(a.output)
    print(f"{a.algorithm}: {time.time() - began:.1f} s")
    return spark.read.parquet(a.output)


if __name__ == "__main__":
    run(SparkSession.builder.appName("graphloom").getOrCreate())
