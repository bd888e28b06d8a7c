"""Text forms of graphs and results; one file part per task, nothing is gathered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.plans.ordering import numbered


def _text(df: DataFrame, path: str, *cols, sep: str = " ") -> None:
    df.select(F.concat_ws(sep, *[c.cast("string") for c in cols]).alias("value")).write.text(path)


def write_values(values: DataFrame, path: str) -> None:
    """Lines "id value"."""
    _text(values, path, *[F.col(c) for c in values.columns[:2]])


def write_edge_list(g: PropertyGraph, path: str, weight: str | None = None, first: int = 0) -> None:
    """Lines of source and destination, numbered from first, and the weight if one is named."""
    cols = [F.col("src") + first, F.col("dst") + first] + ([F.col(weight)] if weight else [])
    _text(g.edges, path, *cols)


def adjacency(g: PropertyGraph) -> DataFrame:
    """id and its destinations, ascending; every node has a row."""
    lists = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("to"))
    return g.nodes.select("id").join(lists, "id", "left").select("id", F.coalesce("to", F.array().cast("array<bigint>")).alias("to"))


def write_adjacency(g: PropertyGraph, path: str) -> None:
    _text(adjacency(g), path, F.col("id"), F.array_join("to", " "))


def write_dimacs(g: PropertyGraph, path: str, weight: str = "w") -> None:
    """A header part and "a" lines, numbered from 1."""
    spark = g.nodes.sparkSession
    head = spark.createDataFrame([(f"p sp {g.nodes.count()} {g.edges.count()}",)], "value string")
    lines = g.edges.select(F.concat_ws(" ", F.lit("a"), (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.col(weight).cast("string")).alias("value"))
    head.coalesce(1).unionAll(lines).write.text(path)


def write_matrix_market(g: PropertyGraph, path: str, weight: str = "w") -> None:
    """Coordinate format, numbered from 1."""
    spark, n = g.nodes.sparkSession, g.nodes.count()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{n} {n} {g.edges.count()}",)], "value string")
    lines = g.edges.select(F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.col(weight).cast("string")).alias("value"))
    head.coalesce(1).unionAll(lines).write.text(path)


def write_metis(g: PropertyGraph, path: str) -> None:
    """A header part of nodes and undirected edges, then each node's neighbours from 1, in node order; loops go."""
    spark = g.nodes.sparkSession
    both = g.undirected().where("src <> dst").distinct()
    lists = both.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.col("dst") + 1)).alias("to"))
    lines = g.nodes.select("id").join(lists, "id", "left").orderBy("id").select(F.coalesce(F.array_join("to", " "), F.lit("")).alias("value"))
    spark.createDataFrame([(f"{g.nodes.count()} {both.count() // 2}",)], "value string").coalesce(1).unionAll(lines).write.text(path)


def write_pbbs(g: PropertyGraph, path: str, weight: str | None = None) -> None:
    """The adjacency form, one number a line: nodes, edges, each node's first edge, destinations, weights. Nodes must be 0 .. N - 1."""
    spark = g.nodes.sparkSession
    n, m = g.nodes.count(), g.edges.count()
    e = numbered(g.edges.select("src", "dst", "edge_id", *([weight] if weight else [])), ["src", "dst", "edge_id"], "k")
    first = g.nodes.select("id").join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    first = numbered(first, ["id"], "row")
    # Sums before each node by ranges of 65536 nodes, then within them.
    sums = first.groupBy(F.shiftright("row", 16).alias("b")).agg(F.sum("d").alias("s"))
    sums = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("b").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lo = first.withColumn("b", F.shiftright("row", 16)).withColumn("in", F.coalesce(F.sum("d").over(w), F.lit(0))).join(sums, "b").select((F.col("row") + 3).alias("k"), (F.col("base") + F.col("in")).cast("string").alias("value"))
    parts = spark.createDataFrame([(0, "WeightedAdjacencyGraph" if weight else "AdjacencyGraph"), (1, str(n)), (2, str(m))], "k long, value string")
    parts = parts.unionAll(lo).unionAll(e.select(F.col("k") + 3 + n, F.col("dst").cast("string")))
    if weight:
        parts = parts.unionAll(e.select(F.col("k") + 3 + n + m, F.col(weight).cast("string")))
    parts.orderBy("k").select("value").write.text(path)


def write_svmlight(g: PropertyGraph, path: str, weight: str = "w") -> None:
    """A line per node: label 0, then destination:weight, ascending."""
    lists = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", F.col(weight).alias("v")))).alias("to"))
    lines = g.nodes.select("id").join(lists, "id", "left").orderBy("id")
    pairs = F.array_join(F.transform("to", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["v"].cast("string"))), " ")
    lines.select(F.concat_ws(" ", F.lit("0"), pairs).alias("value")).write.text(path)


def write_graphml(g: PropertyGraph, path: str) -> None:
    """GraphML with typed data for scalar properties, labels from the type sets; each part is a document of its own."""
    names = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean", "string": "string"}

    def scalars(df: DataFrame, props: list[str]) -> list[tuple[str, str]]:
        return [(p, names[df.schema[p].dataType.simpleString()]) for p in props if df.schema[p].dataType.simpleString() in names]

    def safe(c: Column) -> Column:
        out = c.cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    np_, ep = scalars(g.nodes, g.node_properties()), scalars(g.edges, g.edge_properties())
    keys = [f'<key id="{p}" for="{kind}" attr.name="{p}" attr.type="{t}"/>' for kind, props in (("node", np_), ("edge", ep)) for p, t in props]
    data = lambda props: [F.coalesce(F.concat(F.lit(f'<data key="{p}">'), safe(F.col(p)), F.lit("</data>")), F.lit("")) for p, _ in props]
    n = g.nodes.select(F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('" labels="'), F.array_join(F.transform("types", lambda t: F.concat(F.lit(":"), safe(t))), ""), F.lit('">'), *data(np_), F.lit("</node>")).alias("value"))
    e = g.edges.select(F.concat(F.lit('<edge id="'), F.col("edge_id").cast("string"), F.lit('" source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('" label="'), F.array_join(F.transform("types", safe), ":"), F.lit('">'), *data(ep), F.lit("</edge>")).alias("value"))
    head = "".join(['<?xml version="1.0" encoding="UTF-8"?><graphml>', *keys, "<graph>"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.string())], names=["value"])
        yield line(head)
        yield from batches
        yield line("</graph></graphml>")

    n.unionAll(e).mapInArrow(whole, "value string").write.text(path)


def to_edge_frame(g: PropertyGraph) -> DataFrame:
    """source, destination and the edge properties."""
    return g.edges.select(F.col("src").alias("source"), F.col("dst").alias("destination"), *g.edge_properties())
