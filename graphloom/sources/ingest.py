"""Graphs from arrays, tables and files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.types import flags_to_labels
from graphloom.graph import GraphError, PropertyGraph
from graphloom.plans.ordering import numbered
from graphloom.plans.session import cut

#: Spark types of the value types that GraphML names; others are read as strings.
GRAPHML_TYPES = {"long": "long", "int64": "long", "int": "int", "int32": "int", "double": "double", "float": "float", "boolean": "boolean", "bool": "boolean", "string": "string", "timestamp": "timestamp"}


def _ids(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Nodes 0 .. the largest id of an edge's end."""
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]  # one number
    return spark.range((top if top is not None else -1) + 1).select("id")


def from_edge_frame(df: DataFrame, source: str = "source", destination: str = "destination", properties: list[str] | None = None, keep_order: bool = False) -> PropertyGraph:
    """A graph of an edge table; other columns become properties. Edge ids follow the source, or the input if keep_order."""
    rest = [c for c in df.columns if c not in (source, destination)] if properties is None else properties
    e = df.select(F.col(source).cast("long").alias("src"), F.col(destination).cast("long").alias("dst"), *rest)
    if e.isEmpty():
        raise GraphError("no edges")
    e = e.withColumn("_in", F.monotonically_increasing_id())
    e = numbered(e, ["_in"] if keep_order else ["src", "_in"], "edge_id").drop("_in")
    return PropertyGraph.of(e, _ids(df.sparkSession, e))


def from_edge_arrays(spark: SparkSession, sources: list[int], destinations: list[int], properties: dict[str, list] | None = None, keep_order: bool = False) -> PropertyGraph:
    properties = properties or {}
    if len(sources) != len(destinations) or any(len(v) != len(sources) for v in properties.values()):
        raise GraphError("arrays differ in length")
    if not sources:
        raise GraphError("no edges")
    rows = list(zip(range(len(sources)), map(int, sources), map(int, destinations), *properties.values()))
    df = spark.createDataFrame(rows, ["_n", "source", "destination", *properties]).orderBy("_n").drop("_n")
    return from_edge_frame(df, keep_order=keep_order)


def from_edge_matrix(spark: SparkSession, pairs: list) -> PropertyGraph:
    return from_edge_arrays(spark, [p[0] for p in pairs], [p[1] for p in pairs])


def from_adjacency_matrix(spark: SparkSession, matrix: list, name: str = "weight") -> PropertyGraph:
    """An edge for every non-zero cell, with its value."""
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "source long, v array<double>")
    e = df.select("source", F.posexplode("v").alias("destination", name)).where(F.col(name) != 0)
    g = from_edge_frame(e)
    return PropertyGraph(_typed_range(spark, len(matrix)), g.edges)


def _typed_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", F.array().cast("array<string>").alias("types"))


def from_csr(spark: SparkSession, ends: list[int], destinations: list[int]) -> PropertyGraph:
    """ends[i]: number of edges out of nodes 0..i; edges are contiguous by source."""
    if (ends[-1] if ends else 0) != len(destinations):
        raise GraphError("offsets don't fit the destinations")
    rows = [(i, ends[i - 1] if i else 0, e) for i, e in enumerate(ends)]
    span = spark.createDataFrame(rows, "src long, lo long, hi long").where("hi > lo").select("src", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("edge_id"))
    dst = spark.createDataFrame(list(enumerate(map(int, destinations))), "edge_id long, dst long")
    return PropertyGraph.of(span.join(dst, "edge_id"), spark.range(len(ends)).select("id"))


def build(nodes: DataFrame, edges: DataFrame, key: str = "key", source: str = "source", target: str = "target") -> PropertyGraph:
    """Nodes under keys of any type, edges that name them; ids follow the keys. Edges to no node are an error."""
    n = numbered(nodes, [key], "id")
    ids = n.select(F.col(key).alias("_k"), "id")
    ends = edges.join(ids.withColumnsRenamed({"_k": source, "id": "src"}), source, "left").join(ids.withColumnsRenamed({"_k": target, "id": "dst"}), target, "left")
    if ends.where("src is null or dst is null").take(1):
        raise GraphError("an edge names a node that isn't there")
    return PropertyGraph.of(ends.drop(source, target), n)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and place of every line that isn't blank; place ascends with the file's name and the line's place in it."""
    t = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("place"))
    return t.where("trim(value) <> ''")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, source: str = "source", destination: str = "destination", schema: str | None = None) -> PropertyGraph:
    reader = spark.read.option("sep", sep).option("header", header)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return from_edge_frame(df, source, destination)


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> PropertyGraph:
    """Lines of source, destination and, if weighted, an integer weight, split by blanks; # starts a comment."""
    f = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where("value rlike '^\\\\s*[0-9]'")
    cols = [f[0].cast("long").alias("source"), f[1].cast("long").alias("destination")] + ([f[2].cast("long").alias("w")] if weighted else [])
    return from_edge_frame(t.select(*cols))


def read_matrix_market(spark: SparkSession, path: str) -> PropertyGraph:
    """Coordinate format, numbered from 1; the size line says how many nodes there are."""
    t = lines(spark, path).where("value rlike '^\\\\s*[0-9]'")
    size = t.orderBy("place").first()
    rows, cols, _ = size["value"].split()[:3]
    f = F.split(F.trim("value"), r"\s+")
    e = t.where(F.col("place.n") != size["place"]["n"]).select((f[0].cast("long") - 1).alias("source"), (f[1].cast("long") - 1).alias("destination"), F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
    return PropertyGraph(_typed_range(spark, max(int(rows), int(cols))), from_edge_frame(e).edges)


def read_dimacs(spark: SparkSession, path: str) -> PropertyGraph:
    """Lines "a source destination weight", numbered from 1; "p" gives the number of nodes."""
    t = spark.read.text(path)
    f = F.split(F.trim("value"), r"\s+")
    head = t.where("value like 'p %'").first()
    e = t.where("value like 'a %'").select((f[1].cast("long") - 1).alias("source"), (f[2].cast("long") - 1).alias("destination"), f[3].cast("long").alias("w"))
    g = from_edge_frame(e)
    return PropertyGraph(_typed_range(spark, int(head["value"].split()[2])), g.edges) if head else g


def read_node_list(spark: SparkSession, path: str) -> PropertyGraph:
    """Lines of a node and its destinations."""
    f = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where("trim(value) <> ''")
    return from_edge_frame(t.select(f[0].cast("long").alias("source"), F.explode(F.slice(f, 2, F.size(f) - 1).cast("array<bigint>")).alias("destination")))


def read_svmlight(spark: SparkSession, path: str) -> PropertyGraph:
    """Lines "label feature:value ..."; a line is a node, features are nodes after all lines."""
    t = numbered(lines(spark, path), ["place"], "source")
    n = t.count()
    f = F.split(F.trim("value"), r"\s+")
    e = t.select("source", F.explode(F.slice(f, 2, F.size(f) - 1)).alias("f")).select("source", F.split("f", ":").alias("p")).select("source", (F.col("p")[0].cast("long") + n).alias("destination"), F.col("p")[1].cast("double").alias("w"))
    return from_edge_frame(e)


def _keyed(key: str):
    return lambda x: x["_key"] == key


def read_graphml(spark: SparkSession, path: str) -> PropertyGraph:
    """Nodes with labels and typed data; edges with a label and typed data. Data keys become properties."""
    keys = [r.asDict() for r in spark.read.format("xml").option("rowTag", "key").schema("_id string, _for string, `_attr.name` string, `_attr.type` string, `_attr.list` string").load(path).where("_id is not null").distinct().orderBy("_id").collect()]
    data = "data array<struct<_key:string,_VALUE:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, _labels string, {data}").load(path).where("_id is not null")  # a file without the tag gives an empty row
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, _label string, {data}").load(path).where("_source is not null")

    def props(kind: str) -> list:
        out = []
        for k in keys:
            if k["_for"] in (kind, "all", None):
                value = F.get(F.filter("data", _keyed(k["_id"])), F.lit(0))["_VALUE"]
                listed = k["_attr.list"]
                cast = F.from_json(value, f"array<{GRAPHML_TYPES.get(listed, 'string')}>") if listed else value.cast(GRAPHML_TYPES.get(k["_attr.type"], "string"))
                out.append(cast.alias(k["_attr.name"] or k["_id"]))
        return out

    labels = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ":"), lambda x: x != "")))
    n = nodes.select(F.col("_id").alias("key"), labels("_labels").alias("types"), *props("node"))
    e = edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"), labels("_label").alias("types"), *props("edge"))
    return build(n, e)


def _with_types(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """df with types: the names of those flag columns that are set; the columns stay as properties unless they go."""
    return df.withColumn("types", flags_to_labels(columns)) if columns else df


def from_typed_frames(nodes: DataFrame, edges: DataFrame, node_types: list[str] | None = None, edge_types: list[str] | None = None, key: str = "id", source: str = "source", destination: str = "destination") -> PropertyGraph:
    """A graph of a node and an edge table whose flag columns named in node_types and edge_types become types."""
    n = _with_types(nodes, node_types).drop(*(node_types or [])).withColumnRenamed(key, "id").withColumn("id", F.col("id").cast("long"))
    e = _with_types(edges, edge_types).drop(*(edge_types or [])).withColumnsRenamed({source: "src", destination: "dst"})
    return PropertyGraph.of(e.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")}), n)


def from_csr_types(spark: SparkSession, ends: list[int], destinations: list[int], node_types: list[list[str]], edge_types: list[list[str]]) -> PropertyGraph:
    """from_csr with a type set for every node and for every edge, in their order."""
    if len(node_types) != len(ends) or len(edge_types) != len(destinations):
        raise GraphError("types don't fit the arrays")
    g = from_csr(spark, ends, destinations)
    n = spark.createDataFrame([(i, sorted(t)) for i, t in enumerate(node_types)], "id long, types array<string>")
    e = spark.createDataFrame([(i, sorted(t)) for i, t in enumerate(edge_types)], "edge_id long, types array<string>")
    return PropertyGraph(g.nodes.drop("types").join(n, "id"), g.edges.drop("types").join(e, "edge_id"))


def read_pbbs(spark: SparkSession, path: str) -> PropertyGraph:
    """A file that begins with AdjacencyGraph or WeightedAdjacencyGraph, then numbers: nodes, edges, offsets, destinations, weights."""
    t = lines(spark, path)
    kind = t.orderBy("place").first()["value"].strip()
    if kind not in ("AdjacencyGraph", "WeightedAdjacencyGraph"):
        raise GraphError(f"not an adjacency graph: {kind[:40]}")
    words = t.where(F.trim("value") != kind).select("place", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "x"))
    x = cut(numbered(words.select("place", "at", F.col("x").cast("double").alias("x")), ["place", "at"], "k").select("k", "x"))
    n, m = (int(r["x"]) for r in x.where("k < 2").orderBy("k").collect())  # two numbers
    offsets = x.where((F.col("k") >= 2) & (F.col("k") < 2 + n)).select((F.col("k") - 2).alias("src"), F.col("x").cast("long").alias("lo"))
    ends = offsets.select((F.col("src") - 1).alias("src"), F.col("lo").alias("hi")).where("src >= 0").unionAll(spark.createDataFrame([(n - 1, m)], "src long, hi long"))
    span = offsets.join(ends, "src").where("hi > lo").select("src", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("edge_id"))
    dst = x.where((F.col("k") >= 2 + n) & (F.col("k") < 2 + n + m)).select((F.col("k") - 2 - n).alias("edge_id"), F.col("x").cast("long").alias("dst"))
    e = span.join(dst, "edge_id")
    if kind.startswith("Weighted"):
        e = e.join(x.where(F.col("k") >= 2 + n + m).select((F.col("k") - 2 - n - m).alias("edge_id"), F.col("x").alias("w")), "edge_id")
    return PropertyGraph.of(e, spark.range(n).select("id"))


def from_networkx(spark: SparkSession, graph) -> PropertyGraph:
    """A graph of an object with nodes(data=True) and edges(data=True), as networkx has; attributes become properties."""
    nodes = [(str(k), json.dumps(v, default=str)) for k, v in graph.nodes(data=True)]
    edges = [(str(a), str(b), json.dumps(v, default=str)) for a, b, v in graph.edges(data=True)]
    n = spark.createDataFrame(nodes, "key string, attributes string")
    return build(n, spark.createDataFrame(edges, "source string, target string, attributes string"))


def from_documents(collections: dict[str, DataFrame], relations: list[tuple[str, str, str]], key: str = "_id") -> PropertyGraph:
    """A graph of document collections read by any Spark connector: a node per document, typed by its collection.

    relations: (collection, field, edge type); field holds the key of another document, or an array
    of keys. Scalar fields become properties, the others JSON text.
    """
    tables = {name: (df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array<struct", "map"))}), key) for name, df in collections.items()}
    nodes = _union([_row_nodes(name, df, pk) for name, (df, pk) in tables.items()])
    by_key = nodes.select("key", F.element_at(F.split("key", ":", 2), 2).alias("raw"))
    edges = None
    for name, field, kind in relations:
        df, pk = collections[name], key
        value = F.explode(F.col(field)) if dict(df.dtypes)[field].startswith("array") else F.col(field)
        part = df.select(F.concat_ws(":", F.lit(name), F.col(pk).cast("string")).alias("source"), value.cast("string").alias("raw")).where("raw is not null")
        part = part.join(by_key, "raw").select("source", F.col("key").alias("target"), F.array(F.lit(kind)).alias("types"))
        edges = part if edges is None else edges.unionAll(part)
    return build(nodes, edges)


def _row_nodes(name: str, df: DataFrame, pk: str) -> DataFrame:
    rest = [c for c in df.columns if c not in ("key", "types", "id")]
    return df.select(F.concat_ws(":", F.lit(name), F.col(pk).cast("string")).alias("key"), F.array(F.lit(name)).alias("types"), *rest)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def from_tables(tables: dict[str, tuple[DataFrame, str]], links: list[tuple[str, str, str, str]], relations: list[tuple[DataFrame, tuple[str, str], tuple[str, str], str]] | None = None) -> PropertyGraph:
    """A graph of relational tables: a node per row with the row's columns, an edge per foreign key that isn't null.

    tables: name to (table, primary key); links: (table, column, referenced table, edge type);
    relations: pure relation tables as (table, (column, referenced table), (column, referenced
    table), edge type), whose rows are edges with the other columns as properties. Columns of one
    name must have one type.
    """
    nodes = _union([_row_nodes(name, df, pk) for name, (df, pk) in tables.items()])
    at = lambda table, column: F.concat_ws(":", F.lit(table), F.col(column).cast("string"))
    parts = []
    for name, column, other, kind in links:
        df, pk = tables[name]
        parts.append(df.where(F.col(column).isNotNull()).select(at(name, pk).alias("source"), at(other, column).alias("target"), F.array(F.lit(kind)).alias("types")))
    for df, (a, ta), (b, tb), kind in relations or []:
        rest = [c for c in df.columns if c not in (a, b)]
        parts.append(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(at(ta, a).alias("source"), at(tb, b).alias("target"), F.array(F.lit(kind)).alias("types"), *rest))
    return build(nodes, _union(parts))
