"""The property graph: two DataFrames, and the operations on their columns and topology.

nodes: id (long), types (array of names), properties. edges: edge_id, src, dst (long), types,
properties. Graphs are immutable; every change gives a new one. Self-loops and parallel edges are
kept unless an operation says otherwise.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.types import has_any, has_type, is_subtype, type_name
from .plans.ordering import numbered

NODE_KEYS = ("id", "types")
EDGE_KEYS = ("edge_id", "src", "dst", "types")


class GraphError(ValueError):
    """An argument that doesn't fit the graph."""


class AlreadyExists(GraphError):
    """A property of that name is there."""


class PropertyNotFound(GraphError, LookupError):
    """No property has that name."""


def _typed(df: DataFrame) -> DataFrame:
    return df if "types" in df.columns else df.withColumn("types", F.array().cast("array<string>"))


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, nodes: DataFrame | None = None, parts: int | None = None) -> PropertyGraph:
        """A graph of an edge table; nodes default to the ends of the edges. Edge ids follow (src, dst); parts: as in numbered."""
        if nodes is None:
            nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        if "edge_id" not in edges.columns:
            rest = [c for c in edges.columns if c not in ("src", "dst")]
            edges = numbered(edges, ["src", "dst", *[c for c in rest if c != "types"]], "edge_id", parts)
        return PropertyGraph(_typed(nodes), _typed(edges))

    # ------------------------------------------------------------ properties

    def node_properties(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in NODE_KEYS]

    def edge_properties(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_KEYS]

    def _with(self, which: str, table: DataFrame, replace: bool) -> PropertyGraph:
        old, key = (self.nodes, "id") if which == "nodes" else (self.edges, "edge_id")
        new = [c for c in table.columns if c != key]
        both = [c for c in new if c in old.columns]
        if both and not replace:
            raise AlreadyExists(f"properties exist: {both}")
        if set(both) & {*NODE_KEYS, *EDGE_KEYS}:
            raise GraphError(f"reserved names: {both}")
        out = old.drop(*both).join(table, key, "left")
        return PropertyGraph(out, self.edges) if which == "nodes" else PropertyGraph(self.nodes, out)

    def add_node_property(self, table: DataFrame) -> PropertyGraph:
        """Columns of a table keyed by id; an error if a name is there already."""
        return self._with("nodes", table, False)

    def upsert_node_property(self, table: DataFrame) -> PropertyGraph:
        return self._with("nodes", table, True)

    def add_edge_property(self, table: DataFrame) -> PropertyGraph:
        return self._with("edges", table, False)

    def upsert_edge_property(self, table: DataFrame) -> PropertyGraph:
        return self._with("edges", table, True)

    def _column(self, names: list[str], which: str | int) -> str:
        if isinstance(which, int):
            if not 0 <= which < len(names):
                raise PropertyNotFound(f"no property {which}")
            return names[which]
        if which not in names:
            raise PropertyNotFound(f"no property {which!r}")
        return which

    def remove_node_property(self, which: str | int) -> PropertyGraph:
        return PropertyGraph(self.nodes.drop(self._column(self.node_properties(), which)), self.edges)

    def remove_edge_property(self, which: str | int) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.drop(self._column(self.edge_properties(), which)))

    def get_node_property(self, which: str | int, kind: str | None = None) -> DataFrame:
        name = self._column(self.node_properties(), which)
        if kind and self.nodes.schema[name].dataType.simpleString() != kind:
            raise TypeError(f"{name} isn't {kind}")
        return self.nodes.select("id", name)

    def get_edge_property(self, which: str | int, kind: str | None = None) -> DataFrame:
        name = self._column(self.edge_properties(), which)
        if kind and self.edges.schema[name].dataType.simpleString() != kind:
            raise TypeError(f"{name} isn't {kind}")
        return self.edges.select("edge_id", name)

    def schema_listing(self) -> DataFrame:
        """part, position, name and type of every property."""
        rows = []
        for part, df, names in (("nodes", self.nodes, self.node_properties()), ("edges", self.edges, self.edge_properties())):
            rows += [(part, i, n, df.schema[n].dataType.simpleString()) for i, n in enumerate(names)]
        return self.nodes.sparkSession.createDataFrame(rows, "part string, position int, name string, type string")

    def sparsify_booleans(self) -> PropertyGraph:
        """Boolean properties without their false values, which become null: only what holds is stored."""

        def thin(df: DataFrame, names: list[str]) -> DataFrame:
            flags = [n for n in names if df.schema[n].dataType.simpleString() == "boolean"]
            return df.withColumns({n: F.when(F.col(n), F.lit(True)) for n in flags})

        return PropertyGraph(thin(self.nodes, self.node_properties()), thin(self.edges, self.edge_properties()))

    def convert_datetime(self, names: list[str], unit: str = "seconds") -> PropertyGraph:
        """Text or number properties as timestamps; numbers count seconds, millis or micros since 1970. What doesn't parse is null."""

        def as_time(df: DataFrame, n: str) -> Column:
            kind = df.schema[n].dataType.simpleString()
            if kind == "string":
                return F.try_to_timestamp(F.col(n))
            if kind in ("date", "timestamp"):
                return F.col(n).cast("timestamp")
            return {"seconds": F.timestamp_seconds, "millis": F.timestamp_millis, "micros": F.timestamp_micros}[unit](F.col(n))

        def changed(df: DataFrame, have: list[str]) -> DataFrame:
            return df.withColumns({n: as_time(df, n) for n in names if n in have})

        for n in names:
            if n not in self.node_properties() and n not in self.edge_properties():
                raise PropertyNotFound(f"no property {n!r}")
        return PropertyGraph(changed(self.nodes, self.node_properties()), changed(self.edges, self.edge_properties()))

    def select(self, node_properties: list[str] | None = None, edge_properties: list[str] | None = None) -> PropertyGraph:
        """Only the named columns are loaded; the scan reads no others."""
        nodes = self.nodes if node_properties is None else self.nodes.select(*NODE_KEYS, *node_properties)
        edges = self.edges if edge_properties is None else self.edges.select(*EDGE_KEYS, *edge_properties)
        return PropertyGraph(nodes, edges)

    def with_default_weight(self, name: str = "w", value: int = 1) -> PropertyGraph:
        return self if name in self.edges.columns else PropertyGraph(self.nodes, self.edges.withColumn(name, F.lit(value).cast("long")))

    # ------------------------------------------------------------ lookups

    def find_nodes(self, column: str, value: object) -> DataFrame:
        """Point lookup; nulls are never found. Row-group statistics prune the scan."""
        return self.nodes.where(F.col(self._column(self.node_properties(), column)) == F.lit(value))

    def node_range(self, column: str, low: object = None, high: object = None) -> DataFrame:
        """Rows with low <= value < high, in the column's order."""
        c = F.col(self._column(self.node_properties(), column))
        rows = self.nodes.where(c.isNotNull())
        rows = rows if low is None else rows.where(c >= F.lit(low))
        rows = rows if high is None else rows.where(c < F.lit(high))
        return rows.orderBy(c, "id")

    def _edges_at(self, end: str, nodes: int | slice | list[int] | None, properties: list[str] | None, types: list[str] | str | None) -> DataFrame:
        cols = [F.col("edge_id").alias("id"), F.col("src").alias("source"), F.col("dst").alias("dest")]
        cols += [F.col(self._column(self.edge_properties(), p)) for p in (self.edge_properties() if properties is None else properties)]
        e = self.edges if types is None else self.edges.where(has_type(F.col("types"), types))
        at = F.col(end)
        if isinstance(nodes, int):
            e = e.where(at == nodes)
        elif isinstance(nodes, slice):
            e = e.where(at >= (nodes.start or 0))
            e = e if nodes.stop is None else e.where(at < nodes.stop)
            e = e if (nodes.step or 1) == 1 else e.where((at - (nodes.start or 0)) % nodes.step == 0)
        elif nodes is not None:
            wanted = e.sparkSession.createDataFrame(list(enumerate(nodes)), f"place long, {end} long")
            return e.join(wanted, end).orderBy("place", "edge_id").select(*cols)
        return e.select(*cols)

    def out_edges(self, nodes: int | slice | list[int] | None = None, properties: list[str] | None = None, types: list[str] | str | None = None) -> DataFrame:
        """id, source, dest and properties of the edges out of a node, a range or a list of nodes (in list order)."""
        return self._edges_at("src", nodes, properties, types)

    def in_edges(self, nodes: int | slice | list[int] | None = None, properties: list[str] | None = None, types: list[str] | str | None = None) -> DataFrame:
        """id, source, dest and properties of the edges into a node, a range or a list of nodes (in list order)."""
        return self._edges_at("dst", nodes, properties, types)

    def edges_by_id(self, ids: DataFrame) -> DataFrame:
        """edge_id, src, dst and types of the edges whose ids (column edge_id) are given; unknown ids have no row."""
        return self.edges.select("edge_id", "src", "dst", "types").join(ids.select("edge_id").distinct(), "edge_id", "left_semi")

    def sources_of(self, node: int, types: list[str] | str | None = None) -> DataFrame:
        """source of every edge into a node, once."""
        return self.in_edges(node, [], types).select("source").distinct()

    def type_sets(self, which: str = "nodes") -> DataFrame:
        """type, atoms and rows of every type set that the nodes or edges carry."""
        df = self.nodes if which == "nodes" else self.edges
        return df.groupBy("types").agg(F.count("*").alias("rows")).select(type_name(F.col("types")).alias("type"), F.size("types").cast("long").alias("atoms"), "rows")

    def subtypes(self, which: str = "nodes") -> DataFrame:
        """sub and sup: the pairs of type sets in use of which the one's atoms are all in the other's."""
        df = (self.nodes if which == "nodes" else self.edges).select("types").distinct()
        # Type sets are few: they are the schema of the graph, not its rows.
        a, b = df.select(F.col("types").alias("a")), df.select(F.col("types").alias("b"))
        return a.join(b, is_subtype(F.col("a"), F.col("b"))).select(type_name(F.col("a")).alias("sub"), type_name(F.col("b")).alias("sup"))

    def find_edges(self, src: int, dst: int, types: list[str] | str | None = None) -> DataFrame:
        found = self.edges.where((F.col("src") == src) & (F.col("dst") == dst))
        return found if types is None else found.where(has_type(F.col("types"), types))

    def has_edge(self, src: int, dst: int, types: list[str] | str | None = None) -> bool:
        return bool(self.find_edges(src, dst, types).take(1))

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst) with present: whether any edge joins them; parallel edges don't repeat a pair."""
        known = self.edges.select("src", "dst").distinct().withColumn("present", F.lit(True))
        return pairs.join(known, ["src", "dst"], "left").withColumn("present", F.coalesce("present", F.lit(False)))

    # ------------------------------------------------------------ topology

    def _degree(self, end: str, name: str, types: list[str] | str | None, weight: str | None) -> DataFrame:
        e = self.edges if types is None else self.edges.where(has_type(F.col("types"), types))
        value = F.count("*") if weight is None else F.sum(weight)
        counted = e.groupBy(F.col(end).alias("id")).agg(value.alias(name))
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce(name, F.lit(0)).alias(name))

    def out_degree(self, types: list[str] | str | None = None, weight: str | None = None) -> DataFrame:
        return self._degree("src", "out_degree", types, weight)

    def in_degree(self, types: list[str] | str | None = None, weight: str | None = None) -> DataFrame:
        return self._degree("dst", "in_degree", types, weight)

    def project(self, node_types: list | None = None, edge_types: list | None = None) -> PropertyGraph:
        """The nodes and edges of the given types, nodes numbered anew in their old order.

        None keeps all, an empty list keeps none; an edge stays if both its ends do.
        """
        nodes = self.nodes if node_types is None else self.nodes.where(has_any(F.col("types"), node_types))
        edges = self.edges if edge_types is None else self.edges.where(has_any(F.col("types"), edge_types))
        return PropertyGraph(nodes, edges)._renumbered(["id"])

    def _renumbered(self, order: list[str | Column]) -> PropertyGraph:
        nodes = numbered(self.nodes, order, "new_id")
        ids = nodes.select("id", "new_id")
        edges = self.edges.join(ids.withColumnsRenamed({"id": "src", "new_id": "s"}), "src").join(ids.withColumnsRenamed({"id": "dst", "new_id": "d"}), "dst")
        edges = edges.drop("src", "dst").withColumnsRenamed({"s": "src", "d": "dst"})
        return PropertyGraph(nodes.drop("id").withColumnRenamed("new_id", "id"), edges)

    def transpose(self) -> PropertyGraph:
        swap = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
        return PropertyGraph(self.nodes, self.edges.select(*[swap.get(c, F.col(f"`{c}`")) for c in self.edges.columns]))

    def undirected(self, *properties: str) -> DataFrame:
        """src, dst and properties in both directions; loops and reciprocal edges count twice."""
        e = self.edges.select("src", "dst", *properties)
        return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *properties))

    def neighbours(self, symmetric: bool = False, *properties: str) -> DataFrame:
        """The edges an undirected routine walks: as they are if the graph is symmetric, else both ways."""
        return self.edges.select("src", "dst", *properties) if symmetric else self.undirected(*properties)

    def symmetric(self) -> PropertyGraph:
        """Every edge and its reverse; a loop gets none. Edge properties go."""
        e = self.edges.select("src", "dst")
        both = e.unionAll(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return PropertyGraph.of(both, self.nodes)

    def edges_by_destination(self) -> DataFrame:
        """Edges with place: their rank by destination among their source's edges."""
        w = Window.partitionBy("src").orderBy("dst", "edge_id")
        return self.edges.withColumn("place", (F.row_number().over(w) - 1).cast("long"))

    def nodes_by_degree(self) -> PropertyGraph:
        """Nodes numbered by descending (out-degree, id)."""
        g = PropertyGraph(self.nodes.join(self.out_degree().withColumnRenamed("out_degree", "_degree"), "id"), self.edges)
        out = g._renumbered([F.desc("_degree"), F.desc("id")])
        return PropertyGraph(out.nodes.drop("_degree"), out.edges)

    def subgraph(self, ids: list[int]) -> PropertyGraph:
        """The subgraph that a list of nodes induces, numbered by first place in the list; parallel edges stay."""
        spark = self.nodes.sparkSession
        place = {n: i for i, n in reversed(list(enumerate(dict.fromkeys(ids))))}
        table = spark.createDataFrame(list(place.items()), "id long, new_id long")
        edges = self.edges.join(table.withColumnsRenamed({"id": "src", "new_id": "s"}), "src").join(table.withColumnsRenamed({"id": "dst", "new_id": "d"}), "dst")
        return PropertyGraph(_typed(table.select(F.col("new_id").alias("id"))), edges.select("edge_id", F.col("s").alias("src"), F.col("d").alias("dst"), "types"))

    # ------------------------------------------------------------ storage

    def write(self, path: str, note: str = "", compression: str | None = None, rows_per_file: int | None = None) -> int:
        """Store as a new version under path; the manifest is published last. Gives the version.

        A version's number is claimed by creating a file that must not exist, so two writers never share one.
        """
        spark = self.nodes.sparkSession
        known = versions(spark, path)
        v = _claim(spark, path, (max(known) if known else 0) + 1)
        parts = (("nodes", self.nodes.repartitionByRange("id").sortWithinPartitions("id")), ("edges", self.edges.repartitionByRange("src").sortWithinPartitions("src", "edge_id")))
        for name, df in parts:
            writer = df.write.option("maxRecordsPerFile", rows_per_file or 0)
            (writer.option("compression", compression) if compression else writer).parquet(f"{path}/v={v}/{name}")
        manifest = json.dumps({"version": v, "parent": max(known) if known else None, "note": note, "nodes": self.nodes.schema.jsonValue(), "edges": self.edges.schema.jsonValue()})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/v={v}/manifest")
        return v

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None, node_properties: list[str] | None = None, edge_properties: list[str] | None = None) -> PropertyGraph:
        if version is None:
            known = versions(spark, path)
            if not known:
                raise GraphError(f"no graph at {path}")
            version = max(known)
        known = manifest(spark, path, version)
        # With the schemas from the manifest no file footer is read to plan the scan.
        table = lambda part: spark.read.schema(StructType.fromJson(known[part])).parquet(f"{path}/v={version}/{part}")
        g = PropertyGraph(table("nodes"), table("edges"))
        return g.select(node_properties, edge_properties)

    def slice(self, low: int, high: int) -> PropertyGraph:
        """The nodes low <= id < high and the edges out of them; sorted files let the scan skip the rest."""
        return PropertyGraph(self.nodes.where(F.col("id").between(low, high - 1)), self.edges.where(F.col("src").between(low, high - 1)))

    def difference(self, other: PropertyGraph) -> DataFrame:
        """What only one of two graphs has: part, side, rows. All zero if they are equal."""
        out = None
        for part, a, b in (("nodes", self.nodes, other.nodes), ("edges", self.edges, other.edges)):
            if sorted(a.columns) != sorted(b.columns):
                raise GraphError(f"{part} differ in columns")
            cols = sorted(a.columns)
            for side, x, y in (("left", a, b), ("right", b, a)):
                row = x.select(cols).exceptAll(y.select(cols)).agg(F.count("*").alias("rows")).select(F.lit(part).alias("part"), F.lit(side).alias("side"), "rows")
                out = row if out is None else out.unionAll(row)
        return out

    def equals(self, other: PropertyGraph) -> bool:
        return self.difference(other).agg(F.sum("rows")).first()[0] == 0


def _claim(spark: SparkSession, path: str, first: int) -> int:
    jvm = spark.sparkContext._jvm
    v = first
    while True:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{v}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.createNewFile(p):
            return v
        v += 1


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """What was published with a version: its number, parent, note and schemas."""
    return json.loads(spark.read.text(f"{path}/v={version}/manifest").first()[0])


def history(spark: SparkSession, path: str) -> DataFrame:
    """version, parent and note of every published version."""
    rows = spark.read.text(f"{path}/v=*/manifest").select(F.from_json("value", "version long, parent long, note string").alias("m"))
    return rows.select("m.version", "m.parent", "m.note")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions under path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/manifest/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(s.getPath().getParent().getParent().getName()[2:]) for s in found)
