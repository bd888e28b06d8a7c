"""Registered queries of sources, sinks, storage and lookups; files go to the shared checkpoint folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import graphs
from .functions.types import type_name
from .graph import PropertyGraph, history, versions
from .operators import communities, stats, transforms, traversal
from .plans.ordering import numbered
from .plans.session import cut, scratch
from .queries import _first, nodes_of, query, with_
from .sources import ingest, sinks, topologies

_E = with_("SELECT src, dst, w FROM e1", "e1")
_BARE = with_("SELECT src, dst FROM e1", "e1")
_NUMBERED = "SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM e1"


def _edges(g: PropertyGraph, *cols: str):
    return g.edges.select("src", "dst", *(cols or ("w",)))


# ---------------------------------------------------------------- storage


@query(with_("SELECT src, dst, w FROM e1", "e1"))
def storage_round_trip(spark, d):
    path = scratch(spark, "graph")
    graphs.user_next(spark, d).write(path)
    return _edges(PropertyGraph.read(spark, path, edge_properties=["w"]))


@query("SELECT 1 AS version, NULL::BIGINT AS parent, 'first' AS note UNION ALL SELECT 2, 1, 'turned'")
def storage_versions(spark, d):
    path = scratch(spark, "graph")
    g = graphs.user_next(spark, d)
    g.write(path, "first")
    g.transpose().write(path, "turned", compression="zstd", rows_per_file=1000)
    assert versions(spark, path) == [1, 2]
    return history(spark, path)


@query(with_("SELECT src, dst, w FROM e1 WHERE src >= 10 AND src < 30", "e1"))
def storage_slice(spark, d):
    path = scratch(spark, "graph")
    graphs.user_next(spark, d).write(path)
    return _edges(PropertyGraph.read(spark, path).slice(10, 30))


@query(with_("SELECT 'nodes' AS part, 'left' AS side, 0 AS rows UNION ALL SELECT 'nodes', 'right', 0 UNION ALL SELECT 'edges', s, (SELECT count(*) FROM e1 WHERE w % 7 = 0) FROM (VALUES ('left'), ('right')) t(s)", "e1"))
def graph_difference(spark, d):
    g = graphs.user_next(spark, d)
    other = g.upsert_edge_property(g.edges.select("edge_id", F.when(F.col("w") % 7 == 0, F.col("w") + 1).otherwise(F.col("w")).alias("w")))
    return g.difference(other)


# ---------------------------------------------------------------- text forms


@query(_E)
def edge_list_round_trip(spark, d):
    path = scratch(spark, "edges")
    sinks.write_edge_list(graphs.user_next(spark, d), path, "w")
    return _edges(ingest.read_edge_list(spark, path, weighted=True))


@query(_E)
def dimacs_round_trip(spark, d):
    path = scratch(spark, "dimacs")
    sinks.write_dimacs(graphs.user_next(spark, d), path)
    return _edges(ingest.read_dimacs(spark, path))


@query(with_("SELECT src, dst, w::DOUBLE AS w FROM e1", "e1"))
def matrix_market_round_trip(spark, d):
    path = scratch(spark, "mtx")
    sinks.write_matrix_market(graphs.user_next(spark, d), path)
    return _edges(ingest.read_matrix_market(spark, path))


@query(_BARE)
def node_list_round_trip(spark, d):
    path = scratch(spark, "lists")
    sinks.write_adjacency(graphs.user_next(spark, d), path)
    return ingest.read_node_list(spark, path).edges.select("src", "dst")


@query(with_("SELECT a.k AS src, b.k AS dst, w::DOUBLE AS w FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id", "e2", n=nodes_of("e2"), r="SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n"))
def pbbs_round_trip(spark, d):
    path = scratch(spark, "pbbs")
    sinks.write_pbbs(transforms.remap(graphs.copart(spark, d, 2), graphs.copart(spark, d, 2).nodes), path, "w")
    return _edges(ingest.read_pbbs(spark, path))


@query(with_("SELECT a.k - 1 AS src, b.k - 1 + (SELECT count(*) FROM n) AS dst, w::DOUBLE AS w FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id", "e2", n=nodes_of("e2"), r="SELECT id, row_number() OVER (ORDER BY id) AS k FROM n"))
def svmlight_round_trip(spark, d):
    path = scratch(spark, "svm")
    g = graphs.copart(spark, d, 2)
    sinks.write_svmlight(transforms.remap(g, g.nodes), path)
    return _edges(ingest.read_svmlight(spark, path))


@query(with_("SELECT a.k AS a, b.k AS b FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id UNION SELECT b.k, a.k FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id", "e2", n=nodes_of("e2"), r="SELECT id, row_number() OVER (ORDER BY id) AS k FROM n"))
def metis_lines(spark, d):
    """Node and neighbour, numbered from 1, as the text form has them."""
    path = scratch(spark, "metis")
    g = graphs.copart(spark, d, 2)
    sinks.write_metis(transforms.remap(g, g.nodes), path)
    lines = cut(numbered(ingest.lines(spark, path), ["place"], "k"))
    return lines.where("k > 0").select(F.col("k").alias("a"), F.explode(F.filter(F.split("value", " "), lambda x: x != "").cast("array<bigint>")).alias("b"))


@query(with_("SELECT id, name, balance, array_to_string(types, ' & ') AS type FROM gn", "gn"))
def graphml_round_trip(spark, d):
    path = scratch(spark, "graphml")
    sinks.write_graphml(graphs.geography(spark, d), path)
    n = ingest.read_graphml(spark, path).nodes
    return n.select(F.col("key").cast("long").alias("id"), "name", "balance", type_name(F.col("types")).alias("type"))


@query(with_("SELECT id::VARCHAR || ' ' || ((SELECT count(*) FROM e1 WHERE src = id)::VARCHAR) AS line FROM n", "e1", n=nodes_of("e1")))
def value_lines(spark, d):
    path = scratch(spark, "values")
    sinks.write_values(graphs.user_next(spark, d).out_degree(), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(_E)
def csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    sinks.to_edge_frame(graphs.user_next(spark, d)).write.option("header", True).csv(path)
    return ingest.read_csv(spark, path, schema="source long, destination long, w long").edges.select("src", "dst", "w")


# ---------------------------------------------------------------- construction


@query(with_("SELECT edge_id, src, dst, w FROM (" + _NUMBERED + ")", "e1"))
def from_edge_frame(spark, d):
    e = graphs.user_next(spark, d).edges.orderBy("src", "dst").select(F.col("src").alias("source"), F.col("dst").alias("destination"), "w")
    return ingest.from_edge_frame(e).edges.select("edge_id", "src", "dst", "w")


@query(with_("SELECT id FROM range(0, (SELECT max(greatest(src, dst)) + 1 FROM e1)) t(id)", "e1"))
def from_edge_frame_nodes(spark, d):
    e = graphs.user_next(spark, d).edges.select(F.col("src").alias("source"), F.col("dst").alias("destination"))
    return ingest.from_edge_frame(e).nodes.select("id")


@query("SELECT * FROM (VALUES (0, 0, 1, 1), (1, 1, 2, 2), (2, 1, 2, 2), (3, 10, 0, 3)) t(edge_id, src, dst, p)")
def from_edge_arrays(spark, d):
    return ingest.from_edge_arrays(spark, [0, 1, 10, 1], [1, 2, 0, 2], {"p": [1, 2, 3, 2]}).edges.select("edge_id", "src", "dst", "p")


@query("SELECT * FROM (VALUES (0, 10, 0), (1, 0, 1)) t(edge_id, src, dst)")
def from_sorted_edge_arrays(spark, d):
    return ingest.from_edge_arrays(spark, [10, 0], [0, 1], keep_order=True).edges.select("edge_id", "src", "dst")


@query("SELECT * FROM (VALUES (0, 0, 1), (1, 1, 2), (2, 2, 0)) t(edge_id, src, dst)")
def from_edge_matrix(spark, d):
    return ingest.from_edge_matrix(spark, [[0, 1], [1, 2], [2, 0]]).edges.select("edge_id", "src", "dst")


@query("SELECT * FROM (VALUES (0, 1, 1.0::DOUBLE), (1, 2, 2.0), (2, 0, 3.0)) t(src, dst, weight)")
def from_adjacency_matrix(spark, d):
    return ingest.from_adjacency_matrix(spark, [[0, 1, 0], [0, 0, 2], [3, 0, 0]]).edges.select("src", "dst", "weight")


@query("SELECT * FROM (VALUES (0, 0, 2, 'A'), (1, 2, 0, 'A & B'), (2, 2, 1, '')) t(edge_id, src, dst, type)")
def from_csr(spark, d):
    g = ingest.from_csr_types(spark, [1, 1, 3], [2, 0, 1], [["N"], [], ["N", "M"]], [["A"], ["B", "A"], []])
    return g.edges.select("edge_id", "src", "dst", type_name(F.col("types")).alias("type"))


@query("SELECT c_custkey AS id, c_name AS name, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'debtor' END, CASE WHEN c_nationkey = 3 THEN 'local' END], lambda x: x IS NOT NULL), ' & ') AS type FROM customer")
def from_typed_frames(spark, d):
    c = graphs.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("debtor"), (F.col("c_nationkey") == 3).alias("local"))
    e = c.select(F.col("id").alias("source"), F.col("id").alias("destination"), F.lit(True).alias("SELF"))
    return ingest.from_typed_frames(c, e, ["debtor", "local"], ["SELF"]).nodes.select("id", "name", type_name(F.col("types")).alias("type"))


@query("SELECT n_name AS name, r_name AS region, n_nationkey::BIGINT AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def from_tables(spark, d):
    r, n = graphs.table(spark, d, "region"), graphs.table(spark, d, "nation")
    g = ingest.from_tables({"region": (r, "r_regionkey"), "nation": (n, "n_nationkey")}, [("nation", "n_regionkey", "region", "IN")])
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("n_nationkey")), g.nodes.select(F.col("id").alias("dst"), F.col("r_name").alias("region"))
    return g.edges.select("src", "dst").join(a, "src").join(b, "dst").select("name", "region", "n_nationkey")


@query("SELECT 'supplier:' || l_suppkey AS source, 'part:' || l_partkey AS target, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY ALL")
def from_relation_tables(spark, d):
    s, p = graphs.table(spark, d, "supplier"), graphs.table(spark, d, "part")
    link = graphs.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("quantity"))
    g = ingest.from_tables({"supplier": (s.select("s_suppkey", "s_name"), "s_suppkey"), "part": (p.select("p_partkey", "p_name"), "p_partkey")}, [], [(link, ("l_suppkey", "supplier"), ("l_partkey", "part"), "SENDS")])
    k = g.nodes.select("id", "key")
    return g.edges.join(k.withColumnsRenamed({"id": "src", "key": "source"}), "src").join(k.withColumnsRenamed({"id": "dst", "key": "target"}), "dst").select("source", "target", "quantity")


@query("SELECT n_name AS name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def from_documents(spark, d):
    c = graphs.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("_id"), F.concat(F.lit("n"), "c_nationkey").alias("nation"))
    n = graphs.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("_id"), F.col("n_name").alias("name"))
    g = ingest.from_documents({"customers": c, "nations": n}, [("customers", "nation", "LIVES_IN")])
    return g.nodes.where("name is not null").join(g.in_degree(), "id").select("name", F.col("in_degree").alias("customers"))


@query("SELECT 'grid' AS shape, 12 AS nodes, 58 AS edges UNION ALL SELECT 'wheel', 6, 20 UNION ALL SELECT 'sawtooth', 7, 18 UNION ALL SELECT 'clique', 5, 20 UNION ALL SELECT 'triangle', 10, 36")
def topology_sizes(spark, d):
    made = {"grid": topologies.grid(spark, 3, 4), "wheel": topologies.wheel(spark, 6), "sawtooth": topologies.sawtooth(spark, 3), "clique": topologies.clique(spark, 5), "triangle": topologies.triangle(spark, 3)}
    out = None
    for name, g in made.items():
        row = stats.summary(g).select(F.lit(name).alias("shape"), "nodes", "edges")
        out = row if out is None else out.unionAll(row)
    return out


# ---------------------------------------------------------------- properties and lookups


@query(with_("SELECT edge_id, w + 1 AS w FROM (" + _NUMBERED + ")", "e1"))
def upsert_edge_property(spark, d):
    g = graphs.user_next(spark, d)
    return g.upsert_edge_property(g.edges.select("edge_id", (F.col("w") + 1).alias("w"))).get_edge_property("w", "bigint")


@query(with_("SELECT edge_id, src, dst FROM (" + _NUMBERED + ")", "e1"))
def remove_edge_property(spark, d):
    return graphs.user_next(spark, d).remove_edge_property("w").edges.drop("types")


@query(with_("SELECT id, balance FROM gn", "gn"))
def get_node_property(spark, d):
    return graphs.geography(spark, d).get_node_property("balance", "double")


@query("SELECT 'nodes' AS part, 0 AS position, 'name' AS name, 'string' AS type UNION ALL SELECT 'nodes', 1, 'balance', 'double'")
def property_schema(spark, d):
    return graphs.geography(spark, d).schema_listing()


@query(with_("SELECT src, dst, 1 AS weight FROM ge", "ge"))
def default_weight(spark, d):
    return graphs.geography(spark, d).with_default_weight("weight").edges.select("src", "dst", "weight")


@query(with_("SELECT edge_id AS id, src AS source, dst AS dest, w FROM (" + _NUMBERED + ") WHERE dst >= 5 AND dst < 25", "e1"))
def in_edges(spark, d):
    return graphs.user_next(spark, d).in_edges(slice(5, 25))


@query(with_("SELECT src AS source, dst AS dest FROM ge WHERE list_contains(types, 'HAS_CUSTOMER')", "ge"))
def typed_out_edges(spark, d):
    return graphs.geography(spark, d).out_edges(types="HAS_CUSTOMER").select("source", "dest")


@query(with_("SELECT edge_id, src, dst FROM (" + _NUMBERED + ") WHERE edge_id % 11 = 3", "e1"))
def edges_by_id(spark, d):
    g = graphs.user_next(spark, d)
    return g.edges_by_id(g.edges.where("edge_id % 11 = 3").select("edge_id")).drop("types")


@query(with_("SELECT DISTINCT src AS source FROM m1 WHERE dst = 9", "m1"))
def in_neighbours(spark, d):
    return graphs.user_next_multi(spark, d).sources_of(9)


@query(with_("SELECT array_to_string(types, ' & ') AS type, len(types) AS atoms, count(*) AS rows FROM gn GROUP BY types", "gn"))
def type_sets(spark, d):
    return graphs.geography(spark, d).type_sets()


@query(with_("SELECT array_to_string(a.types, ' & ') AS sub, array_to_string(b.types, ' & ') AS sup FROM (SELECT DISTINCT types FROM gn) a, (SELECT DISTINCT types FROM gn) b WHERE list_has_all(b.types, a.types)", "gn"))
def subtypes(spark, d):
    return graphs.geography(spark, d).subtypes()


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN true END AS debtor FROM customer")
def sparsify_booleans(spark, d):
    c = graphs.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("debtor"))
    return PropertyGraph.of(c.select(F.col("id").alias("src"), F.col("id").alias("dst")), c).sparsify_booleans().nodes.select("id", "debtor")


@query("SELECT event_id AS id, floor(epoch(ts))::BIGINT AS seconds FROM events")
def convert_datetime(spark, d):
    n = graphs.table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    g = PropertyGraph.of(n.select(F.col("id").alias("src"), F.col("id").alias("dst")), n).convert_datetime(["at"])
    return g.nodes.select("id", F.unix_seconds("at").alias("seconds"))


@query(with_("SELECT src, dst, dst * 4 // (m + 1) AS part FROM e1, (SELECT max(id) AS m FROM n)", "e1", n=nodes_of("e1")))
def split_by_destination(spark, d):
    return transforms.split(graphs.user_next(spark, d), 4, "dst").select("src", "dst", "part")


@query(with_("SELECT count(*) AS edges, sum(w)::BIGINT AS weight, (SELECT count(*) FROM n) AS nodes FROM e1", "e1", n=nodes_of("e1")))
def shuffled_nodes(spark, d):
    g = transforms.shuffled(graphs.user_next(spark, d))
    n = g.nodes.select("id").distinct().where("id >= 0").agg(F.count("*").alias("nodes"))
    return g.edges.agg(F.count("*").alias("edges"), F.sum("w").alias("weight")).join(n)  # one row each


@query(with_("SELECT 5 AS sources, 0 AS without_edges", "e1"))
def source_picker(spark, d):
    g = graphs.user_next(spark, d)
    s = stats.source_nodes(g, 5)
    bad = s.join(g.edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.count("*").alias("without_edges"))
    return s.agg(F.count_distinct("id").alias("sources")).join(bad)  # one row each


# ---------------------------------------------------------------- validators


@query("SELECT * FROM (VALUES ('bfs', 0), ('sssp', 0), ('components', 0), ('bfs broken', 1)) t(what, violations)")
def validators(spark, d):
    g = graphs.user_next(spark, d)
    s = _first(g)
    reached = cut(traversal.bfs(g, s))
    far = reached.agg(F.max("level")).first()[0]
    one = reached.where(F.col("level") == far).agg(F.min("id")).first()[0]
    broken = reached.withColumn("parent", F.when(F.col("id") == one, F.col("id")).otherwise(F.col("parent")))
    rows = [
        ("bfs", traversal.bfs_violations(g, s, reached)),
        ("sssp", traversal.sssp_violations(g, s, cut(traversal.sssp(g, s)))),
        ("components", communities.component_violations(g, cut(communities.connected_components(g)))),
        ("bfs broken", traversal.bfs_violations(g, s, broken)),
    ]
    return spark.createDataFrame(rows, "what string, violations long")
