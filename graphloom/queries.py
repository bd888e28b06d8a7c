"""Registered queries of the graph engine, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graphs
from .functions.types import has_type, type_name
from .graph import PropertyGraph
from .operators import apps, centrality, communities, loops, peeling, stats, transforms, traversal, triangles
from .plans.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- SQL of the graphs

M1 = "SELECT src, dst, w FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, abs(floor(value * 100))::BIGINT + 1 AS w FROM events) WHERE dst IS NOT NULL"
E1 = f"SELECT src, dst, min(w) AS w FROM ({M1}) GROUP BY src, dst"
COPART = "SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS w FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2"
E2 = f"{COPART} HAVING count(*) >= 2"
GEO_N = """SELECT r_regionkey::BIGINT AS id, ['Place', 'Region'] AS types, r_name AS name, NULL::DOUBLE AS balance FROM region
UNION ALL SELECT n_nationkey::BIGINT + 1000, ['Nation', 'Place'], n_name, NULL FROM nation
UNION ALL SELECT c_custkey + 1000000000, CASE WHEN c_acctbal < 0 THEN ['Customer', 'Debtor'] ELSE ['Customer'] END, c_name, c_acctbal FROM customer
UNION ALL SELECT s_suppkey + 2000000000, ['Supplier'], s_name, s_acctbal FROM supplier"""
GEO_E = """SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + 1000 AS dst, ['HAS_NATION'] AS types FROM nation
UNION ALL SELECT c_nationkey::BIGINT + 1000, c_custkey + 1000000000, ['HAS_CUSTOMER', 'HAS_MEMBER'] FROM customer
UNION ALL SELECT s_nationkey::BIGINT + 1000, s_suppkey + 2000000000, ['HAS_MEMBER', 'HAS_SUPPLIER'] FROM supplier"""
BASE = {"m1": M1, "e1": E1, "e2": E2, "copart": COPART, "gn": GEO_N, "ge": GEO_E}


def nodes_of(e: str) -> str:
    return f"SELECT src AS id FROM {e} UNION SELECT dst FROM {e}"


def with_(text: str, *base: str, **more: str) -> str:
    """SQL with the named graphs as common table expressions; more: further ones, in order."""
    parts = [f"{b} AS MATERIALIZED ({BASE[b]})" for b in base] + [f"{k} AS MATERIALIZED ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {text}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- construction, properties, topology


@query(with_("SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, w FROM e1", "e1"))
def user_next_edges(spark, d):
    return graphs.user_next(spark, d).edges.select("edge_id", "src", "dst", "w")


@query(with_("SELECT src, dst, count(*) AS m, sum(w)::BIGINT AS w FROM m1 GROUP BY ALL", "m1"))
def multigraph_edges(spark, d):
    return graphs.user_next_multi(spark, d).edges.groupBy("src", "dst").agg(F.count("*").alias("m"), F.sum("w").alias("w"))


@query(with_("SELECT src, dst, w FROM copart", "copart"))
def copart_edges(spark, d):
    return graphs.copart(spark, d).edges.select("src", "dst", "w")


@query(with_("SELECT id, array_to_string(types, ' & ') AS type, name, balance FROM gn", "gn"))
def geography_nodes(spark, d):
    return graphs.geography(spark, d).nodes.select("id", type_name(F.col("types")).alias("type"), "name", "balance")


@query(with_("SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, array_to_string(types, ' & ') AS type FROM ge", "ge"))
def geography_edges(spark, d):
    return graphs.geography(spark, d).edges.select("edge_id", "src", "dst", type_name(F.col("types")).alias("type"))


@query(with_("SELECT id, name, balance, length(name) AS name_length FROM gn", "gn"))
def add_node_property(spark, d):
    g = graphs.geography(spark, d)
    return g.add_node_property(g.nodes.select("id", F.length("name").cast("long").alias("name_length"))).nodes.drop("types")


@query(with_("SELECT id, name, coalesce(balance, 0) + 1 AS balance FROM gn", "gn"))
def upsert_node_property(spark, d):
    g = graphs.geography(spark, d)
    return g.upsert_node_property(g.nodes.select("id", (F.coalesce("balance", F.lit(0.0)) + 1).alias("balance"))).nodes.select("id", "name", "balance")


@query(with_("SELECT id, name FROM gn", "gn"))
def remove_node_property(spark, d):
    return graphs.geography(spark, d).remove_node_property("balance").nodes.drop("types")


@query(with_("SELECT edge_id, src, dst, w, w * 2 AS twice FROM (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM e1)", "e1"))
def add_edge_property(spark, d):
    g = graphs.user_next(spark, d)
    return g.add_edge_property(g.edges.select("edge_id", (F.col("w") * 2).alias("twice"))).edges.drop("types")


@query(with_("SELECT id, balance FROM gn WHERE balance >= 0 AND balance < 1000", "gn"))
def index_range(spark, d):
    return graphs.geography(spark, d).node_range("balance", 0.0, 1000.0).select("id", "balance")


@query(with_("SELECT id, name FROM gn WHERE name = 'EUROPE' OR name = 'ASIA'", "gn"))
def index_lookup(spark, d):
    g = graphs.geography(spark, d)
    return g.find_nodes("name", "EUROPE").unionAll(g.find_nodes("name", "ASIA")).select("id", "name")


@query(with_("SELECT edge_id AS id, src AS source, dst AS dest, w FROM (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM e1) WHERE src >= 5 AND src < 25 AND (src - 5) % 2 = 0", "e1"))
def out_edges_slice(spark, d):
    return graphs.user_next(spark, d).out_edges(slice(5, 25, 2))


@query(with_("SELECT id, (SELECT count(*) FROM m1 WHERE src = id) AS out_degree, (SELECT count(*) FROM m1 WHERE dst = id) AS in_degree FROM n", "m1", n=nodes_of("m1")))
def degrees(spark, d):
    return stats.degrees(graphs.user_next_multi(spark, d))


@query(with_("SELECT n.id, coalesce(o.s, 0) AS out_degree, coalesce(i.s, 0) AS in_degree FROM n LEFT JOIN (SELECT src, sum(w)::BIGINT AS s FROM m1 GROUP BY 1) o ON n.id = o.src LEFT JOIN (SELECT dst, sum(w)::BIGINT AS s FROM m1 GROUP BY 1) i ON n.id = i.dst", "m1", n=nodes_of("m1")))
def weighted_degrees(spark, d):
    return stats.degrees(graphs.user_next_multi(spark, d), "w")


@query(with_("SELECT gn.id, count(ge.dst) AS out_degree FROM gn LEFT JOIN ge ON gn.id = ge.src AND list_contains(ge.types, 'HAS_CUSTOMER') GROUP BY gn.id", "gn", "ge"))
def typed_out_degree(spark, d):
    return graphs.geography(spark, d).out_degree("HAS_CUSTOMER")


@query(with_("SELECT p.a AS src, p.b AS dst, EXISTS (SELECT 1 FROM e1 WHERE src = a AND dst = b) AS present FROM (SELECT id AS a, id * k % 997 AS b FROM n, range(1, 40) t(k)) p", "e1", n=nodes_of("e1")))
def has_edges(spark, d):
    g = graphs.user_next(spark, d)
    # 39 pairs for each node, not all pairs of nodes.
    pairs = g.nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(39))).alias("k")).select("src", (F.col("src") * F.col("k") % 997).alias("dst"))
    return g.has_edges(pairs)


@query(with_("SELECT src, dst, w FROM m1 WHERE src = 7 AND dst = 11", "m1"))
def find_edges(spark, d):
    g = graphs.user_next_multi(spark, d)
    return g.find_edges(7, 11).select("src", "dst", "w")


@query(with_("SELECT dst AS src, src AS dst, w FROM e1", "e1"))
def transpose(spark, d):
    return graphs.user_next(spark, d).transpose().edges.select("src", "dst", "w")


@query(with_("SELECT src, dst, count(*) AS m FROM (SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1) GROUP BY ALL", "e1"))
def undirected_view(spark, d):
    return graphs.user_next(spark, d).undirected().groupBy("src", "dst").agg(F.count("*").alias("m"))


@query(with_("SELECT src, dst, count(*) AS m FROM (SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1 WHERE src <> dst) GROUP BY ALL", "e1"))
def symmetric_graph(spark, d):
    return graphs.user_next(spark, d).symmetric().edges.groupBy("src", "dst").agg(F.count("*").alias("m"))


@query(with_("SELECT edge_id, src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, edge_id) - 1 AS place FROM (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM e1)", "e1"))
def edges_by_destination(spark, d):
    return graphs.user_next(spark, d).edges_by_destination().select("edge_id", "src", "dst", "place")


_DEG = "SELECT n.id, count(e.src) AS d FROM n LEFT JOIN e2 e ON n.id = e.src GROUP BY n.id"


@query(with_("SELECT a.k AS src, b.k AS dst, w FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id", "e2", n=nodes_of("e2"), g=_DEG, r="SELECT id, row_number() OVER (ORDER BY d DESC, id DESC) - 1 AS k FROM g"))
def nodes_by_degree(spark, d):
    return graphs.copart(spark, d, 2).nodes_by_degree().edges.select("src", "dst", "w")


@query(with_("SELECT a.k AS src, b.k AS dst, w FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id", "e2", n=nodes_of("e2"), g=_DEG, r="SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS k FROM g"))
def nodes_by_ascending_degree(spark, d):
    return transforms.by_ascending_degree(graphs.copart(spark, d, 2)).edges.select("src", "dst", "w")


_PROJ = with_(
    "SELECT a.k AS src, b.k AS dst, array_to_string(ge.types, ' & ') AS type FROM ge JOIN r a ON ge.src = a.id JOIN r b ON ge.dst = b.id WHERE list_contains(ge.types, 'HAS_MEMBER')",
    "gn", "ge", r="SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM gn WHERE list_contains(types, 'Debtor') OR list_contains(types, 'Nation')",
)


@query(_PROJ)
def project_types(spark, d):
    return graphs.geography(spark, d).project(["Debtor", "Nation"], ["HAS_MEMBER"]).edges.select("src", "dst", type_name(F.col("types")).alias("type"))


@query(with_("SELECT array_to_string(types, ' & ') AS type, count(*) AS nodes, bool_and(list_contains(types, 'Place')) AS place FROM gn GROUP BY types", "gn"))
def type_census(spark, d):
    n = graphs.geography(spark, d).nodes
    return n.groupBy(type_name(F.col("types")).alias("type")).agg(F.count("*").alias("nodes"), F.bool_and(has_type(F.col("types"), "Place")).alias("place"))


_IDS = [11, 3, 3, 40, 25, 7, 90, 12, 61, 33, 5]


@query(with_("SELECT a.k AS src, b.k AS dst, count(*) AS m FROM m1 JOIN l a ON m1.src = a.id JOIN l b ON m1.dst = b.id GROUP BY ALL", "m1", l="SELECT id, row_number() OVER (ORDER BY k) - 1 AS k FROM (SELECT id, min(k) AS k FROM (SELECT unnest([" + ", ".join(map(str, _IDS)) + "]) AS id, generate_subscripts([" + ", ".join(map(str, _IDS)) + "], 1) AS k) GROUP BY id)"))
def subgraph_extraction(spark, d):
    return graphs.user_next_multi(spark, d).subgraph(_IDS).edges.groupBy("src", "dst").agg(F.count("*").alias("m"))


# ---------------------------------------------------------------- rewrites


@query(with_("SELECT src, dst, min(w) AS w FROM m1 WHERE src <> dst GROUP BY src, dst", "m1"))
def clean_graph(spark, d):
    # Edge ids follow (src, dst, w), so the edge of least id has the least weight.
    return transforms.clean(graphs.user_next_multi(spark, d)).edges.select("src", "dst", "w")


@query(with_("SELECT src, dst, w FROM e1 WHERE src <= dst", "e1"))
def triangular_graph(spark, d):
    return transforms.triangular(graphs.user_next(spark, d)).edges.select("src", "dst", "w")


@query(with_("SELECT src, dst, 1 + (src * 2654435761 + dst * 40503 + 1) % 1000003 * 7919 % 1000003 % 100 AS w FROM e1", "e1"))
def hash_weights(spark, d):
    return transforms.hash_weights(graphs.user_next(spark, d), 1, 100).edges.select("src", "dst", "w")


@query(with_("SELECT a.k AS src, b.k AS dst FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id", "e2", n=nodes_of("e2"), g=_DEG, r="SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM g WHERE d <= 2"))
def low_degree_graph(spark, d):
    return transforms.low_degree(graphs.copart(spark, d, 2), 2).edges.select("src", "dst")


@query(with_("SELECT a.k AS src, b.k AS dst, w FROM e2 JOIN r a ON e2.src = a.id JOIN r b ON e2.dst = b.id", "e2", n=nodes_of("e2"), r="SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n WHERE id % 3 <> 0"))
def remap_nodes(spark, d):
    g = graphs.copart(spark, d, 2)
    return transforms.remap(g, g.nodes.where("id % 3 <> 0").select("id")).edges.select("src", "dst", "w")


for _shape, _extra in (("ring", "SELECT i AS src, (i + 1) % k AS dst FROM c, range(0, c.k) t(i)"), ("line", "SELECT i, i + 1 FROM c, range(0, c.k - 1) t(i)"), ("tree", "SELECT (i - 1) // 2, i FROM c, range(1, c.k) t(i)")):

    def _overlay(spark, d, shape=_shape):
        return transforms.overlay(graphs.user_next(spark, d), shape, 1000)

    QUERIES[f"overlay_{_shape}"] = _overlay
    SQL[f"overlay_{_shape}"] = with_(f"SELECT src, dst, w FROM e1 UNION ALL SELECT x.*, 1000 FROM ({_extra}) x", "e1", n=nodes_of("e1"), c="SELECT count(*) AS k FROM n")


@query(with_("SELECT src, dst, src * 4 // (m + 1) AS part FROM e1, (SELECT max(id) AS m FROM n)", "e1", n=nodes_of("e1")))
def split_by_source(spark, d):
    return transforms.split(graphs.user_next(spark, d), 4).select("src", "dst", "part")


@query(with_("SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w, dst) - 1 AS place FROM e1", "e1"))
def edges_by_weight(spark, d):
    return transforms.sort_by_weight(graphs.user_next(spark, d)).select("src", "dst", "w", "place")


# ---------------------------------------------------------------- statistics


@query(with_("SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, count(*) FILTER (src = dst) AS loops FROM m1", "m1", n=nodes_of("m1")))
def graph_summary(spark, d):
    return stats.summary(graphs.user_next_multi(spark, d))


@query(with_("SELECT id, d AS out_degree FROM g ORDER BY d DESC, id LIMIT 1", "e2", n=nodes_of("e2"), g=_DEG))
def max_degree_node(spark, d):
    return stats.max_degree_node(graphs.copart(spark, d, 2))


@query(with_("SELECT d AS value, count(*) AS nodes FROM g GROUP BY d", "e2", n=nodes_of("e2"), g=_DEG))
def degree_histogram(spark, d):
    return stats.histogram(graphs.copart(spark, d, 2).out_degree(), "out_degree")


@query(with_("SELECT d // (SELECT ceil((max(d) + 1) / 5.0)::BIGINT FROM g) AS value, count(*) AS nodes FROM g GROUP BY 1", "m1", n=nodes_of("m1"), g="SELECT n.id, count(e.dst) AS d FROM n LEFT JOIN m1 e ON n.id = e.dst GROUP BY n.id"))
def in_degree_histogram_binned(spark, d):
    return stats.histogram(graphs.user_next_multi(spark, d).in_degree(), "in_degree", 5)


@query(with_("SELECT DISTINCT src // k AS row, dst // k AS col FROM e2, (SELECT ceil((max(id) + 1) / 8.0)::BIGINT AS k FROM n)", "e2", n=nodes_of("e2")))
def sparsity_pattern(spark, d):
    return stats.sparsity(graphs.copart(spark, d, 2), 8)


_AB = "SELECT n.id, (SELECT count(*) FROM e2 WHERE src = n.id) AS o, (SELECT count(*) FROM e2 WHERE dst = n.id) AS i FROM n"


@query(with_("SELECT round(corr(a.o, b.i), 8) AS assortativity FROM e2 JOIN x a ON e2.src = a.id JOIN x b ON e2.dst = b.id", "e2", n=nodes_of("e2"), x=_AB))
def degree_assortativity(spark, d):
    return stats.assortativity(graphs.copart(spark, d, 2)).select(F.round("assortativity", 8).alias("assortativity"))


@query(with_("SELECT coalesce(count(*) >= 10 AND avg(d) >= 10 AND avg(d) FILTER (d > 0) / 1.3 > quantile_cont(d, 0.5) FILTER (d > 0), false) AS power_law FROM g", "e1", n=nodes_of("e1"), g="SELECT n.id, count(e.src) AS d FROM n LEFT JOIN e1 e ON n.id = e.src GROUP BY n.id"))
def power_law(spark, d):
    return stats.power_law(graphs.user_next(spark, d))


# ---------------------------------------------------------------- analytics

_HOPS = 24
_BFS = {"b0": "SELECT min(src) AS id, 0 AS level, min(src) AS parent FROM e2"}
for _i in range(1, _HOPS):
    _BFS[f"b{_i}"] = f"SELECT * FROM b{_i - 1} UNION ALL SELECT u.b, {_i}, min(u.a) FROM u JOIN b{_i - 1} f ON u.a = f.id AND f.level = {_i - 1} WHERE u.b NOT IN (SELECT id FROM b{_i - 1}) GROUP BY u.b"
_U2 = "SELECT src AS a, dst AS b FROM e2 UNION ALL SELECT dst, src FROM e2"
_BFS_SQL = {"u": _U2, **_BFS}


def _both_ways(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(g.nodes, g.undirected("w").withColumn("types", F.array().cast("array<string>")).withColumn("edge_id", F.monotonically_increasing_id()))


def _first(g: PropertyGraph) -> int:
    return g.edges.agg(F.min("src")).first()[0]


@query(with_(f"SELECT id, level::BIGINT AS level, parent FROM b{_HOPS - 1}", "e2", **_BFS_SQL))
def bfs(spark, d):
    g = _both_ways(graphs.copart(spark, d, 2))
    return traversal.bfs(g, _first(g))


@query(with_(f"SELECT count(*) AS n_reached_nodes FROM b{_HOPS - 1}", "e2", **_BFS_SQL))
def bfs_statistics(spark, d):
    g = _both_ways(graphs.copart(spark, d, 2))
    return traversal.bfs_statistics(traversal.bfs(g, _first(g)))


_SP = {"s0": "SELECT min(src) AS id, 0::BIGINT AS dist FROM e1"}
for _i in range(1, 14):
    _SP[f"s{_i}"] = f"SELECT id, min(dist) AS dist FROM (SELECT * FROM s{_i - 1} UNION ALL SELECT e1.dst, s.dist + e1.w FROM e1 JOIN s{_i - 1} s ON e1.src = s.id) GROUP BY id"


@query(with_("SELECT id, dist FROM s13", "e1", **_SP))
def sssp(spark, d):
    g = graphs.user_next(spark, d)
    return traversal.sssp(g, _first(g))


@query(with_("SELECT count(*) AS n_reached_nodes, max(dist) AS max_distance, round(avg(dist), 6) AS average_visited_distance FROM s13", "e1", **_SP))
def sssp_statistics(spark, d):
    g = graphs.user_next(spark, d)
    return traversal.sssp_statistics(traversal.sssp(g, _first(g))).withColumn("average_visited_distance", F.round("average_visited_distance", 6))


_CC = with_("SELECT n.id, min(r.b) AS component FROM n JOIN r ON n.id = r.a GROUP BY n.id", "e2", n=nodes_of("e2")).replace("WITH ", "WITH RECURSIVE ", 1)
_CC = _CC.replace(" SELECT n.id, min(r.b)", f", u AS ({_U2}), r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT n.id, min(r.b)", 1)


@query(_CC)
def connected_components(spark, d):
    return communities.connected_components(graphs.copart(spark, d, 2))


_GROUPS = "SELECT count(*) AS total, count(*) FILTER (n > 1) AS non_trivial, max(n) AS largest, round(max(n) / sum(n), 9) AS largest_ratio FROM (SELECT count(*) AS n FROM ({}) GROUP BY {})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("largest_ratio", F.round("largest_ratio", 9))


@query(_GROUPS.format(_CC, "component"))
def connected_components_statistics(spark, d):
    return _rounded(communities.group_statistics(communities.connected_components(graphs.copart(spark, d, 2)), "component"))


_PR = {"n": nodes_of("m1"), "o": "SELECT src, count(*) AS d FROM m1 GROUP BY src", "p0": "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n"}
for _i in range(1, 11):
    _PR[f"p{_i}"] = f"SELECT n.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s, 0) AS r FROM n LEFT JOIN (SELECT m1.dst AS id, sum(p.r / o.d) AS s FROM m1 JOIN p{_i - 1} p ON m1.src = p.id JOIN o ON m1.src = o.src GROUP BY m1.dst) x ON n.id = x.id"


@query(with_("SELECT id, round(r, 6) AS rank FROM p10", "m1", **_PR))
def pagerank_fixed(spark, d):
    r = centrality.pagerank(graphs.user_next_multi(spark, d), tolerance=None, max_iterations=10)
    return r.select("id", F.round("rank", 6).alias("rank"))


@query(with_("SELECT round(max(r), 6) AS max_rank, round(min(r), 6) AS min_rank, round(avg(r), 6) AS average_rank FROM p10", "m1", **_PR))
def pagerank_statistics(spark, d):
    s = centrality.pagerank_statistics(centrality.pagerank(graphs.user_next_multi(spark, d), tolerance=None, max_iterations=10))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


_PT = {"n": nodes_of("e1"), "o": "SELECT src, count(*) AS d FROM e1 GROUP BY src", "t0": "SELECT id, 1.0::DOUBLE AS r FROM n"}
for _i in range(1, 41):
    _PT[f"t{_i}"] = f"SELECT n.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s, 0) AS r FROM n LEFT JOIN (SELECT e1.dst AS id, sum(p.r / o.d) AS s FROM e1 JOIN t{_i - 1} p ON e1.src = p.id JOIN o ON e1.src = o.src GROUP BY e1.dst) x ON n.id = x.id"
_PT["moved"] = " UNION ALL ".join(f"SELECT {i} AS k, sum(abs(a.r - b.r)) AS c FROM t{i} a JOIN t{i - 5} b ON a.id = b.id" for i in range(5, 41, 5))
_PT["ends"] = "SELECT coalesce(min(k) FILTER (c <= 1e-4), 40) AS k FROM moved"
_PT["every"] = " UNION ALL ".join(f"SELECT {i} AS k, id, r FROM t{i}" for i in range(5, 41, 5))


@query(with_("SELECT id, round(r, 6) AS rank FROM every WHERE k = (SELECT k FROM ends)", "e1", **_PT))
def pagerank(spark, d):
    r = centrality.pagerank(graphs.user_next(spark, d), tolerance=1e-4)
    return r.select("id", F.round("rank", 6).alias("rank"))


_DEPTH = 5
_BC = {"n": nodes_of("m1"), "e": "SELECT src, dst, count(*)::DOUBLE AS m FROM m1 GROUP BY src, dst", "f0": "SELECT id AS s, id AS v, 0 AS l, 1.0::DOUBLE AS sg FROM (SELECT id FROM n ORDER BY id LIMIT 4)"}
for _i in range(1, _DEPTH):
    _BC[f"f{_i}"] = f"SELECT * FROM f{_i - 1} UNION ALL SELECT f.s, e.dst, {_i}, sum(f.sg * e.m) FROM f{_i - 1} f JOIN e ON e.src = f.v AND f.l = {_i - 1} LEFT JOIN f{_i - 1} x ON x.s = f.s AND x.v = e.dst WHERE x.v IS NULL GROUP BY f.s, e.dst"
_BC[f"g{_DEPTH}"] = "SELECT 0::BIGINT AS s, 0::BIGINT AS v, 0.0::DOUBLE AS delta WHERE false"
for _i in range(_DEPTH - 1, 0, -1):
    _BC[f"g{_i}"] = f"SELECT a.s, a.v, sum(a.sg * e.m / b.sg * (1 + coalesce(g.delta, 0))) AS delta FROM f{_DEPTH - 1} a JOIN e ON e.src = a.v AND a.l = {_i - 1} JOIN f{_DEPTH - 1} b ON b.s = a.s AND b.v = e.dst AND b.l = {_i} LEFT JOIN g{_i + 1} g ON g.s = b.s AND g.v = b.v GROUP BY a.s, a.v"
_BC["all_"] = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(1, _DEPTH))


@query(with_("SELECT n.id, round(coalesce(sum(a.delta), 0), 6) AS score FROM n LEFT JOIN all_ a ON n.id = a.v AND a.s <> a.v GROUP BY n.id", "m1", **_BC))
def betweenness(spark, d):
    g = graphs.user_next_multi(spark, d)
    s = centrality.betweenness(g, g.nodes.select("id").orderBy("id").limit(4))  # four sources are the argument
    return s.select("id", F.round("score", 6).alias("score"))


_BC_SQL = "SELECT n.id, round(coalesce(sum(a.delta), 0), 6) AS score FROM n LEFT JOIN all_ a ON n.id = a.v AND a.s <> a.v GROUP BY n.id"


@query(with_(f"SELECT round(max(score), 4) AS max_centrality, round(min(score), 4) AS min_centrality, round(avg(score), 4) AS average_centrality FROM ({_BC_SQL})", "m1", **_BC))
def betweenness_statistics(spark, d):
    g = graphs.user_next_multi(spark, d)
    s = centrality.betweenness_statistics(centrality.betweenness(g, g.nodes.select("id").orderBy("id").limit(4)))
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns])


_LP = {"u": _U2, "n": nodes_of("e2"), "l0": "SELECT id, id AS l FROM n"}
for _i in range(1, 11):
    _LP[f"l{_i}"] = f"SELECT id, l FROM (SELECT u.a AS id, x.l, row_number() OVER (PARTITION BY u.a ORDER BY count(*) DESC, x.l) AS k FROM u JOIN l{_i - 1} x ON u.b = x.id GROUP BY u.a, x.l) WHERE k = 1"


@query(with_("SELECT id, l AS community FROM l10", "e2", **_LP))
def cdlp(spark, d):
    return communities.cdlp(graphs.copart(spark, d, 2))


@query(_GROUPS.format(with_("SELECT id, l AS community FROM l10", "e2", **_LP), "community"))
def cdlp_statistics(spark, d):
    return _rounded(communities.group_statistics(communities.cdlp(graphs.copart(spark, d, 2)), "community"))


def _mis(rank: str) -> str:
    parts = {"n": nodes_of("e2"), "u": f"SELECT a, b, {rank.format('a')} AS ra, {rank.format('b')} AS rb FROM ({_U2}) WHERE a <> b", "o0": "SELECT id FROM n WHERE id NOT IN (SELECT src FROM e2 WHERE src = dst)"}
    for i in range(1, 17):
        parts[f"x{i}"] = f"SELECT id FROM o{i - 1} o WHERE NOT EXISTS (SELECT 1 FROM u JOIN o{i - 1} p ON u.b = p.id WHERE u.a = o.id AND (u.rb < u.ra OR (u.rb = u.ra AND u.b < u.a)))"
        parts[f"o{i}"] = f"SELECT id FROM o{i - 1} WHERE id NOT IN (SELECT id FROM x{i}) AND id NOT IN (SELECT u.b FROM u JOIN x{i} x ON u.a = x.id)"
    parts["m"] = " UNION ALL ".join(f"SELECT id FROM x{i}" for i in range(1, 17))
    return with_("SELECT id, id IN (SELECT id FROM m) AS member FROM n", "e2", **parts)


_HASH = "(({} % 2147483648) * 2654435761 % 4294967296)"


@query(_mis("{}"))
def independent_set(spark, d):
    return peeling.independent_set(graphs.copart(spark, d, 2))


@query(_mis(_HASH))
def independent_set_priority(spark, d):
    return peeling.independent_set(graphs.copart(spark, d, 2), order="hash")


@query(f"SELECT count(*) FILTER (member) AS cardinality, 0 AS violations FROM ({_mis('{}')})")
def independent_set_statistics(spark, d):
    g = graphs.copart(spark, d, 2)
    m = cut(peeling.independent_set(g))
    return m.agg(F.count_if("member").alias("cardinality")).withColumn("violations", F.lit(peeling.independent_set_violations(g, m)))


_JAC = {"n": nodes_of("m1"), "b": "SELECT DISTINCT dst FROM m1 WHERE src = (SELECT min(src) FROM m1)", "j": "SELECT n.id, count(m1.dst) AS d, count(b.dst) AS i, (SELECT count(*) FROM b) AS k FROM n LEFT JOIN m1 ON n.id = m1.src LEFT JOIN b ON m1.dst = b.dst GROUP BY n.id"}
_SIM = "CASE WHEN d + k - i = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / (d + k - i) END"


@query(with_(f"SELECT id, round({_SIM}, 9) AS similarity FROM j", "m1", **_JAC))
def jaccard(spark, d):
    g = graphs.user_next_multi(spark, d)
    return triangles.jaccard(g, _first(g)).select("id", F.round("similarity", 9).alias("similarity"))


@query(with_(f"SELECT round(max({_SIM}), 6) AS max_similarity, round(min({_SIM}), 6) AS min_similarity, round(avg({_SIM}), 6) AS average_similarity FROM j WHERE id <> (SELECT min(src) FROM m1)", "m1", **_JAC))
def jaccard_statistics(spark, d):
    g = graphs.user_next_multi(spark, d)
    s = triangles.jaccard_statistics(triangles.jaccard(g, _first(g)), _first(g))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


_CORE = {"u": _U2, "n": nodes_of("e2"), "c0": "SELECT id FROM n"}
for _i in range(1, 25):
    _CORE[f"c{_i}"] = f"SELECT u.a AS id FROM u JOIN c{_i - 1} x ON u.a = x.id JOIN c{_i - 1} y ON u.b = y.id GROUP BY u.a HAVING count(*) >= 3"


@query(with_("SELECT id, id IN (SELECT id FROM c24) AS alive FROM n", "e2", **_CORE))
def k_core(spark, d):
    return peeling.k_core(graphs.copart(spark, d, 2), 3)


@query(with_("SELECT count(*) AS number_of_nodes_in_kcore FROM c24", "e2", **_CORE))
def k_core_statistics(spark, d):
    return peeling.k_core(graphs.copart(spark, d, 2), 3).agg(F.count_if("alive").alias("number_of_nodes_in_kcore"))


_SIMPLE = "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e1 WHERE src <> dst"
_TRUSS = {"t0": _SIMPLE}
for _i in range(1, 13):
    _u = f"(SELECT a, b FROM t{_i - 1} UNION ALL SELECT b, a FROM t{_i - 1})"
    _TRUSS[f"t{_i}"] = f"SELECT e.a, e.b FROM t{_i - 1} e JOIN {_u} x ON e.a = x.a JOIN {_u} y ON e.b = y.a AND x.b = y.b GROUP BY e.a, e.b HAVING count(*) >= 28"


@query(with_("SELECT a AS src, b AS dst FROM t12", "e1", **_TRUSS))
def k_truss(spark, d):
    return peeling.k_truss(graphs.user_next(spark, d), 30)


@query(with_("SELECT count(*) AS number_of_edges_left FROM t12", "e1", **_TRUSS))
def k_truss_statistics(spark, d):
    return peeling.k_truss(graphs.user_next(spark, d), 30).agg(F.count("*").alias("number_of_edges_left"))


@query(with_("SELECT count(*) AS triangles FROM copart x JOIN copart y ON x.dst = y.src JOIN copart z ON z.src = x.src AND z.dst = y.dst", "copart"))
def triangle_count(spark, d):
    return triangles.triangle_count(graphs.copart(spark, d))


_TRI = {"t": "SELECT x.src AS a, x.dst AS b, y.dst AS c FROM copart x JOIN copart y ON x.dst = y.src JOIN copart z ON z.src = x.src AND z.dst = y.dst", "k": "SELECT id, count(*) AS t FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id", "g": "SELECT id, count(*) AS d FROM (SELECT src AS id FROM copart UNION ALL SELECT dst FROM copart) GROUP BY id"}


@query(with_("SELECT g.id, round(CASE WHEN d < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) END, 9) AS coefficient FROM g LEFT JOIN k ON g.id = k.id", "copart", **_TRI))
def local_clustering(spark, d):
    return triangles.local_clustering(graphs.copart(spark, d)).select("id", F.round("coefficient", 9).alias("coefficient"))


_MOD = with_(
    "SELECT round((sum(i) - sum(k * k) / sum(k)) / sum(k), 6) AS modularity FROM (SELECT x.l AS c, sum(w)::DOUBLE AS k, (sum(w) FILTER (x.l = y.l))::DOUBLE AS i FROM (SELECT src AS a, dst AS b, w FROM e2 UNION ALL SELECT dst, src, w FROM e2) u JOIN l10 x ON u.a = x.id JOIN l10 y ON u.b = y.id GROUP BY x.l)",
    "e2", **_LP,
)


@query(_MOD.replace("sum(i)", "sum(coalesce(i, 0))"))
def modularity(spark, d):
    g = graphs.copart(spark, d, 2)
    return communities.modularity(communities._undirected(g, "w"), communities.cdlp(g), "community").select(F.round("modularity", 6).alias("modularity"))


_TURN = "((({0} % 2147483648) * 2654435761 % 4294967296) // 2147483648)"
_LV = {
    "n": nodes_of("e2"), "u": "SELECT src AS a, dst AS b, w::DOUBLE AS w FROM e2 UNION ALL SELECT dst, src, w FROM e2",
    "dg": "SELECT a AS id, sum(w) AS d FROM u GROUP BY a", "tm": "SELECT sum(w) AS t FROM u", "c0": "SELECT n.id, n.id AS c, coalesce(d, 0) AS d FROM n LEFT JOIN dg ON n.id = dg.id",
}
for _i in (1, 2):
    _p = f"c{_i - 1}"
    _LV[f"k{_i}"] = f"SELECT c, sum(d) AS total, count(*) AS members FROM {_p} GROUP BY c"
    _LV[f"near{_i}"] = f"SELECT u.a AS id, x.c, sum(u.w) AS weight FROM u JOIN {_p} x ON u.b = x.id WHERE u.a <> u.b AND {_TURN.format('u.a')} = {_i - 1} GROUP BY 1, 2"
    _LV[f"off{_i}"] = f"SELECT r.id, r.c, floor((r.weight - coalesce(o.weight, 0) - s.d * (kc.total - (ko.total - s.d)) / (SELECT t FROM tm)) * 1048576 + 0.5)::BIGINT AS gain FROM near{_i} r JOIN {_p} s ON r.id = s.id LEFT JOIN near{_i} o ON o.id = r.id AND o.c = s.c JOIN k{_i} kc ON kc.c = r.c JOIN k{_i} ko ON ko.c = s.c WHERE r.c <> s.c AND (ko.members > 1 OR kc.members > 1 OR r.c < s.c)"
    _LV[f"best{_i}"] = f"SELECT id, c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, c) AS k FROM off{_i} WHERE gain > 0) WHERE k = 1"
    _LV[f"c{_i}"] = f"SELECT s.id, coalesce(b.c, s.c) AS c, s.d FROM {_p} s LEFT JOIN best{_i} b ON s.id = b.id"


@query(with_("SELECT id, min(id) OVER (PARTITION BY c) AS cluster FROM c2", "e2", **_LV))
def louvain_two_turns(spark, d):
    """The first two rounds of moves, by the DataFrame rounds that large levels take."""
    g = graphs.copart(spark, d, 2)
    edges = cut(communities._undirected(g, "w"))
    total = edges.agg(F.sum("w")).first()[0]
    moved, _ = communities._move_phase(edges, g.nodes.select("id", F.col("id").alias("cluster")), total, 1e-4, 2, 1.0)
    least = F.min("id").over(Window.partitionBy("cluster"))
    return moved.select("id", least.alias("cluster"))


def _clustering_row(run):
    def f(spark, d):
        g = graphs.copart(spark, d, 2)
        labels = cut(run(g))
        s = communities.clustering_statistics(g, labels)
        base = communities.modularity(communities._undirected(g, "w"), communities.cdlp(g), "community").first()[0]
        ok = s.select((F.col("modularity") > base).alias("above_label_propagation"), (F.col("largest") > 1).alias("merged"))
        return ok.join(communities.clustering_violations(g, labels))  # one row each

    return f


QUERIES["louvain"] = lambda spark, d: communities.louvain(graphs.copart(spark, d, 2))
QUERIES["leiden"] = lambda spark, d: communities.leiden(graphs.copart(spark, d, 2))
QUERIES["louvain_holds"] = _clustering_row(communities.louvain)
QUERIES["leiden_holds"] = _clustering_row(communities.leiden)
# Labels are checked for what any right clustering has: each node in one cluster, named by its least member, and a modularity above label propagation's.
SQL["leiden_holds"] = "SELECT true AS above_label_propagation, true AS merged, 0 AS missing, 0 AS misnamed, 0 AS split"
SQL["louvain_holds"] = SQL["leiden_holds"]


@query()
def louvain_statistics(spark, d):
    g = graphs.copart(spark, d, 2)
    return communities.clustering_statistics(g, cut(communities.louvain(g)))


@query()
def leiden_statistics(spark, d):
    g = graphs.copart(spark, d, 2)
    return communities.clustering_statistics(g, cut(communities.leiden(g)))


# ---------------------------------------------------------------- applications


_KS = {"cs": "SELECT o_custkey AS a, -l_suppkey - 1 AS b, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) >= 2"}


@query()
def spanning_forest(spark, d):
    return apps.spanning_forest(graphs.customer_supplier(spark, d, 2))


# Kruskal by weights: a weight w comes into the forest as often as edges up to w join components that lighter ones don't.
_MSF = with_(
    "SELECT sum(k)::BIGINT AS edges, sum(k * w)::BIGINT AS weight FROM (SELECT w, lag(c, 1, (SELECT count(*) FROM n)) OVER (ORDER BY w) - c AS k FROM (SELECT t AS w, count(DISTINCT least) AS c FROM (SELECT t, a, min(b) AS least FROM r GROUP BY t, a) GROUP BY t))",
    **{**_KS, "n": "SELECT a AS id FROM cs UNION SELECT b FROM cs", "ws": "SELECT DISTINCT w AS t FROM cs", "u": "SELECT a, b, w FROM cs UNION ALL SELECT b, a, w FROM cs"},
).replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT sum(k)", ", r AS (SELECT t, id AS a, id AS b FROM n, ws UNION SELECT r.t, r.a, u.b FROM r JOIN u ON r.b = u.a AND u.w <= r.t) SELECT sum(k)", 1)


@query(_MSF)
def spanning_forest_weight(spark, d):
    f = apps.spanning_forest(graphs.customer_supplier(spark, d, 2))
    return f.agg(F.count("*").alias("edges"), F.sum("w").alias("weight"))


@query(with_("SELECT (SELECT count(*) FROM n) AS walks, 0 AS off_the_graph, 0 AS gaps", "e2", n=nodes_of("e2")))
def random_walks(spark, d):
    """One walk from each node that has edges; every step is an edge, either way, and steps follow each other."""
    g = graphs.copart(spark, d, 2)
    w = cut(apps.random_walks(g, length=5, p=0.5, q=2.0, symmetric=False)).select("walk", "step", "node")
    hops = w.join(w.select("walk", (F.col("step") + 1).alias("step"), F.col("node").alias("before")), ["walk", "step"], "left")
    edges = g.undirected().select(F.col("src").alias("before"), F.col("dst").alias("node")).distinct().withColumn("there", F.lit(1))
    found = hops.join(edges, ["before", "node"], "left").where("step > 0")
    bad = found.agg(F.count_if(F.col("there").isNull() & F.col("before").isNotNull()).alias("off_the_graph"), F.count_if(F.col("before").isNull()).alias("gaps"))
    return w.agg(F.count_distinct("walk").alias("walks")).join(bad)  # one row each


@query()
def edge_type_walks(spark, d):
    walks, _ = apps.edge_type_walks(graphs.geography(spark, d), length=4, rounds=2)
    return walks.select("walk", "step", "node")


@query()
def bipartite_matching(spark, d):
    """Orders' customers and suppliers that sent them two lines or more, matched one to one."""
    e = graphs.customer_supplier(spark, d, 2).edges.select(F.col("src").alias("left"), F.col("dst").alias("right"))
    return apps.bipartite_matching(e)


# Flow from node -1 over each supplier (as many as it has parts) and each part's size to node -2: the suppliers' ends bound it.
@query("SELECT sum(least(a, b))::BIGINT AS flow FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS a, sum(l_linenumber) // 10 AS b FROM lineitem GROUP BY l_suppkey)")
def max_flow(spark, d):
    s = graphs.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("a"), F.floor(F.sum("l_linenumber") / 10).alias("b"))
    e = s.select(F.lit(-1).cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"), F.col("a").alias("w")).unionAll(s.select(F.col("l_suppkey").cast("long"), F.lit(-2).cast("long"), "b"))
    return apps.max_flow(PropertyGraph.of(cut(e)), -1, -2)


_KSP = {"q0": "SELECT min(src) AS v, 0::BIGINT AS weight, [min(src)] AS path FROM e2", "goal": "SELECT max(b) AS t FROM (SELECT e2.dst AS b FROM e2 WHERE src = (SELECT min(src) FROM e2) UNION SELECT y.dst FROM e2 x JOIN e2 y ON x.dst = y.src WHERE x.src = (SELECT min(src) FROM e2))"}
for _i in range(1, 25):
    _KSP[f"q{_i}"] = f"SELECT v, weight, path FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY weight, path) AS k FROM (SELECT * FROM q{_i - 1} UNION SELECT e2.dst, q.weight + e2.w, list_append(q.path, e2.dst) FROM q{_i - 1} q JOIN e2 ON q.v = e2.src)) WHERE k <= 3"


@query(with_("SELECT row_number() OVER (ORDER BY weight, path) AS rank, weight, array_to_string(path, ',') AS path FROM q24 WHERE v = (SELECT t FROM goal)", "e2", **_KSP))
def k_shortest_paths(spark, d):
    """The three lightest walks along the edges from the first part to the last within two steps of it."""
    g = graphs.copart(spark, d, 2)
    s = _first(g)
    one = g.edges.where(F.col("src") == s).select("dst")
    two = g.edges.join(one.select(F.col("dst").alias("src")), "src", "left_semi").select("dst")
    return traversal.k_shortest_paths(g, s, one.unionAll(two).agg(F.max("dst")).first()[0], 3, symmetric=True)


@query("SELECT 'least_squares' AS method, true AS better_than_mean UNION ALL SELECT 'gradient', true")
def matrix_completion(spark, d):
    """Whether factors by alternating least squares and by gradient descent explain a rank-one table of parts and suppliers better than its mean."""
    li = graphs.table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    rating = (F.col("l_suppkey") % 9 + 1) * (F.col("l_partkey") % 7 + 1) / 63.0
    r = cut(li.select(F.col("l_suppkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"), rating.alias("rating")))
    base = r.agg(F.stddev_pop("rating")).first()[0]
    als = apps.matrix_completion(r, rank=4, iterations=5).transform(r)
    users, items = apps.gradient_completion(r, rank=4, epochs=5)
    dot = F.aggregate(F.zip_with("fu", "fi", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    sgd = r.join(users.select(F.col("id").alias("user"), F.col("f").alias("fu")), "user").join(items.select(F.col("id").alias("item"), F.col("f").alias("fi")), "item").withColumn("prediction", dot)
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating"), 2)))
    parts = [df.agg(error.alias("e")).select(F.lit(n).alias("method"), (F.col("e") < 0.5 * base).alias("better_than_mean")) for n, df in (("least_squares", als), ("gradient", sgd))]
    return parts[0].unionAll(parts[1])


@query(with_("SELECT n.id AS var, r.a AS target FROM n JOIN r ON r.b = n.id", "e2", n=nodes_of("e2")).replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT n.id AS var", ", r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e2.dst FROM r JOIN e2 ON r.b = e2.src) SELECT n.id AS var", 1))
def points_to(spark, d):
    """Every part's address is taken; values flow along co-part edges."""
    g = graphs.copart(spark, d, 2)
    addr = g.nodes.select(F.lit("addr").alias("kind"), F.col("id").alias("src"), F.col("id").alias("dst"))
    return apps.points_to(addr.unionAll(g.edges.select(F.lit("copy"), "src", "dst")))


# ---------------------------------------------------------------- loops of users


@query(SQL["connected_components"])
def pregel_components(spark, d):
    g = graphs.copart(spark, d, 2)
    least = F.least("component", F.coalesce("message", "component"))
    return loops.pregel(g, {"component": F.col("id")}, F.col("src_component"), F.min, {"component": least}, symmetric=False)


@query(with_("SELECT id, dist FROM s13", "e1", **_SP))
def pregel_distances(spark, d):
    g = graphs.user_next(spark, d)
    s = _first(g)
    none = F.lit(None).cast("long")
    out = loops.pregel(g, {"dist": F.when(F.col("id") == s, F.lit(0).cast("long")).otherwise(none)}, F.col("src_dist") + F.col("w"), F.min, {"dist": F.least("dist", "message")}, active=F.col("id") == s)
    return out.where("dist is not null")


@query(with_("SELECT id, round(r, 6) AS rank FROM p10", "m1", **_PR))
def pregel_ranks(spark, d):
    g = graphs.user_next_multi(spark, d)
    g = PropertyGraph(g.nodes.join(g.out_degree(), "id"), g.edges)
    n = g.nodes.count()
    out = loops.pregel(g, {"rank": F.lit(1.0 / n), "out": F.col("out_degree")}, F.col("src_rank") / F.col("src_out"), F.sum, {"rank": F.lit(0.15) + 0.85 * F.coalesce("message", F.lit(0.0))}, fixed_rounds=10)
    return out.select("id", F.round("rank", 6).alias("rank"))


@query(with_(f"SELECT id, level::BIGINT AS level FROM b{_HOPS - 1}", "e2", **{k: v for k, v in _BFS_SQL.items()}))
def worklist_levels(spark, d):
    """Levels by an ordered worklist: a batch is the least level that is open."""
    g = graphs.copart(spark, d, 2)
    edges = cut(g.undirected().distinct())
    start = g.nodes.where(F.col("id") == _first(g)).select("id", F.lit(0).cast("long").alias("level"))
    body = lambda items, done: edges.join(items.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("level") + 1).alias("level"))
    return loops.for_each(start, body, ["id"], priority="level")


@query(with_("SELECT sum(id)::BIGINT AS total, max(id) AS top, sum(CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even FROM n", "e2", n=nodes_of("e2")))
def reducers(spark, d):
    g = loops.do_all(graphs.copart(spark, d, 2), even=(F.col("id") % 2 == 0).cast("int"))
    return loops.reduce_nodes(g, total=F.sum("id"), top=F.max("id"), even=F.sum("even"))
