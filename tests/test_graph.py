"""Golden graphs, property tables, types and storage."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.types import has_type, is_subtype
from graphloom.graph import AlreadyExists, GraphError, PropertyGraph, PropertyNotFound
from graphloom.operators import centrality, communities, peeling, traversal, triangles

EDGES = [(0, 1, 4), (0, 3, 2), (0, 4, 7), (1, 3, 3), (1, 4, 5), (2, 4, 5), (2, 5, 2), (2, 6, 8), (3, 4, 1), (4, 7, 4), (5, 6, 4), (5, 7, 6)]


@pytest.fixture(scope="module")
def g(spark):
    return PropertyGraph.of(spark.createDataFrame(EDGES, "src long, dst long, w long").cache())


def clique(spark, n):
    return PropertyGraph.of(spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a != b], "src long, dst long"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_bfs(g):
    got = traversal.bfs(g, 0)
    assert rows(got, "id", "level", "parent") == [(0, 0, 0), (1, 1, 0), (3, 1, 0), (4, 1, 0), (7, 2, 4)]
    assert traversal.bfs_violations(g, 0, got) == 0
    wrong = got.withColumn("parent", F.when(F.col("id") == 7, 1).otherwise(F.col("parent")))
    assert traversal.bfs_violations(g, 0, wrong) == 1
    assert rows(traversal.bfs(g, 2), "id") == [(2,), (4,), (5,), (6,), (7,)]
    with pytest.raises(GraphError):
        traversal.bfs(g, 99)


def test_sssp(g):
    got = traversal.sssp(g, 0)
    assert rows(got, "id", "dist") == [(0, 0), (1, 4), (3, 2), (4, 3), (7, 7)]
    assert rows(traversal.sssp(g, 1), "id", "dist") == [(1, 0), (3, 3), (4, 4), (7, 8)]
    assert traversal.sssp_violations(g, 0, got) == 0


def test_k_shortest_paths(g):
    got = [tuple(r) for r in traversal.k_shortest_paths(g, 0, 7, 3).orderBy("rank").collect()]
    assert got == [(1, 7, "0,3,4,7"), (2, 11, "0,4,7"), (3, 12, "0,1,3,4,7")]
    simple = [tuple(r) for r in traversal.k_shortest_paths(g, 0, 7, 10, simple=True).orderBy("rank").collect()]
    assert simple == [*got, (4, 13, "0,1,4,7")]


def test_components_triangles(g):
    assert {r["component"] for r in communities.connected_components(g).collect()} == {0}
    assert triangles.triangle_count(g).first()[0] == 5


@pytest.mark.parametrize("n,want", [(3, 1), (4, 4), (5, 10)])
def test_cliques(spark, n, want):
    c = clique(spark, n)
    assert triangles.triangle_count(c).first()[0] == want
    assert all(r["coefficient"] == 1.0 for r in triangles.local_clustering(c).collect())
    assert communities.group_statistics(communities.cdlp(c), "community").first()["total"] == 1


def test_peeling(spark, g):
    core = rows(peeling.k_core(g, 3).where("alive"), "id")
    assert core == [(0,), (1,), (3,), (4,)]
    assert rows(peeling.k_truss(g, 4), "src", "dst") == [(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (3, 4)]
    with pytest.raises(GraphError):
        peeling.k_truss(g, 2)
    m = peeling.independent_set(g)
    assert rows(m.where("member"), "id") == [(0,), (2,), (7,)]
    assert peeling.independent_set_violations(g, m) == 0
    assert peeling.independent_set_violations(g, peeling.independent_set(g, order="hash")) == 0


def test_betweenness_by_hand(spark):
    path = PropertyGraph.of(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long"))
    assert rows(centrality.betweenness(path), "id", "score") == [(0, 0.0), (1, 2.0), (2, 2.0), (3, 0.0)]


def test_pagerank_settles(g):
    a = dict(rows(centrality.pagerank(g, tolerance=1e-7), "id", "rank"))
    b = dict(rows(centrality.pagerank(g, tolerance=None, max_iterations=40), "id", "rank"))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)
    assert abs(a[0] - 0.15) < 1e-9


def test_clusterings(spark):
    two = [(a, b, 1) for s in (0, 6) for a in range(s, s + 6) for b in range(a + 1, s + 6)] + [(5, 6, 1)]
    g = PropertyGraph.of(spark.createDataFrame(two, "src long, dst long, w long"))
    for f in (communities.louvain, communities.leiden):
        assert dict(rows(f(g), "id", "cluster")) == {i: 0 if i < 6 else 6 for i in range(12)}
    assert communities.louvain(g, min_graph_size=100).where("cluster is not null").count() == 0


def test_properties(spark, g):
    extra = g.nodes.select("id", (F.col("id") * 2).alias("x"))
    h = g.add_node_property(extra)
    with pytest.raises(AlreadyExists):
        h.add_node_property(extra)
    assert rows(h.upsert_node_property(g.nodes.select("id", F.lit(1).alias("x"))).get_node_property("x"), "x") == [(1,)] * 8
    assert h.remove_node_property(0).node_properties() == []
    with pytest.raises(PropertyNotFound):
        g.remove_node_property("nope")
    assert [r["source"] for r in h.out_edges([5, 0]).collect()] == [5, 5, 0, 0, 0]
    assert g.has_edge(0, 3) and not g.has_edge(3, 0)


def test_multigraph(spark):
    m = PropertyGraph.of(spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 0)], "src long, dst long"))
    assert rows(m.out_degree(), "id", "out_degree") == [(0, 2), (1, 2)]
    assert m.undirected().count() == 8
    assert m.symmetric().edges.count() == 7
    assert m.subgraph([1, 0, 1]).edges.count() == 4


def test_types_and_projection(spark):
    nodes = spark.createDataFrame([(0, ["A", "B"]), (1, ["B"]), (2, ["A"]), (3, ["A", "C"])], "id long, types array<string>")
    edges = spark.createDataFrame([(0, 2, ["X"]), (2, 3, ["Y"]), (1, 0, ["X"])], "src long, dst long, types array<string>")
    g = PropertyGraph.of(edges, nodes)
    assert rows(g.nodes.where(has_type(F.col("types"), "A")), "id") == [(0,), (2,), (3,)]
    p = g.project(["A"], None)
    assert rows(p.nodes, "id") == [(0,), (1,), (2,)] and rows(p.edges, "src", "dst") == [(0, 1), (1, 2)]
    assert g.project([], None).nodes.count() == 0 and g.project(None, ["X"]).edges.count() == 2
    s = spark.range(1).select(is_subtype(F.array(F.lit("A")), F.array(F.lit("A"), F.lit("B"))).alias("x"), is_subtype(F.array(F.lit("C")), F.array(F.lit("A"))).alias("y")).first()
    assert s["x"] and not s["y"]


def test_storage(spark, g, tmp_path):
    path = f"file://{tmp_path}/g"
    assert g.write(path) == 1 and g.transpose().write(path) == 2
    assert PropertyGraph.read(spark, path, 1).equals(g)
    assert not PropertyGraph.read(spark, path).equals(g)
    assert PropertyGraph.read(spark, path, 1, edge_properties=[]).edge_properties() == []
    assert PropertyGraph.read(spark, path, 1).slice(0, 2).edges.count() == 5
