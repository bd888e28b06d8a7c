"""Ingest, text forms, closed-form topologies and applications."""

import pytest

from graphloom.graph import GraphError, PropertyGraph
from graphloom.operators import apps, communities, triangles
from graphloom.sources import ingest, sinks, topologies


def pairs(g, *cols):
    return [tuple(r) for r in g.edges.orderBy("edge_id").select("src", "dst", *cols).collect()]


def test_arrays(spark):
    g = ingest.from_adjacency_matrix(spark, [[0, 1, 0], [0, 0, 2], [3, 0, 0]])
    assert pairs(g, "weight") == [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 3.0)]
    g = ingest.from_edge_arrays(spark, [0, 1, 10, 1], [1, 2, 0, 2], {"p": [1, 2, 3, 2]})
    assert g.nodes.count() == 11 and [x[2] for x in pairs(g, "p")] == [1, 2, 2, 3]
    assert pairs(ingest.from_edge_arrays(spark, [10, 0], [0, 1], keep_order=True)) == [(10, 0), (0, 1)]
    assert pairs(ingest.from_csr(spark, [1, 1, 3], [2, 0, 1])) == [(0, 2), (2, 0), (2, 1)]
    for bad in (([], []), ([1], [])):
        with pytest.raises(GraphError):
            ingest.from_edge_arrays(spark, *bad)


def test_files(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 2\n1 2 0.5\n3 1 2\n")
    assert pairs(ingest.read_matrix_market(spark, str(tmp_path / "m.mtx")), "w") == [(0, 1, 0.5), (2, 0, 2.0)]
    (tmp_path / "d.gr").write_text("c note\np sp 4 2\na 1 2 7\na 2 3 5\n")
    d = ingest.read_dimacs(spark, str(tmp_path / "d.gr"))
    assert d.nodes.count() == 4 and pairs(d, "w") == [(0, 1, 7), (1, 2, 5)]
    (tmp_path / "n.txt").write_text("0 1 2\n2 0\n")
    assert pairs(ingest.read_node_list(spark, str(tmp_path / "n.txt"))) == [(0, 1), (0, 2), (2, 0)]
    (tmp_path / "e.csv").write_text("source,destination,x\n0,1,a\n1,0,b\n")
    assert pairs(ingest.read_csv(spark, str(tmp_path / "e.csv")), "x") == [(0, 1, "a"), (1, 0, "b")]
    sinks.write_edge_list(d, str(tmp_path / "out"), "w")
    assert pairs(ingest.read_edge_list(spark, str(tmp_path / "out"), weighted=True), "w") == pairs(d, "w")
    sinks.write_dimacs(d, str(tmp_path / "dim"))
    assert pairs(ingest.read_dimacs(spark, str(tmp_path / "dim")), "w") == pairs(d, "w")


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0"?><graphml><key id="name" for="node" attr.name="name" attr.type="string"/><key id="released" for="node" attr.name="released" attr.type="long"/>'
        '<key id="roles" for="edge" attr.name="roles" attr.type="string" attr.list="string"/><graph>'
        '<node id="a" labels=":Movie"><data key="name">M</data><data key="released">1999</data></node><node id="b" labels=":Person:Actor"><data key="name">P</data></node>'
        '<edge id="e" source="b" target="a" label="ACTED_IN"><data key="roles">["Neo","One"]</data></edge></graph></graphml>'
    )
    g = ingest.read_graphml(spark, str(tmp_path / "g.graphml"))
    got = {r["key"]: (r["types"], r["name"], r["released"]) for r in g.nodes.collect()}
    assert got == {"a": (["Movie"], "M", 1999), "b": (["Actor", "Person"], "P", None)}
    e = g.edges.first()
    assert (e["src"], e["dst"], e["types"], e["roles"]) == (1, 0, ["ACTED_IN"], ["Neo", "One"])


@pytest.mark.parametrize("make,args,want", [("grid", (3, 4), 24), ("wheel", (6,), 5), ("sawtooth", (3,), 3), ("triangle", (3,), 9)])
def test_topologies(spark, make, args, want):
    assert triangles.triangle_count(getattr(topologies, make)(spark, *args)).first()[0] == want


def test_label_propagation_on_a_grid(spark):
    s = communities.group_statistics(communities.cdlp(topologies.grid(spark, 2, 2, False), symmetric=True), "community").first()
    assert tuple(s) == (2, 2, 2, 0.5)


def test_apps(spark):
    g = PropertyGraph.of(spark.createDataFrame([(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (2, 3, 8), (4, 5, 3)], "src long, dst long, w long"))
    assert apps.spanning_forest(g).agg({"w": "sum"}).first()[0] == 1 + 2 + 5 + 3
    assert apps.max_flow(g, 0, 3).first()[0] == 5
    c = spark.createDataFrame([("addr", 10, 0), ("copy", 0, 1), ("addr", 0, 2), ("store", 3, 2), ("addr", 11, 3), ("load", 2, 4)], "kind string, src long, dst long")
    assert sorted(tuple(r) for r in apps.points_to(c).collect()) == [(0, 10), (0, 11), (1, 10), (1, 11), (2, 0), (3, 11), (4, 10), (4, 11)]
    walks = apps.random_walks(g, 4, 2, 0.5, 2.0)
    again = apps.random_walks(g, 4, 2, 0.5, 2.0)
    assert sorted(map(tuple, walks.collect())) == sorted(map(tuple, again.collect()))
    hops = {(a, b) for a, b, _ in [(r["src"], r["dst"], 0) for r in g.edges.collect()]}
    by = {(r["walk"], r["step"]): r["node"] for r in walks.collect()}
    assert all((by[w, s - 1], n) in hops for (w, s), n in by.items() if s)
