"""Loops of users, matching, flows, clusterings of large levels, storage by two writers, typed ingest."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph, _claim, manifest, versions
from graphloom.operators import apps, communities, loops
from graphloom.sources import ingest, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_levels_in_one_task_or_by_rounds_agree(spark, monkeypatch):
    two = [(a, b, 1) for s in (0, 5) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 5, 1)]
    g = PropertyGraph.of(spark.createDataFrame(two, "src long, dst long, w long"))
    one = rows(communities.louvain(g), "id", "cluster")
    monkeypatch.setattr(communities, "LOCAL_EDGES", 0)
    assert one == rows(communities.louvain(g), "id", "cluster") == [(i, 0 if i < 5 else 5) for i in range(10)]


def test_matching_is_a_maximum(spark):
    r = random.Random(3)
    for _ in range(3):
        pairs = {(r.randrange(6), 100 + r.randrange(6)) for _ in range(11)}
        got = rows(apps.bipartite_matching(spark.createDataFrame(sorted(pairs), "left long, right long")), "left", "right")
        assert set(got) <= pairs and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        best = next(k for k in range(6, 0, -1) if any(len({a for a, _ in c}) == len({b for _, b in c}) == k for c in itertools.combinations(sorted(pairs), k)))
        assert len(got) == best


def test_flow_in_rounds_and_in_one_task_agree(spark, monkeypatch):
    e = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (2, 3, 8), (1, 2, 3)]
    g = PropertyGraph.of(spark.createDataFrame(e, "src long, dst long, w long"))
    assert apps.max_flow(g, 0, 3).first()[0] == 5
    monkeypatch.setattr(apps, "LOCAL_EDGES", 0)
    assert apps.max_flow(g, 0, 3).first()[0] == 5


def test_pregel_raises_if_rounds_run_out(spark):
    g = PropertyGraph.of(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long"))
    init, update = {"c": F.col("id")}, {"c": F.least("c", F.coalesce("message", "c"))}
    assert rows(loops.pregel(g, init, F.col("src_c"), F.min, update), "id", "c") == [(i, 0) for i in range(4)]
    with pytest.raises(loops.NotSettled):
        loops.pregel(g, init, F.col("src_c"), F.min, update, max_rounds=1)


def test_two_writers_get_two_versions(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    g = PropertyGraph.of(spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert _claim(spark, path, 1) == 1 and g.write(path) == 2
    assert versions(spark, path) == [2] and manifest(spark, path, 2)["parent"] is None


def test_walks_from_a_hub(spark):
    star = [(0, i) for i in range(1, 60)]
    g = PropertyGraph.of(spark.createDataFrame(star, "src long, dst long"))
    a = apps.random_walks(g, 3, 2, q=0.5, symmetric=False)
    b = apps.random_walks(PropertyGraph(g.nodes, g.edges.repartition(3)), 3, 2, q=0.5, symmetric=False)
    assert rows(a, "walk", "step", "node") == rows(b, "walk", "step", "node") and a.count() == 60 * 2 * 3


class Attributed:
    """What a networkx graph offers to readers."""

    def nodes(self, data):
        return [("x", {"n": 1}), ("y", {})]

    def edges(self, data):
        return [("x", "y", {"w": 2})]


def test_typed_ingest(spark, tmp_path):
    g = ingest.from_networkx(spark, Attributed())
    assert rows(g.edges, "src", "dst", "attributes") == [(0, 1, '{"w": 2}')]
    n = spark.createDataFrame([(0, True, False), (1, True, True)], "id long, A boolean, B boolean")
    e = spark.createDataFrame([(0, 1, 5)], "source long, destination long, w long")
    g = ingest.from_typed_frames(n, e, ["A", "B"])
    assert sorted(r["types"] for r in g.nodes.collect()) == [["A"], ["A", "B"]] and g.node_properties() == []
    sinks.write_pbbs(g, f"{tmp_path}/p", "w")
    assert rows(ingest.read_pbbs(spark, f"{tmp_path}/p").edges, "src", "dst", "w") == [(0, 1, 5.0)]


def test_command_line(spark, tmp_path):
    from graphloom.__main__ import run

    (tmp_path / "e.txt").write_text("# edges\n0 1 4\n1 2 3\n0 2 9\n")
    out = run(spark, ["sssp", str(tmp_path / "e.txt"), str(tmp_path / "out"), "--format", "weighted-edgelist"])
    assert rows(out, "id", "dist") == [(0, 0), (1, 4), (2, 7)]
