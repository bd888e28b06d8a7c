"""Steps whose cost must not outgrow the input, with block and part sizes made small."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom import graphs
from graphloom.graph import PropertyGraph
from graphloom.operators import apps, peeling, triangles
from graphloom.plans import ordering


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def random_graph(n, m, seed):
    """Edges with loops, parallel and reciprocal ones, a hub, and ids far apart; and the set of its pairs."""
    r = random.Random(seed)
    e = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(7, k) for k in range(n)]
    e = [(a * 10**12 // 7 - 5, b * 10**12 // 7 - 5) for a, b in e]
    return e, {(min(x), max(x)) for x in e if x[0] != x[1]}


def test_triangles_by_blocks(spark, monkeypatch):
    e, pairs = random_graph(40, 200, 5)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = sorted((a, b, c) for a, b in pairs for c in near.get(b, ()) if c in near[a])
    g = PropertyGraph.of(spark.createDataFrame(e, "src long, dst long"))
    monkeypatch.setattr(triangles, "BLOCK_EDGES", 40)
    kept = triangles.cut(triangles._pairs(g))
    bounds, triples, _ = triangles._plan(kept)
    assert len(bounds) > 2 and len(triples) > 6
    assert rows(triangles.triangles(g), "u", "v", "w") == want
    assert triangles.triangle_count(g).first()[0] == len(want)
    # Pairs are exchanged by blocks; no join makes wedges.
    plan = triangles._triangles(kept, "total")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    # One copy after another, with ids apart: a pair goes to few tasks, however many ranges there are.
    local = [(s + a, s + b) for s in range(0, 3200, 100) for a in range(8) for b in range(a + 1, 8)]
    far = triangles.cut(spark.createDataFrame(local, "a long, b long"))
    bounds, triples, load = triangles._plan(far)
    assert len(triples) < 4 * (len(bounds) + 1) and load < 4 * len(local)
    assert triangles._triangles(far, "total").agg(F.sum("t")).first()[0] == 32 * 56


def test_no_triangles(spark):
    g = PropertyGraph.of(spark.createDataFrame([(3, 3)], "src long, dst long"))
    assert triangles.triangle_count(g).first()[0] == 0 and rows(triangles.triangles(g), "u", "v", "w") == []


def test_copart_by_parts_that_follow_the_rows(spark, monkeypatch, tmp_path):
    lines = [(o, (o * 7 + k * k) % 50) for o in range(60) for k in range(5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(ordering, "PART_ROWS", 25)
    sets = {}
    for o, p in lines:
        sets.setdefault(o, set()).add(p)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    kept = []
    of = graphs._of
    monkeypatch.setattr(graphs, "_of", lambda e, **more: kept.append(e) or of(e, **more))
    g = graphs.copart(spark, str(tmp_path))
    assert rows(g.edges, "edge_id", "src", "dst", "w") == [(i, *k, want[k]) for i, k in enumerate(sorted(want))]
    # 300 lines and the pairs of the orders by parts of 25 at most, though the session has 4.
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    pairs = sum(len(s) * (len(s) - 1) // 2 for s in sets.values())
    assert f", {-(-300 // 25)})" in plan and f", {-(-pairs // 25)})" in plan


def test_gradient_by_batches_is_the_loop_over_ratings(spark, monkeypatch):
    r = random.Random(4)
    data = sorted({(r.randrange(12), r.randrange(9)) for _ in range(60)} | {(3, k) for k in range(9)})
    data = [(u, i, (u % 3 + 1) * (i % 2 + 1) / 6) for u, i in data]
    df = spark.createDataFrame(data, "user long, item long, rating double").repartition(3)
    users, items = (dict(rows(x, "id", "f")) for x in apps.gradient_completion(df, rank=3, epochs=0, blocks=1))
    f, g = ({k: np.array(v) for k, v in x.items()} for x in (users, items))
    order = [data[k] for k in np.random.default_rng(1).permutation(len(data))]
    for _ in range(2):
        for u, i, y in order:
            a, b = f[u].copy(), g[i].copy()
            miss = y - a @ b
            f[u] += 0.05 * (miss * b - 0.02 * a)
            g[i] += 0.05 * (miss * a - 0.02 * b)
    for got, want in zip(apps.gradient_completion(df, rank=3, epochs=2, blocks=1), (f, g)):
        got = dict(rows(got, "id", "f"))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    # Cells of 10 ratings at most, by more blocks than asked for; each user and item keeps a factor.
    monkeypatch.setattr(apps, "CELL_RATINGS", 10)
    users, items = apps.gradient_completion(df, rank=3, epochs=1, blocks=1)
    assert {x[0] for x in rows(users, "id")} == set(f) and {x[0] for x in rows(items, "id")} == set(g)
    u, i = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    at, ends = apps._batches(u, i)
    parts = np.split(at, ends[:-1])
    assert len(parts) < len(data) / 2 and all(len(set(u[k])) == len(set(i[k])) == len(k) for k in parts)


def test_clustering_by_blocks(spark, monkeypatch):
    e, pairs = random_graph(25, 90, 8)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    g = PropertyGraph.of(spark.createDataFrame(e, "src long, dst long"))
    monkeypatch.setattr(triangles, "BLOCK_EDGES", 40)
    got = dict(rows(triangles.local_clustering(g), "id", "coefficient"))
    assert got.keys() == near.keys()
    for v, n in near.items():
        links = sum(len(near[u] & n) for u in n) / 2
        assert abs(got[v] - (2 * links / (len(n) * (len(n) - 1)) if len(n) > 1 else 0)) < 1e-12


def test_truss_lists_no_triangles_of_weak_edges(spark, monkeypatch):
    cliques = [(s + a, s + b) for s in (0, 10) for a in range(6) for b in range(a + 1, 6)]
    weak = [(5, 10), (4, 10), (5, 11), (20, 21), (21, 22), (20, 22)] + [(30 + k, 31 + k) for k in range(9)]
    g = PropertyGraph.of(spark.createDataFrame(cliques + weak, "src long, dst long"))
    monkeypatch.setattr(triangles, "triangles_of", None)  # counted only
    assert rows(peeling.k_truss(g, 5), "src", "dst") == cliques


def test_walks_number_the_edges_once_and_take_the_same_draws(spark, monkeypatch):
    e = spark.createDataFrame([(0, i, ["A"] if i % 3 else ["B"]) for i in range(1, 20)] + [(1, 2, ["C"]), (2, 3, ["C"])], "src long, dst long, types array<string>")
    g = PropertyGraph.of(e)
    made = []
    index = apps._walk_index
    monkeypatch.setattr(apps, "_walk_index", lambda *a: made.append(index(*a)) or made[-1])
    a = rows(apps.edge_type_walks(g, 3, rounds=2)[0], "walk", "step", "node")
    assert len(made) == 1 and made[0][2] is None and len(a) == 20 * 3
    monkeypatch.setattr(apps, "TRIES", 1)
    assert a == rows(apps.edge_type_walks(g, 3, rounds=2)[0], "walk", "step", "node")
