"""Triangles in tasks of three colours."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallygraph.operators import exact, local
from tallygraph.plans import pattern
from tallygraph.plans.graph import Graph
from tests.graphs import count, random_edges

EDGES = sorted({*random_edges(40, 260, 3), *((0, v) for v in range(1, 40))})


@pytest.fixture(params=[1, 4])
def graph(spark, monkeypatch, request):
    """In one task, and in twenty; vertex 0 meets all others."""
    monkeypatch.setattr(local, "colours", lambda num_edges: request.param)
    rows = [(a, b, (7 * a + 3 * b) % 100) for a, b in EDGES]
    return Graph.unordered(spark.createDataFrame(rows, "src long, dst long, weight long"))


def triangles():
    have = set(EDGES)
    return [(a, b, c) for a, b, c in itertools.combinations(range(40), 3) if {(a, b), (a, c), (b, c)} <= have]


def test_wedges_are_not_joined(graph):
    plan = exact.triangles(graph)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("BroadcastNestedLoopJoin", "")


def test_triangles_and_their_weights(graph):
    weight = lambda a, b: (7 * a + 3 * b) % 100
    found = exact.triangles_of(graph).select("a", "b", "c", "w_ab", "w_ac", "w_bc").collect()
    assert sorted(map(tuple, found)) == [(a, b, c, weight(a, b), weight(a, c), weight(b, c)) for a, b, c in triangles()]
    assert exact.triangles(graph).first()[0] == len(found)
    heavy = lambda t: [weight(a, b) >= 50 for a, b in itertools.combinations(t, 2)]
    assert exact.weighted_triangles(graph, "weight >= 50", False, "n").first()[0] == sum(any(heavy(t)) for t in triangles())
    assert exact.weighted_triangles(graph, "weight >= 50", True, "n").first()[0] == sum(all(heavy(t)) for t in triangles())


def test_four_cliques(graph):
    have = set(EDGES)
    cliques = sum(set(itertools.combinations(q, 2)) <= have for q in itertools.combinations(range(40), 4))
    assert exact.count(graph, pattern.FOUR_CLIQUE, "n").first()[0] == cliques


def test_no_edges(graph):
    empty = Graph(graph.edges.where("false"))
    assert exact.triangles(empty).first()[0] == 0
    assert exact.four_cliques(empty).first()[0] == 0
    assert exact.triangles_of(empty).agg(F.count("a")).first()[0] == 0


def test_packed_edges_come_back():
    import numpy as np

    columns = [np.array([-5, 0, 0, 1 << 40]), np.array([1 << 62, 3, 4, -1]), np.array([9, local.NONE, 0, 1])]
    assert all((a == b).all() for a, b in zip(local.unpack(local.pack(columns), 4, 3), columns, strict=True))


def test_blocks_hold_repeated_edges_once(spark, monkeypatch):
    monkeypatch.setattr(local, "colours", lambda num_edges: 4)
    rows = [*EDGES, *((b, a) for a, b in EDGES[::3]), (7, 7), (None, 3)]
    graph = Graph.unordered(spark.createDataFrame(rows, "src long, dst long"))
    degree = [sum(v in e for e in EDGES) for v in range(40)]
    assert sum(n for (n,) in graph.blocks.rows.select("n").collect()) == len(EDGES)
    assert tuple(exact.three_motifs(graph).first())[:2] == (sum(d * (d - 1) // 2 for d in degree), len(triangles()))
    assert dict(map(tuple, exact.triangles_per_vertex(graph).collect())) == {v: n for v in range(40) if (n := sum(v in t for t in triangles()))}
    assert exact.triangles(graph.permuted(5)).first()[0] == len(triangles())


def test_no_more_than_some_copies_of_the_edges_are_sent_at_once(spark, monkeypatch):
    monkeypatch.setattr(local, "colours", lambda num_edges: 7)
    sent, written = [], local.lineage.written
    monkeypatch.setattr(local.lineage, "written", lambda df, tag: sent.append(tag) or written(df, tag))
    graph = Graph.unordered(spark.createDataFrame(EDGES, "src long, dst long"))
    assert exact.triangles(graph).first()[0] == len(triangles())
    assert sent == ["blocks", *["round"] * 3]


@pytest.mark.parametrize("parts", [1, 5])
def test_four_cycles_chains_and_houses_by_parts(graph, monkeypatch, parts):
    monkeypatch.setattr(local, "ONE_TASK", 0 if parts > 1 else 20_000)
    monkeypatch.setattr(local, "PART_EDGES", 2 * len(EDGES) / (parts - 0.5))
    near = {v: {w for e in EDGES if v in e for w in e if w != v} for v in range(40)}
    pairs = list(itertools.combinations(range(40), 2))
    cycles = sum(k * (k - 1) // 2 for a, b in pairs if (k := len(near[a] & near[b]))) // 2
    chains = sum(1 for c in range(40) for b, d in itertools.combinations(sorted(near[c]), 2) for a in near[b] - {c, d} for e in near[d] - {b, c, a})
    houses = sum(len((near[a] & near[b]) - {c, d}) for a, b in EDGES for c in near[a] - {b} for d in near[b] & near[c] - {a})
    assert [exact.count(graph, p).first()[0] for p in (pattern.cycle(4), pattern.FIVE_CHAIN, pattern.HOUSE)] == [cycles, chains, houses]
    empty = Graph(graph.edges.where("false"))
    assert [exact.count(empty, p).first()[0] for p in (pattern.cycle(4), pattern.FIVE_CHAIN, pattern.HOUSE)] == [0, 0, 0]


def test_no_path_of_a_four_cycle_is_shuffled(graph, monkeypatch):
    sent, written = [], local.lineage.written
    monkeypatch.setattr(local.lineage, "written", lambda df, tag: sent.append(tag) or written(df, tag))
    exact.four_cycles(graph)
    assert sent == ["blocks", "degrees", "parts"]


def test_paths_some_at_a_time(monkeypatch):
    import numpy as np

    monkeypatch.setattr(local, "WEDGES", 7)
    u, w = (np.array(z) for z in zip(*sorted([*EDGES, *((b, a) for a, b in EDGES)]), strict=True))
    part = lambda i, *more: [c[w % 3 == i] for c in (u, w // 3, *more)]
    have = {v: {b for a, b in zip(u.tolist(), w.tolist(), strict=True) if a == v} for v in range(40)}
    last = {(v, x): {m for m in have[v] & have[x] if m < v} for v in range(40) for x in range(v)}
    found = sum(local._pairs_of_paths(local._down(part(i), 3, i), part(j), 3, j, 14) for i in range(3) for j in range(3))
    assert found == sum(len(m) * (len(m) - 1) // 2 for m in last.values())
    number = (u + w) * 5 + (u * w) % 4
    found = sum(local._pairs_of_paths(local._down(part(i, number), 3, i), part(j, number), 3, j, 14) for i in range(3) for j in range(3))
    weigh = lambda a, b: (a + b) * 5 + (a * b) % 4
    assert found == sum((len(m) - 1) * sum(weigh(v, x) + weigh(x, y) for x in m) for (v, y), m in last.items())
