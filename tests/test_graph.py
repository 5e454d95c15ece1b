from pyspark.sql import functions as F

from tallygraph.plans import graph
from tallygraph.plans.graph import Graph
from tests.graphs import SMALL_10


def test_canonical_drops_loops_and_repeats(spark):
    raw = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 1), (5, 4)], "src int, dst int")
    assert sorted(map(tuple, graph.canonical(raw).collect())) == [(1, 2), (4, 5)]
    weighted = spark.createDataFrame([(1, 2, 9), (2, 1, 4)], "src int, dst int, weight int")
    assert [tuple(r) for r in graph.canonical(weighted).collect()] == [(1, 2, 4)]


def test_ids_degrees_and_places(spark):
    g = Graph.from_edges(spark.createDataFrame(SMALL_10, "src long, dst long")).persist()
    assert sorted(r[0] for r in g.edges.select("edge_id").collect()) == list(range(13))
    assert {r.u: r.deg for r in g.degrees.collect()} == {0: 4, 1: 4, 2: 4, 3: 2, 4: 3, 5: 2, 6: 3, 7: 2, 8: 2}
    adj = g.adjacency.orderBy("u", "pos").collect()
    assert len(adj) == 26
    for a, b in zip(adj, adj[1:], strict=False):
        assert a.u < b.u and b.pos == 0 or a.u == b.u and a.edge_id < b.edge_id and b.pos == a.pos + 1


def test_relabel_is_dense_and_keeps_order(spark):
    edges, mapping = graph.relabel(spark.createDataFrame([(1000, 5), (70, 5)], "src long, dst long"))
    assert {r.old_id: r.new_id for r in mapping.collect()} == {5: 0, 70: 1, 1000: 2}
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2)]


def test_permutation_is_one_to_one(spark):
    g = Graph.from_edges(spark.createDataFrame(SMALL_10, "src long, dst long"))
    p = g.permutation(3).collect()
    assert sorted(r.new_id for r in p) == list(range(9)) and sorted(r.old_id for r in p) == list(range(9))


def test_filter_and_sample_follow_through(spark):
    rows = [(a, b, 10 * i) for i, (a, b) in enumerate(SMALL_10)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight long"))
    assert g.filter("weight >= 50").num_edges == 8
    assert sorted(r[0] for r in g.filter(F.col("weight") >= 50).reindexed().edges.select("edge_id").collect()) == list(range(8))
    assert g.sample(1.0).num_edges == 13 and g.sample(0.0).num_edges == 0


def test_workers_share_the_vertices(spark):
    g = Graph.from_edges(spark.createDataFrame(SMALL_10, "src long, dst long"))
    w = g.workers(3, 9)
    assert {r["count"] for r in w.groupBy("worker").count().collect()} == {3}
    assert g.within_workers(w).count() <= 13
