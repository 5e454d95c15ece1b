"""Places are found for the drawn edges alone, and are those of the whole graph."""

from pyspark.sql import functions as F

from tallygraph.operators import sampling
from tallygraph.plans.graph import Graph
from tests.graphs import random_edges


def test_places_and_neighbours_of_the_asked(spark, monkeypatch):
    g = Graph.from_edges(spark.createDataFrame(random_edges(60, 200, 5), "src long, dst long")).persist()
    ids = sampling.estimators(spark, 0, 7)
    for most in (sampling.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", most)
        drawn, adjacency = sampling.placed_edge(ids, g, 3)
        whole = sampling.sample_edge(ids, g.placed, g.num_edges, 3)
        names = sorted(whole.columns)
        assert sorted(drawn.columns) == names
        assert sorted(map(tuple, drawn.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))
        ends = {v for r in drawn.collect() for v in (r.src, r.dst)}
        names = sorted(g.adjacency.columns)
        assert sorted(map(tuple, adjacency.select(names).collect())) == sorted(map(tuple, g.adjacency.where(F.col("u").isin(ends)).select(names).collect()))
        asked = sampling.neighbours_of(g, spark.createDataFrame([(u,) for u in ends], "u long"))
        assert {r.u: r.nbrs for r in asked.collect()} == {r.u: r.nbrs for r in g.neighbours.collect() if r.u in ends}
