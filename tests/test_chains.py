"""k-chains look up neighbours of their walks' ends alone, and sum large inverse probabilities as their SQL does."""

import duckdb

from tallygraph.operators import estimators, sampling
from tallygraph.plans import catalogue
from tallygraph.plans.graph import Graph
from tests.graphs import random_edges


def test_chains_ask_for_neighbours_of_their_ends_alone(spark, monkeypatch):
    g = Graph.from_edges(spark.createDataFrame(random_edges(60, 200, 5), "src long, dst long")).persist()
    whole, asked, some = g.neighbours, [], sampling.neighbours_of
    rows = lambda df: sorted((r.est, [e.id for e in r.met], r.ends, r.inv_p) for r in df.collect())

    def recorded(graph, vertices):
        asked.append(vertices.distinct().count())
        return some(graph, vertices)

    monkeypatch.setattr(Graph, "neighbours", property(lambda _: (_ for _ in ()).throw(AssertionError("all neighbours"))))
    monkeypatch.setattr(sampling, "neighbours_of", recorded)
    found = rows(estimators.chain_mining(4)(g, 0, 9, 47))
    assert len(asked) == 2 and max(asked) <= 18
    monkeypatch.setattr(sampling, "neighbours_of", lambda graph, vertices: whole)
    assert found and found == rows(estimators.chain_mining(4)(g, 0, 9, 47))


def test_totals_of_chains_in_a_large_graph_with_a_crooked_number_of_edges(spark):
    """At 60 copies that share vertices (71,652,679 edges) the sum of the products themselves is one above the SQL's."""
    table = [(i, 71_652_679.0 * (101 + i % 97) * (211 + i % 89)) for i in range(8000)]
    ours = estimators.summary(spark.createDataFrame(table, "est long, inv_p double"), 20_000).first()
    con = duckdb.connect()
    con.execute("create table f as select i as est, 71652679::double * (101 + i % 97) * (211 + i % 89) as inv_p from range(8000) t(i)")
    assert tuple(ours) == con.execute(catalogue.summed("f", 20_000)).fetchone()
    assert ours.total < sum(int(p) for _, p in table)
