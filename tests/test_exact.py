import pytest

from tallygraph.operators import exact
from tallygraph.plans import pattern
from tallygraph.plans.graph import Graph
from tests.graphs import SIMPLE_5, SMALL_10, count, random_edges

# triangle, wedge, 4-chain, 5-chain, 5-star, 4-clique, house
GOLDEN = {"simple-5": (SIMPLE_5, (0, 6, 6, 2, 0, 0, 0)), "small-10": (SMALL_10, (2, 28, 54, 83, 3, 0, 5))}
PATTERNS = (pattern.TRIANGLE, pattern.WEDGE, pattern.FOUR_CHAIN, pattern.FIVE_CHAIN, pattern.FIVE_STAR, pattern.FOUR_CLIQUE, pattern.HOUSE)


def make(spark, edges, weights=False):
    rows = [(a, b, (a * 7 + b * 13) % 79) if weights else (a, b) for a, b in edges]
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long" + (", weight long" if weights else "")))


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_counts(spark, name):
    edges, expected = GOLDEN[name]
    g = make(spark, edges).persist()
    assert tuple(exact.count(g, p).first()[0] for p in PATTERNS) == expected


def test_against_brute_force(spark):
    edges = random_edges(8, 17, 3)
    g = make(spark, edges).persist()
    for p in (*PATTERNS, pattern.cycle(4), pattern.cycle(5), pattern.star(4)):
        assert exact.count(g, p).first()[0] == count(edges, p)


def test_labels_and_arrival_order_do_not_matter(spark):
    g = make(spark, SMALL_10)
    assert exact.triangles(g.permuted(9)).first()[0] == 2
    assert exact.four_chains(Graph.from_edges(g.edges.drop("edge_id"), 1234)).first()[0] == 54


def test_empty_graph_counts_nothing(spark):
    g = make(spark, [])
    assert [exact.count(g, p).first()[0] for p in (pattern.TRIANGLE, pattern.WEDGE, pattern.FOUR_CHAIN, pattern.FIVE_STAR, pattern.FOUR_CLIQUE)] == [0] * 5


def test_weighted_triangles(spark):
    edges = random_edges(12, 40, 5)
    g = make(spark, edges, True).persist()
    w = {frozenset((a, b)): (a * 7 + b * 13) % 79 for a, b in edges}
    tri = [(a, b, c) for a in range(12) for b in range(a) for c in range(b) if all(frozenset(x) in w for x in ((a, b), (a, c), (b, c)))]
    heavy = [[w[frozenset(x)] >= 50 for x in ((a, b), (a, c), (b, c))] for a, b, c in tri]
    assert exact.weighted_triangles(g, "weight >= 50", True, "n").first()[0] == sum(map(all, heavy))
    assert exact.weighted_triangles(g, "weight >= 50", False, "n").first()[0] == sum(map(any, heavy))
    rows = {(r.a, r.b, r.c): (r.w_ab, r.w_ac, r.w_bc) for r in exact.triangles_of(g).collect()}
    assert rows == {tuple(sorted(t)): tuple(w[frozenset(x)] for x in ((sorted(t)[0], sorted(t)[1]), (sorted(t)[0], sorted(t)[2]), (sorted(t)[1], sorted(t)[2]))) for t in tri}


def test_motifs_and_triangles_per_vertex(spark):
    row = exact.three_motifs(make(spark, SMALL_10)).first()
    assert tuple(row) == (28, 2, 22)
    per = {r.v: r.triangles for r in exact.triangles_per_vertex(make(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (0, 3)])).collect()}
    assert per == {0: 2, 1: 1, 2: 2, 3: 1}
