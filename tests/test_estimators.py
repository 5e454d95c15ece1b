import itertools

import pytest

from tallygraph.operators import estimators, exact
from tallygraph.operators.estimators import Estimation
from tallygraph.plans import pattern
from tallygraph.plans.graph import Graph
from tests.graphs import random_edges


@pytest.fixture(scope="module")
def small(spark):
    return Graph.from_edges(spark.createDataFrame(random_edges(12, 34, 2), "src long, dst long")).persist()


CASES = [
    (estimators.wedge, pattern.WEDGE), (estimators.triangle, pattern.TRIANGLE), (estimators.four_chain, pattern.FOUR_CHAIN), (estimators.generated(pattern.TRIANGLE), pattern.TRIANGLE),
    (estimators.generated(pattern.FIVE_STAR), pattern.FIVE_STAR), (estimators.chain_mining(4), pattern.FOUR_CHAIN),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_estimates_are_near_the_count(small, case):
    estimator, p = CASES[case]
    n = 20_000
    rows = estimator(small, 0, n, 5).select("inv_p").toPandas().inv_p
    mean, sd = rows.sum() / n, ((rows**2).sum() / n - (rows.sum() / n) ** 2) ** 0.5
    assert abs(mean - exact.count(small, p).first()[0]) < 4 * sd / n**0.5


def test_no_walk_of_the_generic_estimator_is_lost_or_doubled(spark):
    """On a clique of four, all walks together have the exact expectation."""
    from tallygraph.plans.pattern import canonical

    edges = {e: pair for e, pair in enumerate(itertools.combinations(range(4), 2))}

    def expected(met, verts, p, left):
        if not left:
            return 1 if len(verts) == 4 else 0
        pool = [e for v in verts for e, pair in edges.items() if v in pair and e > met[0][0]]
        total = 0.0
        for e in set(pool):
            new = (e, *edges[e])
            if e in [m[0] for m in met] or not canonical(met, new) or len(verts | set(edges[e])) > 4:
                continue
            total += expected([*met, new], verts | set(edges[e]), p, left - 1)
        return total

    assert sum(expected([(e, *edges[e])], set(edges[e]), 1.0, 5) for e in edges) == 1


def test_resume_runs_only_what_is_missing(small):
    whole = estimators.calculate(small, estimators.wedge, 4000, 9)
    part = estimators.calculate(small, estimators.wedge, 1000, 9)
    again = estimators.calculate(small, estimators.wedge, 4000, 9, part)
    assert again.n == 4000 and abs(again.mean - whole.mean) < 1e-6
    assert estimators.calculate(small, estimators.wedge, 500, 9, part) is part
    assert Estimation().update(0, 3.0) == Estimation()


def test_cache_gives_what_a_fresh_run_gives(small):
    _, cached = estimators.three_motif_cached(small, 1000, 2500, 4)
    fresh = estimators.triangle(small, 0, 2500, 4)
    key = lambda d: sorted((r.est, r.inv_p) for r in d.select("est", "inv_p").collect())
    assert key(cached) == key(fresh)


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert estimators.summary(estimators.triangle(g, 0, 10, 1), 10).first().estimate == 0
