import itertools

import pytest

from tallygraph.plans import pattern
from tallygraph.plans.pattern import Pattern


@pytest.mark.parametrize(("p", "forms"), [(pattern.TRIANGLE, 1), (pattern.FOUR_CHAIN, 12), (pattern.FOUR_CLIQUE, 1), (pattern.FIVE_STAR, 5), (pattern.FIVE_CHAIN, 60), (pattern.HOUSE, 60)])
def test_distinct_labelled_forms(p, forms):
    assert len(p.forms) == forms
    assert forms * len(p.automorphisms) == len(list(itertools.permutations(range(p.size))))


@pytest.mark.parametrize("p", [pattern.WEDGE, pattern.TRIANGLE, pattern.FOUR_CHAIN, pattern.FOUR_CLIQUE, pattern.FIVE_STAR, pattern.FIVE_CHAIN, pattern.HOUSE])
def test_each_arrival_order_has_one_accepted_walk(p):
    """Whatever order the edges of an instance arrive in, one order of meeting them is accepted."""
    for labels in itertools.permutations(range(len(p.edges))):
        arrived = Pattern.__new__(Pattern)
        edges = [None] * len(p.edges)
        for e, at in zip(p.edges, labels, strict=True):
            edges[at] = e
        object.__setattr__(arrived, "edges", tuple(edges))
        assert len(arrived.accepted_orders()) == 1


def test_labelled_equality_and_isomorphism():
    a, b = Pattern(((0, 1), (1, 2))), Pattern(((1, 0), (0, 2)))
    assert not a.same_as(b)
    assert a.isomorphic(b)
    assert not a.isomorphic(pattern.TRIANGLE)


def test_bad_patterns_are_refused():
    for edges in ([(0, 0)], [(0, 1), (1, 0)], [(0, 2)]):
        with pytest.raises(ValueError):
            Pattern(tuple(edges))
