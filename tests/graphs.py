"""Small graphs and brute-force counts."""

from __future__ import annotations

import itertools
import random

SIMPLE_5 = [(2, 4), (3, 4), (2, 0), (1, 0), (1, 4)]
SMALL_10 = [(0, 1), (1, 2), (0, 2), (0, 7), (7, 8), (8, 1), (0, 5), (2, 6), (5, 6), (1, 3), (2, 4), (3, 4), (4, 6)]


def random_edges(n: int, m: int, seed: int) -> list[tuple[int, int]]:
    pairs = list(itertools.combinations(range(n), 2))
    return random.Random(seed).sample(pairs, m)


def count(edges, pattern) -> int:
    """Edge subsets isomorphic to the pattern."""
    have = {frozenset(e) for e in edges}
    vertices = sorted({v for e in edges for v in e})
    found = set()
    for chosen in itertools.permutations(vertices, pattern.size):
        image = frozenset(frozenset((chosen[a], chosen[b])) for a, b in pattern.edges)
        if image <= have:
            found.add(image)
    return len(found)
