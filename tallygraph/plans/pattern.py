"""Small patterns: their symmetries, and the orders in which their edges can be met."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import permutations


def _pair(a: int, b: int) -> tuple[int, int]:
    return (a, b) if a < b else (b, a)


@dataclass(frozen=True)
class Pattern:
    """A connected graph on the vertices 0 to k - 1."""

    edges: tuple[tuple[int, int], ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "edges", tuple(_pair(a, b) for a, b in self.edges))
        if any(a == b for a, b in self.edges) or len(set(self.edges)) != len(self.edges):
            raise ValueError("a pattern has no self loops and no edge twice")
        if {v for e in self.edges for v in e} != set(range(self.size)):
            raise ValueError("a pattern's vertices are 0 to k - 1")

    @property
    def size(self) -> int:
        return max(v for e in self.edges for v in e) + 1

    @cached_property
    def forms(self) -> tuple[frozenset[tuple[int, int]], ...]:
        """The k! / |automorphisms| different edge sets that relabelling gives."""
        found = {frozenset(_pair(p[a], p[b]) for a, b in self.edges) for p in permutations(range(self.size))}
        return tuple(sorted(found, key=sorted))

    @cached_property
    def automorphisms(self) -> tuple[tuple[int, ...], ...]:
        own = frozenset(self.edges)
        return tuple(p for p in permutations(range(self.size)) if frozenset(_pair(p[a], p[b]) for a, b in self.edges) == own)

    def same_as(self, other: Pattern) -> bool:
        """Equal as labelled edge sets."""
        return self.size == other.size and frozenset(self.edges) == frozenset(other.edges)

    def isomorphic(self, other: Pattern) -> bool:
        return self.size == other.size and frozenset(other.edges) in self.forms

    def symmetry_breaks(self) -> tuple[tuple[int, int], ...]:
        """Pairs (a, b): with match[a] < match[b] for all of them, each instance is matched once.

        One vertex at a time is fixed: it must be the smallest of its orbit under the automorphisms that fix all before it."""
        left, out = list(self.automorphisms), []
        for v in range(self.size):
            orbit = {p[v] for p in left}
            out += [(v, w) for w in sorted(orbit) if w != v]
            left = [p for p in left if p[v] == v]
        return tuple(out)

    def accepted_orders(self) -> tuple[tuple[int, ...], ...]:
        """Edge orders in which a sampler meets one instance that arrives as 0, 1, 2, ...: the first edge first, and always a touching edge that is
        larger than all that follow the first one it touches. There is one for each arrival order."""
        out = []

        def go(order: tuple[int, ...]) -> None:
            if len(order) == len(self.edges):
                out.append(order)
                return
            for e in range(1, len(self.edges)):
                if e not in order and any(set(self.edges[e]) & set(self.edges[x]) for x in order) and canonical([(x, *self.edges[x]) for x in order], (e, *self.edges[e])):
                    go((*order, e))

        go((0,))
        return tuple(out)


def canonical(met: list[tuple[int, int, int]], new: tuple[int, int, int]) -> bool:
    """Whether ``new`` (edge_id, src, dst) may follow: past the first met edge that it touches, all met edges arrived before it."""
    touched = False
    for i, a, b in met:
        if touched and i >= new[0]:
            return False
        touched = touched or bool({a, b} & {new[1], new[2]})
    return True


def chain(k: int) -> Pattern:
    return Pattern(tuple((i, i + 1) for i in range(k - 1)))


def star(k: int) -> Pattern:
    """A centre and k - 1 leaves."""
    return Pattern(tuple((0, i) for i in range(1, k)))


def clique(k: int) -> Pattern:
    return Pattern(tuple((i, j) for i in range(k) for j in range(i + 1, k)))


def cycle(k: int) -> Pattern:
    return Pattern((*((i, i + 1) for i in range(k - 1)), (0, k - 1)))


WEDGE, TRIANGLE, FOUR_CHAIN, FOUR_CLIQUE, FIVE_STAR, FIVE_CHAIN = chain(3), clique(3), chain(4), clique(4), star(5), chain(5)
HOUSE = Pattern(((0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4)))
