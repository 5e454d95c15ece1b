"""Exact counts: closed forms over degrees, triangles and 4-cycles where there are any, else symmetry-broken joins that Catalyst orders and adaptive
execution balances. Triangles and 4-cycles (``local``) come from edges ordered by degree, so hubs make no quadratic join."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygraph.operators import local
from tallygraph.plans import pattern as patterns
from tallygraph.plans.graph import Graph
from tallygraph.plans.pattern import Pattern


def stars(graph: Graph, k: int, name: str) -> DataFrame:
    """Stars of k vertices: the sum over all centres of (degree over k - 1)."""
    deg, factorial = F.col("deg"), 1
    for i in range(2, k):
        factorial *= i
    # The product fits a long up to a degree of 2^(62 / (k - 1)); beyond it decimals take over.
    wide = F.lit(1).cast("decimal(38,0)")
    for i in range(k - 1):
        wide = (wide * (deg - i).cast("decimal(19,0)")).cast("decimal(38,0)")
    narrow = F.expr(f"({_falling('deg', k - 1)}) div {factorial}").cast("decimal(38,0)")
    exact = F.when(deg < int((2**62) ** (1 / (k - 1))), narrow).otherwise((wide / factorial).cast("decimal(38,0)"))
    return graph.degrees.where(deg >= k - 1).agg(F.coalesce(F.sum(exact), F.lit(0)).cast("long").alias(name))


def _falling(column: str, k: int) -> str:
    return " * ".join(f"({column} - {i})" for i in range(k))


def wedges(graph: Graph, name: str = "wedges") -> DataFrame:
    return graph.degrees.agg(F.coalesce(F.sum(F.expr("deg * (deg - 1) div 2")), F.lit(0)).cast("long").alias(name))


def triangles_of(graph: Graph) -> DataFrame:
    """(a, b, c) with a < b < c, and the weights of ab, ac, bc if there are any."""
    return local.triangles(graph.edges, graph.num_edges, True)


def triangles(graph: Graph, name: str = "triangles") -> DataFrame:
    return _number(graph, graph.blocks.triangles(), name)


def _number(graph: Graph, n: int, name: str) -> DataFrame:
    return graph.edges.sparkSession.range(1).select(F.lit(n).cast("long").alias(name))


def four_chains(graph: Graph, name: str = "four_chains") -> DataFrame:
    """Sum over the middle edge of (du - 1)(dv - 1), less the three closed walks of each triangle."""
    d = graph.degrees
    ends = graph.edges.join(d.select(F.col("u").alias("src"), F.col("deg").alias("ds")), "src").join(d.select(F.col("u").alias("dst"), F.col("deg").alias("dd")), "dst")
    walks = ends.agg(F.coalesce(F.sum(F.expr("(ds - 1) * (dd - 1)")), F.lit(0)).alias("walks"))
    return walks.crossJoin(triangles(graph, "t")).select((F.col("walks") - 3 * F.col("t")).cast("long").alias(name))  # two one-row tables


def matches(graph: Graph, pattern: Pattern) -> DataFrame:
    """One row (v0, ..., v{k-1}) for each instance: each pattern edge is an equi-join with the adjacency, symmetry-breaking and all-different
    conditions are applied as soon as their vertices are bound."""
    breaks, k = pattern.symmetry_breaks(), pattern.size
    order, left = [0], set(range(1, k))
    near = lambda v: [w for a, b in pattern.edges for w in ((b,) if a == v else (a,) if b == v else ())]
    order[0] = max(range(k), key=lambda v: (len(near(v)), -v))
    left = set(range(k)) - {order[0]}
    while left:
        nxt = max(left, key=lambda v: (sum(w in order for w in near(v)), len(near(v)), -v))
        order.append(nxt)
        left.remove(nxt)
    walk = graph.directed.select("u", "v")
    rows = None
    for at, v in enumerate(order):
        if at == 0:
            continue
        bound = order[:at]
        back = [w for w in near(v) if w in bound]
        if rows is None:
            rows = walk.select(F.col("u").alias(f"v{order[0]}"), F.col("v").alias(f"v{v}"))
        else:
            rows = rows.join(walk.select(F.col("u").alias(f"v{back[0]}"), F.col("v").alias(f"v{v}")), f"v{back[0]}")
        for w in bound:
            if w not in back:
                rows = rows.where(F.col(f"v{v}") != F.col(f"v{w}"))
            if (w, v) in breaks:
                rows = rows.where(F.col(f"v{w}") < F.col(f"v{v}"))
            if (v, w) in breaks:
                rows = rows.where(F.col(f"v{v}") < F.col(f"v{w}"))
        for w in back[1:]:
            rows = rows.join(walk.select(F.col("u").alias(f"v{w}"), F.col("v").alias(f"v{v}")), [f"v{w}", f"v{v}"], "left_semi")
    return rows.select(*(f"v{i}" for i in range(k)))


def _total(column: Column | str) -> Column:
    return F.coalesce(F.sum((F.expr(column) if isinstance(column, str) else column).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")


def four_cycles(graph: Graph, name: str = "four_cycles") -> DataFrame:
    return _number(graph, graph.blocks.four_cycles(), name)


def four_cliques(graph: Graph, name: str = "four_cliques") -> DataFrame:
    return _number(graph, graph.blocks.four_cliques(), name)


def five_chains(graph: Graph, name: str = "five_chains") -> DataFrame:
    """Pairs of extensions of each middle vertex's two neighbours, less those that meet: in the other neighbour (triangles) or in one vertex (4-cycles)."""
    blocks = graph.blocks
    s, q = F.col("s").cast("decimal(19,0)"), F.col("q").cast("decimal(38,0)")
    pairs = blocks.near_sums().agg((_total((s * s).cast("decimal(38,0)") - q) / 2).cast("decimal(38,0)").alias("pairs"))
    inner = triangles_per_vertex(graph).join(blocks.degrees(), "v").agg(_total("triangles * (2 * deg - 3)").alias("inner"))
    # one row each
    return pairs.crossJoin(inner).crossJoin(four_cycles(graph, "cycles")).select((F.col("pairs") - F.col("inner") - 4 * F.col("cycles")).cast("long").alias(name))


def five_houses(graph: Graph, name: str = "five_houses") -> DataFrame:
    return _number(graph, graph.blocks.five_houses(), name)


def same(pattern: Pattern, other: Pattern) -> bool:
    """Whether two patterns of few vertices are the same but for the names of the vertices."""
    if pattern.size != other.size or len(pattern.edges) != len(other.edges):
        return False
    there = {frozenset(e) for e in other.edges}
    return any({frozenset((p[a], p[b])) for a, b in pattern.edges} == there for p in permutations(range(pattern.size)))


def count(graph: Graph, pattern: Pattern, name: str = "instances") -> DataFrame:
    """Non-induced instances: by a closed form where there is one, else by joins."""
    degrees = sorted(sum(v in e for e in pattern.edges) for v in range(pattern.size))
    if pattern.size >= 3 and degrees == [1] * (pattern.size - 1) + [pattern.size - 1]:
        return stars(graph, pattern.size, name)
    known = ((patterns.TRIANGLE, triangles), (patterns.FOUR_CHAIN, four_chains), (patterns.cycle(4), four_cycles), (patterns.FOUR_CLIQUE, four_cliques), (patterns.FIVE_CHAIN, five_chains), (patterns.HOUSE, five_houses))
    for other, closed in known if pattern.size <= 5 else ():
        if same(pattern, other):
            return closed(graph, name)
    return matches(graph, pattern).agg(F.count(F.lit(1)).alias(name))


def three_motifs(graph: Graph) -> DataFrame:
    """(wedges, triangles, induced_wedges) in one row."""
    both = _number(graph, graph.blocks.wedges(), "wedges").withColumn("triangles", F.lit(graph.blocks.triangles()).cast("long"))
    return both.withColumn("induced_wedges", F.col("wedges") - 3 * F.col("triangles"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    """(v, triangles) for vertices in any."""
    return graph.blocks.triangles_per_vertex()


def weighted_triangles(graph: Graph, predicate: Column | str, every: bool, name: str) -> DataFrame:
    """Triangles of which all edges (``every``) or at least one satisfy ``predicate``, an expression of ``weight``.

    For all, the edges are filtered before the triangles are looked for; for at least one, an edge's weight is whether it satisfies it."""
    if every:
        return triangles(graph.filter(predicate), name)
    predicate = F.expr(predicate) if isinstance(predicate, str) else predicate
    marked = graph.edges.withColumn("weight", F.coalesce(predicate, F.lit(False)).cast("long"))
    return matching_triangles(Graph(marked, graph), "w_ab + w_ac + w_bc > 0", name)


def matching_triangles(graph: Graph, predicate: Column | str, name: str) -> DataFrame:
    """Triangles for which a predicate over the match holds: columns a, b, c, w_ab, w_ac, w_bc."""
    return triangles_of(graph).where(predicate).agg(F.count(F.lit(1)).alias(name))
