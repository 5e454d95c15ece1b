"""Unbiased estimators of pattern counts by neighbourhood sampling.

Each gives a table of the successful estimators, (est, inv_p); ``summary`` turns it into (n, successes, total, estimate). Inverse probabilities are
products of integers, halved for edges drawn twice as often, and are summed as whole millionths of a double: the order of rows does not matter. Above
2^53 millionths each is rounded to a double, as the SQL's cast to decimals does, so a large total may end one below the sum of the products.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygraph.functions import rng
from tallygraph.functions.lineage import cut
from tallygraph.operators import sampling
from tallygraph.plans.graph import Graph
from tallygraph.plans.pattern import Pattern

MONEY = "decimal(38,6)"


@dataclass(frozen=True)
class Estimation:
    """A running mean of n estimators."""

    n: int = 0
    mean: float = 0.0

    def update(self, n: int, mean: float) -> Estimation:
        total = self.n + n
        return Estimation(total, (self.mean * self.n + mean * n) / total) if total else self


Successes = Callable[[Graph, int, int, int], DataFrame]


def whole_total(inv_p: Column | str = "inv_p") -> Column:
    """The sum, rounded down, of doubles in millionths; each is split at 2^40, so that its decimal has the very digits of the double."""
    millionths = F.round((F.col(inv_p) if isinstance(inv_p, str) else inv_p) * F.lit(1e6))
    high = F.floor(millionths / F.lit(float(1 << 40)))
    low = millionths - high.cast("double") * F.lit(float(1 << 40))
    term = (high.cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)") + low.cast("long").cast("decimal(13,0)")).cast("decimal(38,0)")
    total = F.coalesce(F.sum(term), F.lit(0).cast("decimal(38,0)"))
    return F.floor(total.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """As the SQL's round: of the product with a power of ten."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def summary(successes: DataFrame, n: int, scale: float = 1.0) -> DataFrame:
    """One row: n, successes, total (of the inverse probabilities, rounded down), estimate."""
    found = successes.agg(F.count(F.lit(1)).alias("successes"), whole_total().alias("total"))
    return found.select(F.lit(n).cast("long").alias("n"), "successes", "total", rounded(F.col("total") * F.lit(float(scale)) / F.lit(float(n)), 3).alias("estimate"))


def calculate(graph: Graph, estimator: Successes, n: int, seed: int, start: Estimation | None = None, scale: float = 1.0) -> Estimation:
    """Continue ``start`` until n estimators are done; only the missing ones run, with ids of their own."""
    start = start or Estimation()
    if start.n >= n:
        return start
    row = estimator(graph, start.n, n - start.n, seed).agg(F.coalesce(F.sum(F.col("inv_p").cast(MONEY)), F.lit(0))).first()
    return start.update(n - start.n, float(row[0]) * scale / (n - start.n))


def worker_factor(workers: int, pattern_size: int) -> float:
    """By how much a count within workers is to be scaled when edges between workers are left out."""
    return float(workers) ** (pattern_size - 1)


def wedge(graph: Graph, first: int, n: int, seed: int) -> DataFrame:
    began, adjacency = sampling.placed_edge(sampling.estimators(graph.edges.sparkSession, first, n), graph, seed)
    return sampling.first_extension(began, adjacency, seed)


def triangle(graph: Graph, first: int, n: int, seed: int) -> DataFrame:
    """A wedge whose third edge arrived last."""
    return close_triangles(wedge(graph, first, n, seed), graph)


def close_triangles(wedges: DataFrame, graph: Graph) -> DataFrame:
    other = F.when(F.col("u1") == F.col("src"), F.col("dst")).otherwise(F.col("src"))
    return sampling.close(wedges, graph.edges, other, F.col("v1"), F.col("id1"))


def four_chain(graph: Graph, first: int, n: int, seed: int) -> DataFrame:
    """Each estimator takes one of three arrival orders along the chain, with equal chances.

    1: each edge extends the last one. 2: the end grows again, but the third edge arrived before the second. 3: the first edge is in the middle."""
    ids = sampling.estimators(graph.edges.sparkSession, first, n).withColumn("kind", rng.integer(1, 3, seed, "est", 9))
    began, adjacency = sampling.placed_edge(ids, graph, seed)
    began = began.withColumn("inv_p", F.col("inv_p") * 3)
    outer = cut(sampling.first_extension(began.where("kind < 3"), adjacency, seed))
    neighbours = sampling.neighbours_of(graph, outer.select(F.col("v1").alias("u")))
    bound = F.when(F.col("kind") == 1, F.col("id1")).otherwise(F.col("edge_id"))
    grown = sampling.conditional_edge(outer, neighbours, bound, F.array("v1"), seed, 2).withColumn("inv_p", F.col("inv_p") * F.col("s"))
    free = ~F.col("new_src").isin(F.col("src"), F.col("dst")) & ~F.col("new_dst").isin(F.col("src"), F.col("dst"))
    grown = grown.where(free & ((F.col("kind") == 1) | (F.col("new_id") < F.col("id1")))).select("est", "inv_p")
    left = sampling.first_extension(began.where("kind = 3"), adjacency, seed, 1, ("src",)).withColumnsRenamed({"v1": "va", "u1": "ua", "id1": "ida"})
    right = sampling.first_extension(left, adjacency, seed, 2, ("dst",)).where("v1 <> va").select("est", "inv_p")
    return grown.unionByName(right)


def _started(graph: Graph, first: int, n: int, seed: int) -> DataFrame:
    began = sampling.sample_edge(sampling.estimators(graph.edges.sparkSession, first, n), graph.edges.select("edge_id", "src", "dst"), graph.num_edges, seed)
    edge = F.struct(F.col("edge_id").alias("id"), "src", "dst")
    return began.select("est", F.col("edge_id").alias("e0"), F.array(edge).alias("met"), F.array("src", "dst").alias("verts"), "inv_p")


def _grow(walkers: DataFrame, neighbours: DataFrame, vertices: Column, seed: int, step: int) -> DataFrame:
    """One more edge after e0, canonical and new; ``verts`` takes up a new end."""
    drawn = sampling.conditional_edge(walkers, neighbours, F.col("e0"), vertices, seed, step)
    fresh = F.struct(F.col("new_id").alias("id"), F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    touches = lambda e: e["src"].isin(F.col("new_src"), F.col("new_dst")) | e["dst"].isin(F.col("new_src"), F.col("new_dst"))
    state = F.aggregate("met", F.struct(F.lit(False).alias("seen"), F.lit(True).alias("ok")), lambda a, e: F.struct((a["seen"] | touches(e)).alias("seen"), (a["ok"] & (~a["seen"] | (e["id"] < F.col("new_id")))).alias("ok")))
    drawn = drawn.where(state["ok"] & ~F.exists("met", lambda e: e["id"] == F.col("new_id")))
    return drawn.select(
        *[c for c in walkers.columns if c not in ("met", "verts", "inv_p")],
        F.array_append("met", fresh).alias("met"),
        F.array_union("verts", F.array("new_src", "new_dst")).alias("verts"),
        (F.col("inv_p") * F.col("s") / F.col("times")).alias("inv_p"),
        "new_src",
        "new_dst",
    )


def generated(pattern: Pattern, predicate: Column | str | None = None) -> Successes:
    """The estimator of any connected pattern: e0, then edges that touch what is there and arrived after e0, in the one accepted order of each
    instance. ``predicate`` is an expression over met (array of id, src, dst) and verts."""

    def run(graph: Graph, first: int, n: int, seed: int) -> DataFrame:
        walkers, neighbours = _started(graph, first, n, seed), cut(graph.neighbours)
        for step in range(1, len(pattern.edges)):
            walkers = _grow(cut(walkers), neighbours, F.col("verts"), seed, step).drop("new_src", "new_dst").where(F.size("verts") <= pattern.size)
        walkers = walkers.where(F.size("verts") == pattern.size)
        ranked = F.array_sort("verts")
        place = lambda v: F.array_position(ranked, v) - 1
        code = lambda e: F.least(place(e["src"]), place(e["dst"])) * pattern.size + F.greatest(place(e["src"]), place(e["dst"]))
        signature = F.array_join(F.array_sort(F.transform("met", code)), ",")
        forms = [",".join(map(str, sorted(a * pattern.size + b for a, b in f))) for f in pattern.forms]
        found = walkers.where(signature.isin(forms))
        return found.where(predicate) if predicate is not None else found

    return run


def chain_mining(order: int) -> Successes:
    """Chains of ``order`` vertices that grow at either end; a walk that closes a cycle ends. Neighbours are found for the ends of the walks alone."""

    def run(graph: Graph, first: int, n: int, seed: int) -> DataFrame:
        walkers = _started(graph, first, n, seed).withColumn("ends", F.col("verts"))
        for step in range(1, order - 1):
            walkers = cut(walkers)
            neighbours = cut(sampling.neighbours_of(graph, walkers.select(F.explode("ends").alias("u"))))
            grown = _grow(walkers, neighbours, F.col("ends"), seed, step).where(F.size("verts") == step + 2)
            a, b = F.col("ends")[0], F.col("ends")[1]
            x, y = F.col("new_src"), F.col("new_dst")
            new = F.when(a == x, F.array(y, b)).when(a == y, F.array(x, b)).when(b == x, F.array(a, y)).otherwise(F.array(a, x))
            walkers = grown.withColumn("ends", new).drop("new_src", "new_dst")
        return walkers

    return run


def three_motif_cached(graph: Graph, n_wedges: int, n_triangles: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(wedge successes, triangle successes): the triangle estimators continue the wedges that are there, and sample afresh above their number."""
    wedges = wedge(graph, 0, n_wedges, seed).persist()
    kept = close_triangles(wedges.where(F.col("est") < n_triangles), graph)
    if n_triangles > n_wedges:
        kept = kept.unionByName(triangle(graph, n_wedges, n_triangles - n_wedges, seed))
    return wedges, kept


def running(successes: DataFrame, n: int, batch: int) -> DataFrame:
    """(batch_no, done, total): the running sum after each batch of estimators, batches without success included."""
    spark = successes.sparkSession
    sums = successes.groupBy(F.floor(F.col("est") / batch).cast("long").alias("batch_no")).agg(whole_total().alias("part"))
    every = spark.range(-(-n // batch)).withColumnRenamed("id", "batch_no").join(sums, "batch_no", "left")
    upto = Window.orderBy("batch_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a batch
    done = F.least(F.lit(n), (F.col("batch_no") + 1) * batch).cast("long")
    return every.select("batch_no", done.alias("done"), F.sum(F.coalesce("part", F.lit(0))).over(upto).cast("long").alias("total"))


def merge(parts: DataFrame) -> DataFrame:
    """(n, mean) of many partial estimations (n, mean): the mean weighted by n."""
    return parts.agg(F.sum("n").cast("long").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))


def weighted_triangle(graph: Graph, predicate: Column | str, every: bool, n: int, seed: int) -> DataFrame:
    """The summary for triangles all of whose edges satisfy ``predicate``, or at least one: then all triangles less those of the other edges, with half
    of the estimators each."""
    predicate = F.expr(predicate) if isinstance(predicate, str) else predicate
    if every:
        part = graph.filter(predicate).reindexed().persist()
        return summary(triangle(part, 0, n, seed), n)
    others = graph.filter(~F.coalesce(predicate, F.lit(False))).reindexed().persist()
    half = max(1, n // 2)
    a, b = summary(triangle(graph, 0, half, seed), half), summary(triangle(others, 0, half, seed + 1), half)
    both = a.select(F.col("total").alias("t"), F.col("successes").alias("x")).crossJoin(b.select(F.col("total").alias("o"), F.col("successes").alias("y")))  # one row each
    total = F.col("t") - F.col("o")
    return both.select(F.lit(n).cast("long").alias("n"), (F.col("x") + F.col("y")).alias("successes"), total.alias("total"), rounded(total / F.lit(float(half)), 3).alias("estimate"))
