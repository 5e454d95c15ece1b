"""Counts from induced subgraphs of sampled vertices, in replicates, and rules for when there are enough."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygraph.functions import ranks, rng
from tallygraph.plans.graph import Graph

LEAST, MOST = 10, 10_000


def normal_quantile(alpha: float) -> float:
    """What a standard normal number exceeds with probability alpha / 2, to three decimals."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must be between 0 and 1, not {alpha}")
    return round(NormalDist().inv_cdf(1 - alpha / 2), 3)


def allocation(storages: int, balls: int, replicates: int, seed: int, spark) -> DataFrame:
    """(rep, storage, m): how many of ``balls`` draws fall to each storage."""
    drawn = spark.range(replicates).withColumnRenamed("id", "rep").withColumn("ball", F.explode(F.sequence(F.lit(0), F.lit(balls - 1))))
    return drawn.groupBy("rep", rng.below(storages, seed, "rep", "ball").alias("storage")).agg(F.count(F.lit(1)).alias("m"))


def sampled_vertices(graph: Graph, m: int, replicates: int, seed: int, first: int = 0) -> DataFrame:
    """(rep, v): m vertices without replacement for each replicate from ``first`` on; all of them where there are fewer.

    The m smallest draws of a replicate are found among those below a cut that keeps about twice as many. So a replicate's task ranks about 2 m rows, not all
    vertices. A count tells whether every replicate has m draws below the cut; if not, which is rare, all are ranked."""
    reps = graph.edges.sparkSession.range(first, first + replicates).withColumnRenamed("id", "rep")
    vertices = graph.vertices()
    drawn = vertices.join(F.broadcast(reps)).withColumn("r", rng.draw(seed, "rep", "v"))  # a row a replicate
    total, likely = vertices.count(), 2 * m + 40
    if likely < total:
        below = drawn.where(F.col("r") < F.lit(rng.SPAN * likely // total))
        if below.groupBy("rep").count().where(F.col("count") >= m).count() == replicates:
            drawn = below
    return drawn.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("r", "v"))).where(F.col("n") <= m).select("rep", "v")


def storage_sample(graph: Graph, storages: int, balls: int, replicates: int, seed: int) -> DataFrame:
    """(rep, v): each storage (ranges of dense vertex ids) gives as many vertices as draws fell to it, at most all that it has."""
    spark = graph.edges.sparkSession
    dense = ranks.value_rank(graph.vertices(), "v", "at")
    count = dense.count()
    held = dense.withColumn("storage", F.floor(F.col("at") * storages / F.lit(max(1, count))).cast("long"))
    asked = allocation(storages, balls, replicates, seed, spark)
    drawn = held.join(asked, "storage").withColumn("r", rng.draw(seed, "rep", "v"))
    return drawn.withColumn("n", F.row_number().over(Window.partitionBy("rep", "storage").orderBy("r", "v"))).where("n <= m").select("rep", "v")


def induced(graph: Graph, sample: DataFrame) -> DataFrame:
    """(rep, src, dst): edges of which both ends are in the replicate's sample."""
    a, b = sample.select("rep", F.col("v").alias("src")), sample.select("rep", F.col("v").alias("dst"))
    return graph.edges.select("src", "dst").join(a, "src").join(b, ["rep", "dst"]).select("rep", "src", "dst")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("rep", F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select("rep", F.col("dst").alias("u"), F.col("src").alias("v")))


def found_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rep").agg(F.count(F.lit(1)).alias("found"))


def found_triangles(edges: DataFrame) -> DataFrame:
    a = edges.select("rep", F.col("src").alias("x"), F.col("dst").alias("y"))
    b = edges.select("rep", F.col("src").alias("y"), F.col("dst").alias("z"))
    c = edges.select("rep", F.col("src").alias("x"), F.col("dst").alias("z"))
    return a.join(b, ["rep", "y"]).join(c, ["rep", "x", "z"]).groupBy("rep").agg(F.count(F.lit(1)).alias("found"))


def _stars(edges: DataFrame, leaves: int) -> DataFrame:
    deg = _both(edges).groupBy("rep", "u").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") >= leaves)
    product = " * ".join(f"(deg - {i})" for i in range(leaves))
    return deg.groupBy("rep").agg(F.sum(F.expr(f"({product}) div {math.factorial(leaves)}")).cast("long").alias("found"))


def found_wedges(edges: DataFrame) -> DataFrame:
    return _stars(edges, 2)


def found_five_stars(edges: DataFrame) -> DataFrame:
    return _stars(edges, 4)


def found_three_motifs(edges: DataFrame) -> DataFrame:
    return found_wedges(edges).unionByName(found_triangles(edges)).groupBy("rep").agg(F.sum("found").cast("long").alias("found"))


def found_four_chains(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    middle = edges.select("rep", F.col("src").alias("b"), F.col("dst").alias("c"))
    left, right = both.select("rep", F.col("u").alias("b"), F.col("v").alias("a")), both.select("rep", F.col("u").alias("c"), F.col("v").alias("d"))
    walks = middle.join(left, ["rep", "b"]).join(right, ["rep", "c"]).where("a <> c and b <> d and a <> d")
    return walks.groupBy("rep").agg(F.count(F.lit(1)).alias("found"))


SIZES = {"edges": 2, "triangle": 3, "wedge": 3, "three_motif": 3, "four_chain": 4, "five_star": 5}
COUNTS = {"edges": found_edges, "triangle": found_triangles, "wedge": found_wedges, "three_motif": found_three_motifs, "four_chain": found_four_chains, "five_star": found_five_stars}


def estimates(graph: Graph, task: str, m: int, replicates: int, seed: int, first: int = 0) -> DataFrame:
    """(rep, found, estimate) for each replicate from ``first`` on: the count in each replicate's induced subgraph over (m / V) to the pattern's number of vertices."""
    total = graph.vertices().count()
    part = min(1.0, m / total) if total else 1.0
    reps = graph.edges.sparkSession.range(first, first + replicates).withColumnRenamed("id", "rep")
    found = COUNTS[task](induced(graph, sampled_vertices(graph, m, replicates, seed, first)))
    return reps.join(found, "rep", "left").select("rep", F.coalesce("found", F.lit(0)).alias("found"), F.round(F.coalesce("found", F.lit(0)) / F.lit(part ** SIZES[task]), 3).alias("estimate"))


def drawn_in_batches(graph: Graph, task: str, m: int, seed: int, batch: int = LEAST, most: int = MOST) -> Iterator[float]:
    """The estimates of replicate after replicate, at most ``most``. A batch is drawn when its first one is asked for, so a stopping rule that reads this
    draws no batch that it does not need: ``interval_stop(drawn_in_batches(...))``."""
    for first in range(0, most, batch):
        rows = estimates(graph, task, m, min(batch, most - first), seed, first).orderBy("rep").select("estimate").collect()  # a number a replicate
        yield from (row.estimate for row in rows)


def interval_rule(values: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(t, mean, sd, stop): after each replicate, whether the normal interval is within delta of the mean (and t is at least LEAST)."""
    z = normal_quantile(alpha)
    upto = Window.orderBy("rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # MOST rows
    v = values.where(F.col("rep") < MOST)
    v = v.select("rep", F.count(F.lit(1)).over(upto).alias("t"), F.avg("estimate").over(upto).alias("mean"), F.stddev_pop("estimate").over(upto).alias("sd"))
    stop = (F.col("t") >= LEAST) & (F.col("mean") > 0) & (F.lit(z) * F.col("sd") <= F.lit(delta) * F.sqrt("t") * F.col("mean"))
    return v.select("t", "mean", "sd", stop.alias("stop"))


def interval_stop(values: Iterable[float], alpha: float = 0.05, delta: float = 0.05) -> tuple[int, float]:
    """(t, mean) when the rule stops, or at the last value."""
    z, n, mean, m2 = normal_quantile(alpha), 0, 0.0, 0.0
    for x in values:
        n += 1
        step = x - mean
        mean += step / n
        m2 += step * (x - mean)
        if n >= LEAST and mean > 0 and z * math.sqrt(m2 / n) <= delta * math.sqrt(n) * mean or n >= MOST:
            break
    return n, mean


def bernstein_stop(values: Iterable[float], top: float, epsilon: float = 0.1, delta: float = 0.05, p: float = 1.1) -> tuple[int, float]:
    """(t, estimate) by empirical Bernstein stopping (Mnih, Szepesvari, Audibert 2008); ``top`` is the range of the values."""
    n, mean, m2, low, high = 0, 0.0, 0.0, 0.0, math.inf
    for x in values:
        n += 1
        step = x - mean
        mean += step / n
        m2 += step * (x - mean)
        share = delta * (p - 1) / p / n**p
        term = math.log(3 / share)
        width = math.sqrt(m2 / n) * math.sqrt(2 * term / n) + 3 * top * term / n
        low, high = max(low, abs(mean) - width), min(high, abs(mean) + width)
        if n > 1 and (1 + epsilon) * low >= (1 - epsilon) * high:
            break
    return n, math.copysign(((1 + epsilon) * low + (1 - epsilon) * high) / 2, mean) if high < math.inf else mean
