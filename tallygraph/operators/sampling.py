"""Sampling steps as joins over a whole table of estimators.

A table of estimators has one row each that is still alive; one that fails leaves the table, and estimates divide by the number that began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygraph.functions import rng
from tallygraph.functions.lineage import cut
from tallygraph.plans.graph import Graph


#: Vertices up to this number are sent to all tasks.
BROADCAST_ROWS = 1_000_000


def estimators(spark: SparkSession, first: int, count: int) -> DataFrame:
    return spark.range(first, first + count).withColumnRenamed("id", "est")


def sample_vertex(ids: DataFrame, num_vertices: int, seed: int, step: int = 0) -> DataFrame:
    """(est, v, inv_p): v uniform in [0, V). Vertices are dense ids; nothing when there are none."""
    if num_vertices <= 0:
        return ids.where("false").select("est", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("inv_p"))
    return ids.select("est", rng.below(num_vertices, seed, "est", step).alias("v"), F.lit(num_vertices).cast("long").alias("inv_p"))


def conditional_vertex(sampled: DataFrame, num_vertices: int, seed: int, step: int = 1) -> DataFrame:
    """``sampled`` (est, v, inv_p) and w uniform in (v, V); estimators without such a vertex end."""
    room = F.lit(num_vertices) - 1 - F.col("v")
    return sampled.where(room > 0).select("est", "v", (F.col("v") + 1 + rng.below(room, seed, "est", step)).alias("w"), (F.col("inv_p") * room).alias("inv_p"))


def sample_edge(ids: DataFrame, edges: DataFrame, num_edges: int, seed: int, step: int = 0) -> DataFrame:
    """``ids`` with a uniform edge (all columns of ``edges``) and inv_p; edge ids are dense."""
    if num_edges <= 0:
        return ids.where("false").join(edges).withColumn("inv_p", F.lit(0).cast("double"))
    drawn = ids.withColumn("edge_id", rng.below(num_edges, seed, "est", step))
    return drawn.join(edges, "edge_id").withColumn("inv_p", F.lit(float(num_edges)))


def first_extension(sampled: DataFrame, adjacency: DataFrame, seed: int, step: int = 1, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """A second edge that touches the first (``placed`` columns) at one of ``ends`` and arrived later.

    Later neighbours of an end are those behind the first edge's own place, so the draw is a place and the lookup an equi-join on (u, pos).
    Adds id1, u1 (the shared end), v1 (the new one)."""
    free = {e: F.col(f"deg_{e}") - F.col(f"pos_{e}") - 1 for e in ends}
    total = sum(free.values(), F.lit(0))
    drawn = sampled.withColumn("__s", total).where("__s > 0").withColumn("__r", rng.below(F.col("__s"), seed, "est", step))
    if len(ends) == 2:
        here = F.col("__r") < free["src"]
        u = F.when(here, F.col("src")).otherwise(F.col("dst"))
        pos = F.when(here, F.col("pos_src") + 1 + F.col("__r")).otherwise(F.col("pos_dst") + 1 + F.col("__r") - free["src"])
    else:
        u, pos = F.col(ends[0]), F.col(f"pos_{ends[0]}") + 1 + F.col("__r")
    drawn = drawn.withColumn("u1", u).withColumn("__pos", pos).withColumn("inv_p", F.col("inv_p") * F.col("__s"))
    found = adjacency.select(F.col("u").alias("u1"), F.col("pos").alias("__pos"), F.col("v").alias("v1"), F.col("edge_id").alias("id1"))
    return drawn.join(found, ["u1", "__pos"]).drop("__s", "__r", "__pos")


def later(ids: Column, bound: Column) -> Column:
    """How many of a sorted array of structs have an edge_id above ``bound``."""
    return F.size(F.filter(ids, lambda n: n["edge_id"] > bound)).cast("long")


def conditional_edge(walkers: DataFrame, neighbours: DataFrame, bound: Column, vertices: Column, seed: int, step: int) -> DataFrame:
    """A uniform edge among those that touch ``vertices`` (an array) and arrived after ``bound``; one that touches two of them is drawn twice as
    often. Adds new_id, new_src, new_dst, and size and multiplicity of the draw as s and times. Walkers without a candidate end.

    Two lookups of neighbours per vertex: the first counts, the second fetches the one that was drawn."""
    slots = walkers.select("est", bound.alias("__b"), F.posexplode(vertices).alias("i", "u")).join(neighbours, "u")
    counts = slots.select("est", "__b", "i", "u", later(F.col("nbrs"), F.col("__b")).alias("n"), F.size("nbrs").alias("d")).where("n > 0")
    choice = counts.groupBy("est", "__b").agg(F.array_sort(F.collect_list(F.struct("i", "u", "n", "d"))).alias("c"), F.sum("n").alias("s"))
    choice = choice.withColumn("__r", rng.below(F.col("s"), seed, "est", step))
    start = F.struct(F.col("__r").alias("r"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("at"))
    pick = F.aggregate(
        "c",
        start,
        lambda a, x: F.when(a["u"].isNotNull(), a)
        .when(a["r"] < x["n"], F.struct(a["r"].alias("r"), x["u"].alias("u"), (x["d"] - x["n"] + a["r"]).cast("long").alias("at")))
        .otherwise(F.struct((a["r"] - x["n"]).alias("r"), a["u"].alias("u"), a["at"].alias("at"))),
    )
    chosen = choice.select("est", "s", pick.alias("p")).select("est", "s", F.col("p.u").alias("u"), F.col("p.at").alias("at"))
    got = chosen.join(neighbours, "u").select("est", "s", "u", F.element_at("nbrs", (F.col("at") + 1).cast("int")).alias("n"))
    got = got.select("est", "s", F.col("n.edge_id").alias("new_id"), F.least("u", "n.v").alias("new_src"), F.greatest("u", "n.v").alias("new_dst"))
    both = F.array_contains(vertices, F.col("new_src")) & F.array_contains(vertices, F.col("new_dst"))
    return walkers.join(got, "est").withColumn("times", F.when(both, F.lit(2)).otherwise(F.lit(1)))


def close(walkers: DataFrame, edges: DataFrame, a: Column, b: Column, bound: Column, name: str = "close_id") -> DataFrame:
    """Walkers for which the edge a-b exists and arrived after ``bound``; adds its id."""
    keyed = walkers.withColumn("__a", F.least(a, b)).withColumn("__b", F.greatest(a, b)).withColumn("__m", bound)
    found = edges.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.col("edge_id").alias(name))
    return keyed.join(found, ["__a", "__b"]).where(F.col(name) > F.col("__m")).drop("__a", "__b", "__m")


def subtract(a: Column, b: Column) -> Column:
    """Edges of array a (structs src, dst) that b lacks, direction aside."""
    plain = lambda e: F.transform(e, lambda x: F.struct(F.least(x["src"], x["dst"]).alias("src"), F.greatest(x["src"], x["dst"]).alias("dst")))
    return F.array_except(plain(a), plain(b))


def near(graph: Graph, vertices: DataFrame) -> DataFrame:
    """``graph.directed`` for the given vertices (u) alone: few of them are sent to all tasks, so the other edges are not shuffled."""
    vertices = cut(vertices.distinct())
    return graph.directed.join(F.broadcast(vertices) if vertices.count() <= BROADCAST_ROWS else vertices, "u", "left_semi")


def placed_edge(ids: DataFrame, graph: Graph, seed: int) -> tuple[DataFrame, DataFrame]:
    """``ids`` with a uniform edge and its ``placed`` columns, and the adjacency of the drawn edges' ends; places are found for these ends alone."""
    drawn = cut(sample_edge(ids, graph.edges, graph.num_edges, seed))
    found = near(graph, drawn.select(F.explode(F.array("src", "dst")).alias("u")))
    own = Window.partitionBy("u")
    adjacency = found.withColumn("pos", (F.row_number().over(own.orderBy("edge_id")) - 1).cast("long")).withColumn("deg", F.count(F.lit(1)).over(own))
    asked = drawn.select("edge_id", "src", "dst").distinct()
    at = lambda end: adjacency.select("edge_id", F.col("u").alias(end), F.col("pos").alias(f"pos_{end}"), F.col("deg").alias(f"deg_{end}"))
    places = asked.join(at("src"), ["edge_id", "src"]).join(at("dst"), ["edge_id", "dst"]).drop("src", "dst")
    return drawn.join(places, "edge_id"), adjacency.drop("deg")


def neighbours_of(graph: Graph, vertices: DataFrame) -> DataFrame:
    """``graph.neighbours`` of the given vertices (u)."""
    return near(graph, vertices).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("edge_id", "v"))).alias("nbrs"))
