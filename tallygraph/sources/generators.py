"""Random graphs and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.functions import rng


def random_graph(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> DataFrame:
    """(src, dst): ``edges`` distinct undirected edges without self loops; fewer where the graph has no more."""
    want = min(edges, vertices * (vertices - 1) // 2)
    found, tries = spark.createDataFrame([], "src long, dst long, at long"), 2
    while True:
        drawn = spark.range(want * tries).select(rng.below(vertices, seed, "id", 0).alias("a"), rng.below(vertices, seed, "id", 1).alias("b"), "id").where("a <> b")
        found = drawn.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("id").alias("at"))
        if want == 0 or found.count() >= want:
            return found.orderBy("at").limit(want).select("src", "dst")  # the first that were drawn
        tries *= 2


def with_weights(edges: DataFrame, top: int = 79, seed: int = 13) -> DataFrame:
    """``edges`` and weight in 0 to top - 1, drawn by the edge's ends."""
    return edges.withColumn("weight", rng.below(top, seed, "src", "dst"))


def duplicates(edges: DataFrame) -> DataFrame:
    """(src, dst, n): undirected edges that are there more than once; a clean table gives none."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
