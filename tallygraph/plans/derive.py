"""Graphs from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bought_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) for each order and two of its lines: src < dst, with parallel edges; weight: the sum of quantities."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = line.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_quantity").alias("qa"))
    b = line.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("qb"))
    pairs = a.join(b, "l_orderkey").where("src < dst")
    return pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col("qa") + F.col("qb")).cast("long").alias("weight"))


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): parts bought in one order; weight: the smallest sum of quantities."""
    return bought_together(spark, sf_dir).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
