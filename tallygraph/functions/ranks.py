"""Dense ranks without a window over the whole table.

Rows are put in buckets whose order is the order of the rank. A bucket's rows are numbered in their own task, and a running sum over the buckets'
counts (a row a bucket) gives where each bucket starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygraph.functions.rng import BITS

BUCKETS_LOG2 = 10


def dense_rank(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` and ``name``: 0, 1, 2, ... by (bucket, order), which must be a total order that never falls as ``order`` grows."""
    marked = df.withColumn("__bucket", bucket)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__bucket").orderBy(*order)
    # At most 2^BUCKETS_LOG2 + 1 rows: a proven size.
    numbered = marked.withColumn("__at", F.row_number().over(inside) - 1).join(F.broadcast(starts), "__bucket")
    return numbered.withColumn(name, F.col("__start") + F.col("__at")).drop("__bucket", "__start", "__at")


def random_rank(df: DataFrame, key: Column, ties: list[str], name: str) -> DataFrame:
    """Ranks by a draw in [0, 2^52), ties by the given columns."""
    keyed = df.withColumn("__key", key)
    bucket = F.shiftright("__key", BITS - BUCKETS_LOG2)
    return dense_rank(keyed, bucket, [F.col("__key"), *map(F.col, ties)], name).drop("__key")


def value_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks of the values of a long column without repeats; buckets are equal widths of its range."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) >> BUCKETS_LOG2))
    return dense_rank(df, F.floor((F.col(column) - F.lit(low or 0)) / F.lit(width)), [F.col(column)], name)
