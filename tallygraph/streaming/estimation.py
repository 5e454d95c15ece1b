"""A running estimate over a stream of finished estimators.

A stream of (est, inv_p), failed estimators with 0, becomes one row (n, total) in update mode; the mean is total / n at any time. Exactly the merge
of partial estimations, kept by the state store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_estimate(stream: DataFrame) -> DataFrame:
    return stream.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inv_p").cast("decimal(38,6)")).alias("total"), F.avg("inv_p").alias("mean"))


def start(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """``on_batch`` sees the whole estimate after each batch; a restart goes on from the checkpoint."""
    return running_estimate(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()
