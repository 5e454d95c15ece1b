"""Tables written between the steps of an operator, in the folder that all executors share.

A written table cuts the lineage: when an executor is lost, a step is recomputed from files and not from the start.
The folder is the session's ``spark.checkpoint.dir``; where it is unset (tests on one machine) a temporary one is used.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallygraph.functions import lineage

_written: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder; only a local master may fall back to this machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallygraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = f"{root(spark)}/tallygraph-{uuid.uuid4().hex}-{tag}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it again; the same schema holds for an empty table. The shuffle files that this took are dropped."""
    spark, path = df.sparkSession, place(df.sparkSession, tag)
    writer = df.write.partitionBy(*by) if by else df.write
    with lineage.dropping(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Delete a staged table that nothing reads any more.
remove = lineage.remove


def release(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of steps whose results are staged; their plans are garbage by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cleanup() -> None:
    """Delete every table that this process has staged. Results that still read them must be written before."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone: its owner clears the folder
            return


atexit.register(cleanup)
