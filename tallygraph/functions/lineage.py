"""Cuts a plan: the rows so far are written to the checkpoint folder, and what follows starts from there."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting (since 4.1) by which a query's shuffle files go when it ends.
DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries begun and ended inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def dropping(spark: SparkSession):
    """The shuffle files of a query begun and ended inside go with it, on all executors, and don't wait for the driver's garbage collection. A persisted
    table's own remain."""
    return setting(spark, DROP, "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine's own is used only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or tempfile.mkdtemp(prefix="tallygraph-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from files in ``spark.checkpoint.dir``, so that a lost executor or a long plan costs one step."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` from Parquet files in the shared folder, which are written now; the shuffle files of its plan are dropped."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    with dropping(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of plans that are garbage by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
