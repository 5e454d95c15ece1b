"""Binary edge lists: records of two or three little-endian unsigned 32-bit numbers, without a header.

Reading is Spark's own fixed-length record reader and JVM expressions, so splits fall between records and no Python runs. Writing goes through a
Python data source, whose tasks write a file each.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tallygraph.functions.ship import ship


def _number(hexed, at: int):
    """The unsigned number of the four bytes from ``at`` on, of a hex string; the lowest byte comes first."""
    pairs = [F.substring(hexed, 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0)]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def read_biedgelist(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst[, weight]). A file whose size is no multiple of the record's fails."""
    size = 12 if weighted else 8
    wrong = spark.read.format("binaryFile").load(path).select("length").where(F.col("length") % size != 0)
    if wrong.limit(1).count():
        raise ValueError(f"a file in {path} is no sequence of {size}-byte records")
    records = spark.sparkContext.binaryRecords(path, size).map(lambda r: (r,))
    raw = spark.createDataFrame(records, "r binary").select(F.hex("r").alias("h"))
    names = ["src", "dst", *(["weight"] if weighted else [])]
    return raw.select(*(_number(F.col("h"), 4 * i).alias(n) for i, n in enumerate(names)))


@dataclass
class _Wrote(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, weighted: bool) -> None:
        self.path, self.layout = path, "<III" if weighted else "<II"
        self.names = ("src", "dst", "weight")[: 3 if weighted else 2]

    def write(self, iterator: Iterator) -> _Wrote:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        pack = struct.Struct(self.layout).pack
        name, rows = os.path.join(self.path, f"part-{part:05d}"), 0
        with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as out:
            for row in iterator:
                out.write(pack(*(row[n] for n in self.names)))
                rows += 1
        os.replace(out.name, f"{name}.bin")  # a second attempt writes the same file
        return _Wrote(f"{name}.bin", rows)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class BinaryEdges(DataSource):
    """``df.write.format("biedgelist").option("path", shared_folder)``; option weighted=true for three numbers."""

    @classmethod
    def name(cls) -> str:
        return "biedgelist"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("weighted", "false").lower() == "true")


def write_biedgelist(edges: DataFrame, path: str, weighted: bool = False) -> None:
    """Part files in a folder that all executors share."""
    ship(edges.sparkSession)
    edges.sparkSession.dataSource.register(BinaryEdges)
    columns = ["src", "dst", *(["weight"] if weighted else [])]
    edges.select(*columns).write.format("biedgelist").mode("append").option("path", path).option("weighted", str(weighted).lower()).save()
