"""What steps leave on the executors' disks."""

import time

import pytest
from pyspark.sql import functions as F

from tallygraph.functions import lineage
from tallygraph.llm import scratch
from tallygraph.plans.graph import Graph
from tests.graphs import random_edges


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() and files.apply(i).getName().endswith(".data") for i in range(files.size()))


@pytest.mark.parametrize("write", [lineage.written, scratch.stage])
def test_a_written_table_leaves_no_shuffle_files(spark, write):
    before, setting = shuffle_files(spark), spark.conf.get(lineage.DROP)
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()  # held, so that no garbage collection frees its files
    assert write(kept, "seven").count() == 7
    assert write(kept, "again").count() == 7
    until = time.time() + 10
    while shuffle_files(spark) > before + 2 and time.time() < until:  # the two counts' own files may stay
        time.sleep(0.1)
    assert shuffle_files(spark) <= before + 2
    assert spark.conf.get(lineage.DROP) == setting


def test_permuting_raw_edges_keeps_no_table_of_edges(spark):
    rows = [*random_edges(30, 100, 1), (4, 4), (None, 3)]
    graph = Graph.unordered(spark.createDataFrame(rows, "src long, dst long")).persist()
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    used = {v for e in rows if None not in e and e[0] != e[1] for v in e}
    permuted = graph.permuted(5).edges.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    assert len(permuted) == 100 and {v for e in permuted for v in (e.src, e.dst)} == set(range(len(used)))
