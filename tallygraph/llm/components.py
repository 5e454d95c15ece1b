"""Connected components of a link table, without collecting links or components anywhere.

Each task first reduces its own links to a spanning forest (union-find). Then large-star and small-star steps alternate until no
link changes (Kiveris et al., Connected Components in MapReduce and Beyond, 2014). Every step is two aggregations with map-side
combine and an equi-join, and is written to the shared folder, so that a lost executor costs one step.

Defined results: self links and links with a null end are ignored; repeated links and both directions count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import scratch
from tallygraph.functions.ship import ship


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components, each node to its component's smallest node."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate((a, batch.column("u").to_numpy(zero_copy_only=False)))
        b = np.concatenate((b, batch.column("v").to_numpy(zero_copy_only=False)))
        if len(a) > 1 << 20:
            a, b = forest(a, b)
            if len(a) > 1 << 19:  # links of that many nodes at once are passed on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def _larger_first(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def components(links: DataFrame) -> DataFrame:
    """(u, v): every node but each component's smallest, and that smallest node. ``links`` has the long columns u and v."""
    ship(links.sparkSession)
    links = links.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = scratch.stage(_larger_first(links.mapInArrow(_forests, "u long, v long")), "forest")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _larger_first(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        large = scratch.stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        paired = large.join(low, "u")
        small = _larger_first(paired.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))).distinct()
        small = scratch.stage(small, "small")
        # Done when each node has one link and no link's end has one of its own.
        ends = small.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(small.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").limit(1).count() == 0:
            return small
        edges = small
