"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources, by code point with null last, weigh ``weights`` in turn and share the total number of words times
``share``. No target exceeds ``max_epochs`` times its source's size; what is above goes to the other sources by weight,
until none is above (the water level is found from the sources sorted by size over weight).

Selection: a source first gives its complete epochs (all its documents, floor(target / size) times). The rest of the target
is drawn without replacement: each document has an exponential key, -ln(u) / quality, with u from a hash of the document, and
the documents with the smallest keys are taken until their words fill the rest; the last one gives just the words that are
still missing, so that a source meets its target to a word.

No task sorts a source. Keys fall into ``SLICES`` equal slices of their exponential distribution; the words of (source,
slice) are summed with map-side combine, the running sums over the slices settle all documents but those of one slice per
source, and only that slice is sorted.

Quality: the share of letters in the text, 0.01 at least, unless ``quality`` names a column.

Defined results: a null or empty text has size 0 and takes 0; a source without words has target 0. Rows that repeat a document
draw the same u; ties go by doc_id, and equal rows are alike. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygraph.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Letters over code points, between 0.01 and 1; 0.01 without text."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("double")
    return F.greatest(F.lit(0.01), F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def uniform(seed: int) -> Column:
    """In (0, 1), from the document alone: reruns and lost executors draw the same."""
    hexed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a row a source."""
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share))
    ranked = ranked.withColumn("even", (all_words - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(after) * F.col("weight"))
    # In this order the first source whose even part is under its cap fixes the level for itself and all after it.
    fixed = F.min(F.when(F.col("even") < F.col("cap"), F.struct("cap_rank", (F.col("even") / F.col("weight")).alias("level")))).over(Window.partitionBy(F.lit(1)))
    ranked = ranked.withColumn("cap_rank", F.row_number().over(level)).withColumn("fixed", fixed)
    target = F.when(F.col("fixed").isNull() | (F.col("cap_rank") < F.col("fixed.cap_rank")), F.col("cap")).otherwise(F.col("fixed.level") * F.col("weight"))
    return ranked.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 17, quality: str | None = None) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken."""
    worth = F.greatest(F.lit(1e-6), F.coalesce(F.col(quality).cast("double"), F.lit(1e-6))) if quality else letter_share(F.col("text"))
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), (-F.log(uniform(seed)) / worth).alias("key"))
    rows = scratch.stage(rows, "sizes")
    slice_of = F.least(F.lit(SLICES - 1), F.floor((1 - F.exp(-F.col("key") / 2)) * SLICES)).cast("int")
    rows = rows.withColumn("slice", slice_of)
    sums = scratch.stage(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aims = scratch.stage(aims.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "targets")
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = sums.withColumn("end", F.sum("words").over(upto)).join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # A slice is taken whole, or not at all, or it is the one in which the rest runs out. Documents meet their plan by (source, slice): a source with
    # a third of all rows is spread over all its slices.
    plan = plan.withColumn("before", F.col("end") - F.col("words")).withColumnsRenamed({"source": "s", "slice": "at"})
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("at")))
    edge = (F.col("before") < F.col("rest")) & (F.col("end") > F.col("rest"))
    outside = rows.where(~edge).withColumn("once", F.when(F.col("end") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    inner = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(edge).withColumn("once", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inner), F.lit(0)))))
    return outside.unionByName(inside).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("once")).cast("long").alias("taken"))
