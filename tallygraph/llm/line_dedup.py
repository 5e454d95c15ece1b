"""Line deduplication over levelled sorted runs of line hashes [native].

The index is a set of runs. A run is a written table of (h1, h2, docs): 128 bits of a line's key and in how many documents
of one batch it occurs, sorted by hash. Each new batch counts its own keys, is merge-anti-joined with the keys that the runs
have already settled (found in ``min_docs`` documents or more, which no further count can change) and adds what is left as
a run of level 0. When a level holds ``fanout`` runs they are merged into one run of the next level, so that a key lies in
at most fanout * log(batches) runs. After the last batch, one merge of the runs gives all keys with ``min_docs``.

A line's key: the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Lines are split at \\n only.

Defined results: a null or empty text is one empty line, which is never dropped (its key has no code point). Rows that
repeat a doc_id count as one document; each row gets its own result. Null doc_ids are one document. A text whose lines all
go is the empty text. Empty tables give empty results; columns of other names are passed through by ``drop_lines``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import scratch
from tallygraph.llm.url_filter import LOWER, UPPER

BLANK = " \t\n\x0b\x0c\r"
BATCHES, FANOUT = 4, 3
#: Settled keys up to this number (16 bytes each) are sent to all tasks; more are joined by hash.
BROADCAST_KEYS = 200_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs. ``add`` takes a batch of (h1, h2, doc_id), one row for each line."""

    def __init__(self, min_docs: int, fanout: int = FANOUT) -> None:
        self.min_docs, self.fanout, self.levels = min_docs, fanout, []

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def totals(self) -> DataFrame | None:
        """(h1, h2, docs) over all runs."""
        runs = self._runs()
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("docs").alias("docs")) if runs else None

    def settled(self) -> DataFrame | None:
        totals = self.totals()
        return None if totals is None else totals.where(F.col("docs") >= self.min_docs).select("h1", "h2")

    def add(self, batch: DataFrame) -> None:
        # A hot line is one row of each task after the first distinct; no key gathers its documents.
        own = batch.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        if (settled := self.settled()) is not None:
            own = own.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(0, scratch.stage(own.sortWithinPartitions("h1", "h2"), "run"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level]).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
            self.levels[level] = []
            self._push(level + 1, scratch.stage(merged.sortWithinPartitions("h1", "h2"), "run"))


def settled_keys(docs: DataFrame, min_docs: int, batches: int = BATCHES) -> DataFrame:
    """(h1, h2) of the line keys found in ``min_docs`` documents or more, over all of ``docs``."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: k != "")
    rows = docs.select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
    rows = rows.select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(batches)).cast("int").alias("batch"))
    lines = scratch.stage(rows, "lines", by=["batch"])
    runs = LineRuns(min_docs)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).drop("batch"))
    return scratch.stage(runs.settled(), "settled")


def drop_lines(docs: DataFrame, min_docs: int = 10, batches: int = BATCHES) -> DataFrame:
    """All columns of ``docs``, and n_lines, n_dropped, kept (the lines that stay, joined by \\n)."""
    settled = settled_keys(docs, min_docs, batches)
    fresh = [c for c in ("n_lines", "n_dropped", "kept") if c in docs.columns]
    docs = docs.drop(*fresh)
    lines = lines_of(F.col("text"))
    r1, r2 = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(3), "doc_id", "text")
    # The hashes come before the lines are dealt out, or each line would carry its text and hash it again.
    marked = docs.select(r1.alias("r1"), r2.alias("r2"), F.transform(lines, line_key).alias("keys"))
    seen = marked.select("r1", "r2", F.posexplode("keys").alias("at", "key")).where("key <> ''")
    seen = seen.select("r1", "r2", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    if settled.count() <= BROADCAST_KEYS:
        settled = F.broadcast(settled)
    gone = seen.join(settled, ["h1", "h2"]).groupBy("r1", "r2").agg(F.collect_set("at").alias("gone"))
    rows = docs.withColumn("__r1", r1).withColumn("__r2", r2)
    rows = rows.join(gone.withColumnsRenamed({"r1": "__r1", "r2": "__r2", "gone": "__gone"}), ["__r1", "__r2"], "left").withColumn("__lines", lines)
    # array_except goes by a hash table, so a text's time grows with its lines, not with lines times dropped lines.
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    stay = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda at: F.get("__lines", at)), "\n"))
    return rows.select(*docs.columns, F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"), stay.alias("kept"))


def dedup_documents(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` with its text replaced by the lines that stay; a document that had text and keeps none is dropped."""
    cleaned = drop_lines(docs, min_docs).where("n_dropped = 0 or kept rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return cleaned.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))).select(*docs.columns)
