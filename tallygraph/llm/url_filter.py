"""URL filter by rules on hosts and paths, as a sort-merge range join [native].

A host is written with its labels reversed and each ended by a dot (``www.example.com`` gives ``com.example.www.``), so that
a rule for a host and all its subdomains is the interval of the keys that begin with the rule's key. Two such intervals
nest or are apart. The sweep runs over the sorted union of the rules' starts and the hosts, both only once each: the last
rule that starts at or before a host is on top of the stack, and every rule that holds for the host is on the stack of
that rule. So each rule carries its stack (its own enclosing rules), and a host needs one as-of lookup.

The sweep is cut by ``repartitionByRange``; the stack that is open at the start of a range is the running maximum of the
rules before it. Hosts are deduplicated first, so a host with a third of all pages is one row in the sweep; the way back
to the pages is an equi-join, whose large partitions adaptive execution splits.

Defined results: a null url or one without ``://`` has an empty host and path; no rule fits an empty host unless its own
host is empty. Empty labels (``a..b``, ``b.``) are labels like others. Without a fitting rule ``rule`` is null and the verdict is ``default``. Of fitting rules the one with the
longest host wins, then the longest path. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygraph.llm import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Labels reversed, each ended by a dot; an empty host has the empty key, which only its own rules reach."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rules``: (verdict, host, path). Large rule sets can be any DataFrame of ``verdict, host, path``."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each distinct host of the rules, its own and all enclosing hosts' rules, the longest first."""
    own = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .dropDuplicates(["host", "path"])
        .withColumn("key", host_key(F.col("host")))
    )
    ended = F.split("key", r"\.")  # each label and an empty end; empty labels inside a host count like others
    labels = F.slice(ended, 1, F.size(ended) - 1)
    up = own.select("key").distinct().select(
        F.col("key").alias("inner_key"),
        F.explode(
            F.when(F.size(labels) <= 0, F.array(F.col("key"))).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
            )
        ).alias("key"),
    )
    entry = F.struct((-F.length("host")).alias("a"), (-F.length("path")).alias("b"), "host", "path", "verdict", "key")
    return up.join(own, "key").groupBy(F.col("inner_key").alias("key")).agg(F.array_sort(F.collect_list(entry)).alias("stack"))


def sweep(hosts: DataFrame, stacked: DataFrame) -> DataFrame:
    """(host, stack): ``stack`` is that of the last rule at or before the host's key, or null."""
    starts = stacked.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    points = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast(stacked.schema["stack"].dataType).alias("stack"))
    ranged = starts.unionByName(points).repartitionByRange("key").withColumn("range", F.spark_partition_id())
    ranged = scratch.stage(ranged, "ranges")  # the cut is sampled: a range must be the same in both uses
    last = ranged.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("last_stack"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = ranged.select("range").distinct().join(last, "range", "left")  # a row a range
    opened = every.select("range", F.last("last_stack", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.select("range", "kind", "host", F.last("stack", ignorenulls=True).over(inside).alias("seen"))
    return swept.where("kind = 1").join(opened, "range").select("host", F.coalesce("seen", "carried").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule (host and path of the rule that decides, or null), verdict."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    swept = sweep(parts.select("host").distinct(), stacks(rules))
    active = F.filter("stack", lambda r: F.startswith(host_key(F.col("host")), r["key"]) & ((r["key"] != "") | (F.col("host") == "")))
    known = swept.select("host", active.alias("active")).where("size(active) > 0")
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    judged = parts.join(known, "host", "left").withColumn("r", F.try_element_at(fits, F.lit(1)))
    return judged.select("page_id", "host", "path", F.concat("r.host", "r.path").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
