"""The graph as DataFrames.

``edges(edge_id, src, dst[, weight])`` has each undirected edge once, src < dst, without self loops; ``edge_id`` is a random arrival order.
``adjacency(u, v, edge_id, pos[, weight])`` has each edge from both ends, ``pos`` being its place among u's by edge_id.
Ids are longs, so unsigned 32-bit ids of other systems fit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygraph.functions import lineage, ranks, rng
from tallygraph.operators import local

#: Vertices up to this number are sent to all tasks, 16 bytes each.
MAPPED = 2_000_000


def canonical(raw: DataFrame) -> DataFrame:
    """Edges src < dst, each pair once, no self loops; of parallel edges the smallest weight stays."""
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    ends = (F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
    if "weight" in raw.columns:
        pairs = raw.select(*ends, F.col("weight").cast("long").alias("weight")).where("src < dst")
        return pairs.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return raw.select(*ends).where("src < dst").distinct()


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with dense ids, mapping(old_id, new_id)): new ids are the ranks of the old among those in use."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("old_id")).distinct()
    mapping = ranks.value_rank(used, "old_id", "new_id")
    return apply_mapping(edges, mapping), mapping


def apply_mapping(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends replaced; the orientation is made canonical again."""
    a = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("__a"))
    b = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("__b"))
    joined = edges.join(a, "src").join(b, "dst")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return joined.select(F.least("__a", "__b").alias("src"), F.greatest("__a", "__b").alias("dst"), *rest)


class Graph:
    def __init__(self, edges: DataFrame, like: Graph | None = None) -> None:
        """``like`` is a graph that has as many edges."""
        self.edges, self._like, self._raw = edges, like, None

    @classmethod
    def from_edges(cls, raw: DataFrame, seed: int = 7) -> Graph:
        """From any (src, dst[, weight]); the arrival order is a permutation drawn by ``seed``."""
        return cls(ranks.random_rank(canonical(raw), rng.draw(seed, "src", "dst"), ["src", "dst"], "edge_id"))

    @classmethod
    def unordered(cls, raw: DataFrame) -> Graph:
        """From any (src, dst[, weight]), without an arrival order (no edge_id), which exact counts don't need."""
        found = cls(canonical(raw))
        found._raw = raw
        return found

    @cached_property
    def blocks(self) -> local.Blocks:
        """The edges, packed and written once. A graph from raw edges takes them from these, so that its own edges need not be made."""
        raw = self.edges if self._raw is None else self._raw
        ends = raw.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        with lineage.dropping(raw.sparkSession):
            count = self.num_edges if self._raw is None else raw.count()
        return local.Blocks(ends, count)

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def persist(self) -> Graph:
        self.edges = self.edges.persist()
        return self

    def unpersist(self) -> None:
        self.edges.unpersist()

    @cached_property
    def num_edges(self) -> int:
        return self._like.num_edges if self._like else self.edges.count()

    @property
    def unweighted(self) -> Graph:
        return Graph(self.edges.drop("weight"), self)

    @property
    def directed(self) -> DataFrame:
        """(u, v[, edge_id][, weight]): each edge from both ends."""
        extra = [c for c in ("edge_id", "weight") if c in self.edges.columns]
        there = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), *extra)
        back = self.edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), *extra)
        return there.unionByName(back)

    @property
    def adjacency(self) -> DataFrame:
        return self.directed.withColumn("pos", (F.row_number().over(Window.partitionBy("u").orderBy("edge_id")) - 1).cast("long"))

    @property
    def degrees(self) -> DataFrame:
        """(u, deg), with map-side combine: a hub is one row of each task."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("u"))
        return ends.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))

    @property
    def neighbours(self) -> DataFrame:
        """(u, nbrs): u's (edge_id, v) sorted by edge_id, as an array."""
        return self.directed.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("edge_id", "v"))).alias("nbrs"))

    @property
    def placed(self) -> DataFrame:
        """Edges with the degree of both ends and the edge's place among either's."""
        a = self.adjacency.select("edge_id", "u", "pos")
        d = self.degrees
        src = a.join(d, "u").select("edge_id", F.col("u").alias("src"), F.col("pos").alias("pos_src"), F.col("deg").alias("deg_src"))
        dst = a.join(d, "u").select("edge_id", F.col("u").alias("dst"), F.col("pos").alias("pos_dst"), F.col("deg").alias("deg_dst"))
        return self.edges.join(src, ["edge_id", "src"]).join(dst, ["edge_id", "dst"])

    def filter(self, predicate: Column | str) -> Graph:
        """Edges for which ``predicate`` holds, with their ids; everything derived follows."""
        return Graph(self.edges.where(predicate))

    def sample(self, rate: float, seed: int = 11) -> Graph:
        """Each edge kept with probability ``rate``."""
        return Graph(self.edges.where(rng.bernoulli(rate, seed, "edge_id")))

    def reindexed(self) -> Graph:
        """Edge ids dense again, in the same order; after ``filter`` or ``sample``."""
        return Graph(ranks.value_rank(self.edges.withColumnRenamed("edge_id", "__old"), "__old", "edge_id").drop("__old"))

    def vertices(self) -> DataFrame:
        """From raw edges where there are such: repeated ones do no harm here, and telling them apart would shuffle them."""
        some = self.edges if self._raw is None else self._raw.where("src <> dst")
        return some.select(F.explode(F.array(*(F.col(c).cast("long") for c in ("src", "dst")))).alias("v")).distinct()

    def permutation(self, seed: int = 5) -> DataFrame:
        """(old_id, new_id): a random relabelling of the vertices by 0 to V - 1."""
        return self._permutation(self.vertices(), seed)

    @staticmethod
    def _permutation(vertices: DataFrame, seed: int) -> DataFrame:
        used = vertices.withColumnRenamed("v", "old_id")
        return ranks.random_rank(used, rng.draw(seed, "old_id"), ["old_id"], "new_id")

    def permuted(self, seed: int = 5) -> Graph:
        if self._raw is None:
            return Graph(apply_mapping(self.edges, self.permutation(seed)), self)
        mapping = lineage.written(self._permutation(lineage.written(self.vertices(), "vertices"), seed), "permutation")
        few = mapping.count() <= MAPPED  # then the edges are not shuffled
        return Graph.unordered(apply_mapping(self._raw.where("src <> dst").select("src", "dst"), F.broadcast(mapping) if few else mapping))

    def workers(self, count: int, num_vertices: int, seed: int = 5) -> DataFrame:
        """(v, worker): contiguous ranges of equal length of the permuted ids."""
        return self.permutation(seed).select(F.col("old_id").alias("v"), F.floor(F.col("new_id") * count / F.lit(num_vertices)).cast("long").alias("worker"))

    def within_workers(self, workers: DataFrame) -> DataFrame:
        """Edges of which both ends have one worker, and that worker."""
        a = workers.select(F.col("v").alias("src"), F.col("worker").alias("worker"))
        b = workers.select(F.col("v").alias("dst"), F.col("worker").alias("__b"))
        return self.edges.join(a, "src").join(b, "dst").where("worker = __b").drop("__b")
