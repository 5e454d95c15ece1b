"""All registered queries of the graph engine, and their SQL for another engine.

Graphs: parts bought together (``derive.co_purchase``), over all of lineitem.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.functions import lineage, rng
from tallygraph.operators import estimators, exact, profiles, sampling, vertex_sampling
from tallygraph.plans import derive, graph, pattern
from tallygraph.plans.graph import Graph
from tallygraph.plans.pattern import Pattern
from tallygraph.sources import binary, generators, text

SEED, WALKERS = 7, 20_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def registered(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return registered


def cp(spark: SparkSession, sf_dir: str, weighted: bool = True) -> Graph:
    raw = derive.bought_together(spark, sf_dir)
    return Graph.from_edges(raw if weighted else raw.drop("weight"), SEED).persist()  # several parts of a plan read the graph


def plain(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Graph:
    """The graph without an arrival order."""
    raw = derive.bought_together(spark, sf_dir)
    return Graph.unordered(raw if weighted else raw.drop("weight")).persist()


def r(*parts: object) -> str:
    """The draw of ``functions.rng`` in the other engine's SQL."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13))::BIGINT"


def tables() -> str:
    """e(edge_id, src, dst, weight), a(u, v, edge_id, weight, pos), d(u, deg) as common table expressions."""
    return f"""
WITH RECURSIVE raw AS (
  SELECT least(x.l_partkey, y.l_partkey)::BIGINT AS src, greatest(x.l_partkey, y.l_partkey)::BIGINT AS dst, CAST(min(x.l_quantity + y.l_quantity) AS BIGINT) AS weight
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {r(SEED, "src", "dst")}, src, dst) - 1 AS edge_id, src, dst, weight FROM raw),
both_ends AS (SELECT src AS u, dst AS v, edge_id, weight FROM e UNION ALL SELECT dst, src, edge_id, weight FROM e),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY u ORDER BY edge_id) - 1 AS pos FROM both_ends),
d AS MATERIALIZED (SELECT u, count(*) AS deg FROM a GROUP BY u)"""


T = tables()
TRIANGLES = "SELECT x.src AS a, x.dst AS b, y.dst AS c, x.weight AS w_ab, z.weight AS w_ac, y.weight AS w_bc FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst"


# Construction and statistics.


@query("build_edges", f"{T} SELECT edge_id, src, dst, weight FROM e")
def build_edges(spark, sf_dir):
    return cp(spark, sf_dir).edges.select("edge_id", "src", "dst", "weight")


@query("adjacency", f"{T} SELECT u, v, edge_id, weight, pos FROM a")
def adjacency(spark, sf_dir):
    return cp(spark, sf_dir).adjacency.select("u", "v", "edge_id", "weight", "pos")


@query("degree", f"{T} SELECT u, deg FROM d")
def degree(spark, sf_dir):
    return cp(spark, sf_dir, weighted=False).degrees


@query("degree_histogram", f"{T} SELECT deg, count(*) AS vertices FROM d GROUP BY deg")
def degree_histogram(spark, sf_dir):
    return cp(spark, sf_dir, weighted=False).degrees.groupBy("deg").agg(F.count(F.lit(1)).alias("vertices"))


@query("max_degree", f"{T} SELECT max(deg) AS max_degree FROM d")
def max_degree(spark, sf_dir):
    return cp(spark, sf_dir, weighted=False).degrees.agg(F.max("deg").alias("max_degree"))


def _stats(g: Graph) -> DataFrame:
    return g.degrees.agg(F.count(F.lit(1)).alias("num_vertices"), (F.coalesce(F.sum("deg"), F.lit(0)) / 2).cast("long").alias("num_edges"), F.max("deg").alias("max_degree"))


STATS = "SELECT count(*) AS num_vertices, CAST(coalesce(sum(deg), 0) // 2 AS BIGINT) AS num_edges, max(deg) AS max_degree FROM"


@query("graph_stats", f"{T} {STATS} d")
def graph_stats(spark, sf_dir):
    return _stats(cp(spark, sf_dir))


@query("vertices_with_edges", f"{T} SELECT u AS v FROM d")
def vertices_with_edges(spark, sf_dir):
    return cp(spark, sf_dir).vertices()


@query("duplicate_check", "SELECT src, dst, n FROM (SELECT least(o_custkey, o_orderkey % 97)::BIGINT AS src, greatest(o_custkey, o_orderkey % 97)::BIGINT AS dst, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n > 1")
def duplicate_check(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return generators.duplicates(orders.select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") % 97).cast("long").alias("dst")))


@query("canonical_edges", "SELECT DISTINCT least(l_partkey, l_suppkey)::BIGINT AS src, greatest(l_partkey, l_suppkey)::BIGINT AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def canonical_edges(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return graph.canonical(line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


RELABEL = "m AS (SELECT u AS old_id, row_number() OVER (ORDER BY u) - 1 AS new_id FROM d)"


@query("dense_relabel", f"{T}, {RELABEL} SELECT least(x.new_id, y.new_id) AS src, greatest(x.new_id, y.new_id) AS dst, weight, edge_id FROM e JOIN m x ON x.old_id = src JOIN m y ON y.old_id = dst")
def dense_relabel(spark, sf_dir):
    return graph.relabel(cp(spark, sf_dir).edges)[0]


PERMUTED = f"m AS (SELECT u AS old_id, row_number() OVER (ORDER BY {r(5, 'u')}, u) - 1 AS new_id FROM d)"


@query("vertex_permutation", f"{T}, {PERMUTED} SELECT old_id, new_id FROM m")
def vertex_permutation(spark, sf_dir):
    return cp(spark, sf_dir).permutation(5)


@query("inverse_permutation", f"{T}, {PERMUTED} SELECT new_id AS id, old_id AS origin FROM m")
def inverse_permutation(spark, sf_dir):
    return cp(spark, sf_dir).permutation(5).select(F.col("new_id").alias("id"), F.col("old_id").alias("origin"))


@query("permuted_triangles", f"{T} SELECT count(*) AS triangles FROM ({TRIANGLES})")
def permuted_triangles(spark, sf_dir):
    """The count does not depend on the labels."""
    return exact.triangles(plain(spark, sf_dir).permuted(5))


@query("edge_shuffle_ids", f"{T} SELECT row_number() OVER (ORDER BY {r(99, 'src', 'dst')}, src, dst) - 1 AS edge_id, src, dst FROM raw")
def edge_shuffle_ids(spark, sf_dir):
    return Graph.from_edges(derive.co_purchase(spark, sf_dir).drop("weight"), 99).edges.select("edge_id", "src", "dst")


BERNOULLI = f"s AS (SELECT * FROM e WHERE {r(11, 'edge_id')} < {int(0.1 * rng.SPAN)})"


@query("edge_bernoulli_sample", f"{T}, {BERNOULLI} SELECT edge_id, src, dst, weight FROM s")
def edge_bernoulli_sample(spark, sf_dir):
    return cp(spark, sf_dir).sample(0.1).edges.select("edge_id", "src", "dst", "weight")


@query("sampled_graph_stats", f"{T}, {BERNOULLI} {STATS} (SELECT u, count(*) AS deg FROM (SELECT src AS u FROM s UNION ALL SELECT dst FROM s) GROUP BY u)")
def sampled_graph_stats(spark, sf_dir):
    return _stats(cp(spark, sf_dir).sample(0.1))


WORKERS = f"{PERMUTED}, w AS (SELECT old_id AS v, CAST(floor(new_id * 4 / (SELECT count(*) FROM d)::DOUBLE) AS BIGINT) AS worker FROM m), i AS (SELECT e.*, x.worker FROM e JOIN w x ON x.v = src JOIN w y ON y.v = dst WHERE x.worker = y.worker)"


def _workers(g: Graph) -> DataFrame:
    return g.workers(4, g.degrees.count())


@query("partition_range", f"{T}, {WORKERS} SELECT v, worker FROM w")
def partition_range(spark, sf_dir):
    return _workers(cp(spark, sf_dir))


@query("cross_partition_drop", f"{T}, {WORKERS} SELECT edge_id, src, dst, worker FROM i")
def cross_partition_drop(spark, sf_dir):
    g = cp(spark, sf_dir)
    return g.within_workers(_workers(g)).select("edge_id", "src", "dst", "worker")


@query("partition_edge_counts", f"{T}, {WORKERS} SELECT worker, count(*) AS edges FROM i GROUP BY worker")
def partition_edge_counts(spark, sf_dir):
    g = cp(spark, sf_dir)
    return g.within_workers(_workers(g)).groupBy("worker").agg(F.count(F.lit(1)).alias("edges"))


@query("weight_assign", f"{T} SELECT src, dst, {r(13, 'src', 'dst')} % 79 AS weight FROM e")
def weight_assign(spark, sf_dir):
    return generators.with_weights(cp(spark, sf_dir, weighted=False).edges.select("src", "dst"))


@query("edge_weight_filter", f"{T} SELECT edge_id, src, dst, weight FROM e WHERE weight >= 50")
def edge_weight_filter(spark, sf_dir):
    return cp(spark, sf_dir).filter("weight >= 50").edges.select("edge_id", "src", "dst", "weight")


@query("filtered_graph_stats", f"{T} {STATS} (SELECT u, count(*) AS deg FROM (SELECT src AS u FROM e WHERE weight >= 50 UNION ALL SELECT dst FROM e WHERE weight >= 50) GROUP BY u)")
def filtered_graph_stats(spark, sf_dir):
    return _stats(cp(spark, sf_dir).filter("weight >= 50"))


@query("adjacency_export", f"{T} SELECT u AS v, u || ' 1 ' || string_agg(v::VARCHAR, ' ' ORDER BY v) AS line FROM a GROUP BY u")
def adjacency_export(spark, sf_dir):
    return text.adjacency_lines(cp(spark, sf_dir).directed)


# Exact counts.


@query("exact_wedge", f"{T} SELECT CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges FROM d")
def exact_wedge(spark, sf_dir):
    return exact.wedges(plain(spark, sf_dir))


@query("exact_triangle", f"{T} SELECT count(*) AS triangles FROM ({TRIANGLES})")
def exact_triangle(spark, sf_dir):
    return exact.triangles(plain(spark, sf_dir))


MOTIFS = f"{T}, t AS (SELECT count(*) AS triangles FROM ({TRIANGLES})), w AS (SELECT CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges FROM d)"


@query("exact_three_motif", f"{MOTIFS} SELECT wedges, triangles, wedges - 3 * triangles AS induced_wedges FROM t, w")
def exact_three_motif(spark, sf_dir):
    return exact.three_motifs(plain(spark, sf_dir))


@query("induced_wedge", f"{MOTIFS} SELECT wedges - 3 * triangles AS induced_wedges FROM t, w")
def induced_wedge(spark, sf_dir):
    return exact.three_motifs(plain(spark, sf_dir)).select("induced_wedges")


@query("exact_four_chain", f"{T}, t AS (SELECT count(*) AS n FROM ({TRIANGLES})) SELECT CAST(sum((x.deg - 1) * (y.deg - 1)) - 3 * any_value(t.n) AS BIGINT) AS four_chains FROM e JOIN d x ON x.u = src JOIN d y ON y.u = dst, t")
def exact_four_chain(spark, sf_dir):
    return exact.four_chains(plain(spark, sf_dir))


#: Common neighbours of pairs, triangles on edges, and 4-cycles through edges; tests hold the closed forms of both engines against enumeration.
COMMON = f"{T}, cd AS MATERIALIZED (SELECT x.u AS p, y.u AS q, count(*) AS k FROM a x JOIN a y ON x.v = y.v AND x.u < y.u GROUP BY ALL), te AS (SELECT e.src, e.dst, coalesce(k, 0) AS t FROM e LEFT JOIN cd ON p = src AND q = dst)"


@query("exact_five_chain", f"""{COMMON}, s AS (SELECT a.u, sum(deg - 1) AS s, sum((deg - 1) * (deg - 1)) AS q FROM a JOIN d ON d.u = a.v GROUP BY a.u)
SELECT CAST((SELECT sum((s * s - q) // 2) FROM s) - (SELECT coalesce(sum(t * (x.deg + y.deg - 3)), 0) FROM te JOIN d x ON x.u = src JOIN d y ON y.u = dst) - (SELECT coalesce(sum(k * (k - 1)), 0) FROM cd) AS BIGINT) AS five_chains""")
def exact_five_chain(spark, sf_dir):
    return exact.count(plain(spark, sf_dir), pattern.FIVE_CHAIN, "five_chains")


@query("exact_four_clique", f"{T}, t AS MATERIALIZED ({TRIANGLES}) SELECT count(*) AS four_cliques FROM t x JOIN t y ON x.a = y.a AND x.b = y.b AND x.c < y.c JOIN e ON e.src = x.c AND e.dst = y.c")
def exact_four_clique(spark, sf_dir):
    return exact.count(plain(spark, sf_dir), pattern.FOUR_CLIQUE, "four_cliques")


@query("exact_five_star", f"{T} SELECT CAST(sum(deg * (deg - 1) * (deg - 2) * (deg - 3) // 24) AS BIGINT) AS five_stars FROM d")
def exact_five_star(spark, sf_dir):
    return exact.stars(plain(spark, sf_dir), 5, "five_stars")


@query("exact_five_house", f"""{COMMON}, c AS (SELECT e.src, e.dst, sum(cd.k - 1) AS c FROM e JOIN a x ON x.u = e.src AND x.v <> e.dst JOIN cd ON p = least(x.v, e.dst) AND q = greatest(x.v, e.dst) GROUP BY ALL)
SELECT CAST(coalesce(sum(t * coalesce(c, 0) - 2 * t * t + 2 * t), 0) AS BIGINT) AS five_houses FROM te LEFT JOIN c USING (src, dst)""")
def exact_five_house(spark, sf_dir):
    return exact.count(plain(spark, sf_dir), pattern.HOUSE, "five_houses")


@query("exact_four_cycle", f"{COMMON} SELECT CAST(coalesce(sum(k * (k - 1) // 2), 0) // 2 AS BIGINT) AS four_cycles FROM cd")
def exact_four_cycle(spark, sf_dir):
    """A pattern that the user gives."""
    return exact.count(plain(spark, sf_dir), pattern.cycle(4), "four_cycles")


@query("triangle_per_vertex", f"{T}, t AS ({TRIANGLES}) SELECT v, count(*) AS triangles FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v")
def triangle_per_vertex(spark, sf_dir):
    return exact.triangles_per_vertex(plain(spark, sf_dir))


@query("weighted_all", f"{T} SELECT count(*) AS triangles FROM ({TRIANGLES}) WHERE w_ab >= 50 AND w_ac >= 50 AND w_bc >= 50")
def weighted_all(spark, sf_dir):
    return exact.weighted_triangles(plain(spark, sf_dir, weighted=True), "weight >= 50", True, "triangles")


@query("weighted_any", f"{T} SELECT count(*) AS triangles FROM ({TRIANGLES}) WHERE w_ab >= 50 OR w_ac >= 50 OR w_bc >= 50")
def weighted_any(spark, sf_dir):
    return exact.weighted_triangles(plain(spark, sf_dir, weighted=True), "weight >= 50", False, "triangles")


@query("predicate_subgraph_sum", f"{T} SELECT count(*) AS triangles FROM ({TRIANGLES}) WHERE w_ab + w_ac + w_bc >= 150 AND w_ab <= w_bc")
def predicate_subgraph_sum(spark, sf_dir):
    return exact.matching_triangles(plain(spark, sf_dir, weighted=True), "w_ab + w_ac + w_bc >= 150 and w_ab <= w_bc", "triangles")


# Sampling steps.

PLACED = "p AS (SELECT e.*, s.pos AS pos_src, ds.deg AS deg_src, t.pos AS pos_dst, dd.deg AS deg_dst FROM e JOIN a s ON s.edge_id = e.edge_id AND s.u = src JOIN a t ON t.edge_id = e.edge_id AND t.u = dst JOIN d ds ON ds.u = src JOIN d dd ON dd.u = dst)"
M = "(SELECT count(*) FROM e)"


def walk0(seed: int, n: int = WALKERS, edges: str = "p", m: str = M) -> str:
    return f"w0 AS MATERIALIZED (SELECT est, x.*, CAST({m} AS DOUBLE) AS inv_p FROM (SELECT est, {r(seed, 'est', 0)} % {m} AS k FROM range({n}) t(est)) q JOIN {edges} x ON x.edge_id = q.k)"


def walk1(seed: int, source: str = "w0", name: str = "w1", step: int = 1, where: str = "true", adj: str = "a") -> str:
    return f"""{name}r AS (SELECT *, deg_src - pos_src - 1 AS fs, deg_dst - pos_dst - 1 AS fd FROM {source} WHERE {where}),
{name}d AS (SELECT *, {r(seed, "est", step)} % (fs + fd) AS rr FROM {name}r WHERE fs + fd > 0),
{name} AS MATERIALIZED (SELECT w.* EXCLUDE (inv_p), w.inv_p * (fs + fd) AS inv_p, x.u AS u1, x.v AS v1, x.edge_id AS id1 FROM {name}d w
  JOIN {adj} x ON x.u = CASE WHEN rr < fs THEN w.src ELSE w.dst END AND x.pos = CASE WHEN rr < fs THEN pos_src + 1 + rr ELSE pos_dst + 1 + rr - fs END)"""


def summed(source: str, n: int = WALKERS, scale: float = 1.0) -> str:
    total = "CAST(floor(coalesce(sum(inv_p::DECIMAL(38,6)), 0)) AS BIGINT)"
    return f"SELECT CAST({n} AS BIGINT) AS n, count(*) AS successes, {total} AS total, round({total} * {float(scale)}::DOUBLE / {float(n)}::DOUBLE, 3) AS estimate FROM {source}"


def _ids(spark: SparkSession, n: int = WALKERS) -> DataFrame:
    return sampling.estimators(spark, 0, n)


@query("sample_vertex", f"{T} SELECT est, {r(3, 'est', 0)} % (SELECT count(*) FROM d) AS v, (SELECT count(*) FROM d) AS inv_p FROM range({WALKERS}) t(est)")
def sample_vertex(spark, sf_dir):
    return sampling.sample_vertex(_ids(spark), cp(spark, sf_dir).degrees.count(), 3)


@query("conditional_vertex", f"""{T}, s AS (SELECT est, {r(3, 'est', 0)} % (SELECT count(*) FROM d) AS v, (SELECT count(*) FROM d) AS n FROM range({WALKERS}) t(est))
SELECT est, v, v + 1 + {r(3, 'est', 1)} % (n - 1 - v) AS w, n * (n - 1 - v) AS inv_p FROM s WHERE n - 1 - v > 0""")
def conditional_vertex(spark, sf_dir):
    n = cp(spark, sf_dir).degrees.count()
    return sampling.conditional_vertex(sampling.sample_vertex(_ids(spark), n, 3), n, 3)


@query("sample_edge", f"{T}, {walk0(3, edges='e')} SELECT est, edge_id, src, dst, inv_p FROM w0")
def sample_edge(spark, sf_dir):
    g = cp(spark, sf_dir)
    return sampling.sample_edge(_ids(spark), g.edges, g.num_edges, 3).select("est", "edge_id", "src", "dst", "inv_p")


@query("sample_integer", f"SELECT est, 5 + {r(3, 'est', 4)} % 10 AS x FROM range({WALKERS}) t(est)")
def sample_integer(spark, sf_dir):
    return _ids(spark).select("est", rng.integer(5, 14, 3, "est", 4).alias("x"))


@query("conditional_edge", f"{T}, {PLACED}, {walk0(3)}, {walk1(3)} SELECT est, edge_id, id1, u1, v1, inv_p FROM w1")
def conditional_edge(spark, sf_dir):
    return estimators.wedge(cp(spark, sf_dir), 0, WALKERS, 3).select("est", "edge_id", "id1", "u1", "v1", "inv_p")


CLOSED = "c AS (SELECT w.*, x.edge_id AS close_id FROM w1 w JOIN e x ON x.src = least(w.v1, CASE WHEN u1 = w.src THEN w.dst ELSE w.src END) AND x.dst = greatest(w.v1, CASE WHEN u1 = w.src THEN w.dst ELSE w.src END) AND x.edge_id > id1)"


@query("conditional_close", f"{T}, {PLACED}, {walk0(3)}, {walk1(3)}, {CLOSED} SELECT est, edge_id, id1, close_id, inv_p FROM c")
def conditional_close(spark, sf_dir):
    return estimators.triangle(cp(spark, sf_dir), 0, WALKERS, 3).select("est", "edge_id", "id1", "close_id", "inv_p")


@query("subgraph_subtract", f"{T}, {PLACED}, {walk0(3)}, {walk1(3)} SELECT est, least(u1, v1) AS src, greatest(u1, v1) AS dst FROM w1")
def subgraph_subtract(spark, sf_dir):
    """The wedge's edges without the first."""
    w = estimators.wedge(cp(spark, sf_dir), 0, WALKERS, 3)
    first = F.struct("src", "dst")
    second = F.struct(F.col("v1").alias("src"), F.col("u1").alias("dst"))
    return w.select("est", F.explode(sampling.subtract(F.array(first, second), F.array(first))).alias("x")).select("est", "x.src", "x.dst")


# Estimators.


@query("est_wedge", f"{T}, {PLACED}, {walk0(21)}, {walk1(21)} {summed('w1')}")
def est_wedge(spark, sf_dir):
    return estimators.summary(estimators.wedge(cp(spark, sf_dir), 0, WALKERS, 21), WALKERS)


@query("est_triangle", f"{T}, {PLACED}, {walk0(21)}, {walk1(21)}, {CLOSED} {summed('c')}")
def est_triangle(spark, sf_dir):
    return estimators.summary(estimators.triangle(cp(spark, sf_dir), 0, WALKERS, 21), WALKERS)


def grown(source: str, name: str, bound: str, vertices: str, seed: int, step: int) -> str:
    """One conditional edge: all candidates in order, of which the drawn one stays."""
    return f"""{name}v AS (SELECT w.*, z.i, z.vert FROM (SELECT *, {bound} AS bd FROM {source}) w, LATERAL (SELECT unnest({vertices}) AS vert, generate_subscripts({vertices}, 1) AS i) z),
{name}c AS (SELECT w.*, least(x.u, x.v) AS ns, greatest(x.u, x.v) AS nd, x.edge_id AS nid, count(*) OVER (PARTITION BY est) AS s, row_number() OVER (PARTITION BY est ORDER BY i, x.edge_id) - 1 AS nth
  FROM {name}v w JOIN a x ON x.u = w.vert AND x.edge_id > w.bd),
{name} AS MATERIALIZED (SELECT * EXCLUDE (i, vert, bd, nth) FROM {name}c WHERE nth = {r(seed, "est", step)} % s)"""


FOUR_CHAIN = f"""{T}, {PLACED}, {walk0(21)}, k0 AS (SELECT * REPLACE (inv_p * 3 AS inv_p), 1 + {r(21, 'est', 9)} % 3 AS kind FROM w0),
{walk1(21, 'k0', 'w1', 1, 'kind < 3')}, {grown('w1', 'g', 'CASE WHEN kind = 1 THEN id1 ELSE edge_id END', '[v1]', 21, 2)},
h AS (SELECT est, inv_p * s AS inv_p FROM g WHERE ns NOT IN (src, dst) AND nd NOT IN (src, dst) AND (kind = 1 OR nid < id1)),
l AS (SELECT k.*, x.v AS va, deg_src - pos_src - 1 AS fa FROM k0 k JOIN a x ON kind = 3 AND deg_src - pos_src - 1 > 0 AND x.u = k.src AND x.pos = pos_src + 1 + {r(21, 'est', 1)} % greatest(deg_src - pos_src - 1, 1)),
m AS (SELECT l.est, inv_p * fa * (deg_dst - pos_dst - 1) AS inv_p FROM l JOIN a x ON deg_dst - pos_dst - 1 > 0 AND x.u = l.dst AND x.pos = pos_dst + 1 + {r(21, 'est', 2)} % greatest(deg_dst - pos_dst - 1, 1) WHERE x.v <> va),
f AS (SELECT * FROM h UNION ALL SELECT * FROM m) """


@query("est_four_chain", FOUR_CHAIN + summed("f"))
def est_four_chain(spark, sf_dir):
    return estimators.summary(estimators.four_chain(cp(spark, sf_dir), 0, WALKERS, 21), WALKERS)


CANONICAL = "len(list_filter(met, lambda z: z.id = nid)) = 0 AND NOT list_aggregate(list_transform(met, lambda z, i: z.id > nid AND len(list_filter(met[1:i-1], lambda y: y.src IN (ns, nd) OR y.dst IN (ns, nd))) > 0), 'bool_or')"


def generated_sql(p: Pattern, seed: int, n: int = WALKERS, chain: bool = False, extra: str = "true") -> str:
    parts = [T, walk0(seed, n, "e"), "g0 AS (SELECT est, edge_id AS e0, [{'id': edge_id, 'src': src, 'dst': dst}] AS met, [src, dst] AS verts, [src, dst] AS ends, inv_p FROM w0)"]
    for k in range(1, len(p.edges)):
        parts.append(grown(f"g{k - 1}", f"x{k}", "e0", "ends" if chain else "verts", seed, k))
        new = "CASE WHEN ends[1] = ns THEN [nd, ends[2]] WHEN ends[1] = nd THEN [ns, ends[2]] WHEN ends[2] = ns THEN [ends[1], nd] ELSE [ends[1], ns] END"
        pool = "ends" if chain else "verts"
        size = f"= {k + 2}" if chain else f"<= {p.size}"
        parts.append(f"""y{k} AS (SELECT est, e0, list_append(met, {{'id': nid, 'src': ns, 'dst': nd}}) AS met,
  list_concat(verts, list_filter([ns, nd], lambda z: NOT list_contains(verts, z))) AS verts, {new} AS ends,
  inv_p * s / CASE WHEN list_contains({pool}, ns) AND list_contains({pool}, nd) THEN 2 ELSE 1 END AS inv_p FROM x{k} WHERE {CANONICAL}),
g{k} AS MATERIALIZED (SELECT * FROM y{k} WHERE len(verts) {size})""")
    last = f"g{len(p.edges) - 1}"
    if chain:
        parts.append(f"f AS (SELECT * FROM {last})")
    else:
        forms = ", ".join("'" + ",".join(map(str, sorted(a * p.size + b for a, b in f))) + "'" for f in p.forms)
        at = "(list_position(list_sort(verts), {}) - 1)"
        code = f"least({at.format('z.src')}, {at.format('z.dst')}) * {p.size} + greatest({at.format('z.src')}, {at.format('z.dst')})"
        parts.append(f"f AS (SELECT * FROM {last} WHERE len(verts) = {p.size} AND array_to_string(list_sort(list_transform(met, lambda z: {code})), ',') IN ({forms}) AND {extra})")
    return ", ".join(parts) + " " + summed("f", n)


def _generated(name: str, p: Pattern, n: int = WALKERS) -> None:
    @query(name, generated_sql(p, 41, n))
    def run(spark, sf_dir):
        return estimators.summary(estimators.generated(p)(cp(spark, sf_dir), 0, n, 41), n)


_generated("est_generated_wedge", pattern.WEDGE)
_generated("est_generated_triangle", pattern.TRIANGLE)
_generated("est_generated_four_clique", pattern.FOUR_CLIQUE)
_generated("est_generated_five_star", pattern.FIVE_STAR)
_generated("est_generated_five_house", pattern.HOUSE)


@query("est_generated_predicate", generated_sql(pattern.TRIANGLE, 43, extra="list_sum(verts) % 2 = 0"))
def est_generated_predicate(spark, sf_dir):
    """Triangles for which a predicate over the match holds."""
    even = F.aggregate("verts", F.lit(0).cast("long"), lambda s, v: s + v) % 2 == 0
    return estimators.summary(estimators.generated(pattern.TRIANGLE, even)(cp(spark, sf_dir), 0, WALKERS, 43), WALKERS)


@query("est_chain_four", generated_sql(pattern.chain(4), 47, chain=True))
def est_chain_four(spark, sf_dir):
    return estimators.summary(estimators.chain_mining(4)(cp(spark, sf_dir, weighted=False), 0, WALKERS, 47), WALKERS)


@query("est_chain_five", generated_sql(pattern.chain(5), 47, chain=True))
def est_chain_five(spark, sf_dir):
    return estimators.summary(estimators.chain_mining(5)(cp(spark, sf_dir), 0, WALKERS, 47), WALKERS)


@query("est_three_motif_cached", f"""{T}, {PLACED}, {walk0(21, 30000)}, {walk1(21)}, {CLOSED},
ws AS ({summed("(SELECT * FROM w1 WHERE est < 20000)", 20000)}), ts AS ({summed("c", 30000)})
SELECT 'wedge' AS motif, * FROM ws UNION ALL SELECT 'triangle', * FROM ts""")
def est_three_motif_cached(spark, sf_dir):
    """Triangles continue the wedges' estimators and sample afresh above them."""
    wedges, triangles = estimators.three_motif_cached(cp(spark, sf_dir), 20_000, 30_000, 21)
    named = [estimators.summary(x, n).select(F.lit(m).alias("motif"), "*") for x, n, m in ((wedges, 20_000, "wedge"), (triangles, 30_000, "triangle"))]
    return named[0].unionByName(named[1])


def _filtered(where: str) -> str:
    """The tables again, for the edges that satisfy ``where``, with dense ids."""
    return T.replace("e AS MATERIALIZED (", "e9 AS (").replace("FROM raw)", f"FROM raw), e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY edge_id) - 1 AS edge_id, src, dst, weight FROM e9 WHERE {where})")


@query("est_weighted_all", f"{_filtered('weight >= 50')}, {PLACED}, {walk0(53)}, {walk1(53)}, {CLOSED} {summed('c')}")
def est_weighted_all(spark, sf_dir):
    return estimators.weighted_triangle(cp(spark, sf_dir), "weight >= 50", True, WALKERS, 53)


def _part(where: str, seed: int) -> str:
    return f"({_filtered(where)}, {PLACED}, {walk0(seed, WALKERS // 2)}, {walk1(seed)}, {CLOSED} {summed('c', WALKERS // 2)})"


@query("est_weighted_any", f"SELECT CAST({WALKERS} AS BIGINT) AS n, t.successes + o.successes AS successes, t.total - o.total AS total, round((t.total - o.total) / {WALKERS // 2}.0::DOUBLE, 3) AS estimate FROM {_part('true', 53)} t, {_part('NOT weight >= 50', 54)} o")
def est_weighted_any(spark, sf_dir):
    return estimators.weighted_triangle(cp(spark, sf_dir), "weight >= 50", False, WALKERS, 53)


IN_WORKERS = T + f", {WORKERS}, e4 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY edge_id) - 1 AS edge_id, src, dst FROM i), both4 AS (SELECT src AS u, dst AS v, edge_id FROM e4 UNION ALL SELECT dst, src, edge_id FROM e4), a4 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY u ORDER BY edge_id) - 1 AS pos FROM both4), d4 AS (SELECT u, count(*) AS deg FROM a4 GROUP BY u), p4 AS (SELECT e4.*, s.pos AS pos_src, ds.deg AS deg_src, t.pos AS pos_dst, dd.deg AS deg_dst FROM e4 JOIN a4 s ON s.edge_id = e4.edge_id AND s.u = src JOIN a4 t ON t.edge_id = e4.edge_id AND t.u = dst JOIN d4 ds ON ds.u = src JOIN d4 dd ON dd.u = dst)"


@query("est_partitioned_wedge", f"{IN_WORKERS}, {walk0(59, edges='p4', m='(SELECT count(*) FROM e4)')}, {walk1(59, adj='a4')} {summed('w1', scale=16.0)}")
def est_partitioned_wedge(spark, sf_dir):
    """Four workers that see only edges within their vertices; the count is scaled by 4^2."""
    g = cp(spark, sf_dir, weighted=False)
    part = Graph(g.within_workers(_workers(g)).drop("worker")).persist().reindexed().persist()
    return estimators.summary(estimators.wedge(part, 0, WALKERS, 59), WALKERS, estimators.worker_factor(4, 3))


@query("running_estimation", f"""{T}, {PLACED}, {walk0(21)}, {walk1(21)}, b AS (SELECT est // 1000 AS batch_no, CAST(floor(sum(inv_p::DECIMAL(38,6))) AS BIGINT) AS part FROM w1 GROUP BY 1)
SELECT q.batch_no, (q.batch_no + 1) * 1000 AS done, CAST(sum(coalesce(part, 0)) OVER (ORDER BY q.batch_no) AS BIGINT) AS total FROM range({WALKERS // 1000}) q(batch_no) LEFT JOIN b ON b.batch_no = q.batch_no""")
def running_estimation(spark, sf_dir):
    return estimators.running(estimators.wedge(cp(spark, sf_dir), 0, WALKERS, 21), WALKERS, 1000)


@query("estimation_merge", f"""{T}, {PLACED}, {walk0(21)}, {walk1(21)}, b AS (SELECT est % 7 AS k, CAST(floor(sum(inv_p::DECIMAL(38,6))) AS BIGINT) AS total FROM w1 GROUP BY 1),
n AS (SELECT est % 7 AS k, count(*) AS n FROM range({WALKERS}) t(est) GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * (total / n::DOUBLE)) / sum(n), 1) AS mean FROM b JOIN n USING (k)""")
def estimation_merge(spark, sf_dir):
    """Seven partial estimations, merged by their numbers."""
    w = estimators.wedge(cp(spark, sf_dir), 0, WALKERS, 21)
    total = w.groupBy((F.col("est") % 7).alias("k")).agg(estimators.whole_total().alias("total"))
    n = _ids(spark).groupBy((F.col("est") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return estimators.merge(total.join(n, "k").select("n", (F.col("total") / F.col("n")).alias("mean"))).select("n", F.round("mean", 1).alias("mean"))


# Profiles.


@query("regression_origin", "SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS k FROM lineitem")
def regression_origin(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.agg(F.round(profiles.regression_through_origin(F.col("l_quantity"), F.col("l_extendedprice")), 4).alias("k"))


@query("error_bound", f"{T}, t AS (SELECT count(*) AS f FROM ({TRIANGLES})), x AS (SELECT max(deg) AS top FROM d) SELECT CAST(ceil(pow(top, 1) * pow({M}, 1) / f / pow(0.05::DOUBLE, 2) * ln(2 / 0.05::DOUBLE)) AS BIGINT) AS estimators FROM t, x")
def error_bound(spark, sf_dir):
    g = plain(spark, sf_dir)
    row = exact.triangles(g, "f").crossJoin(g.degrees.agg(F.max("deg").alias("top")))  # one row each
    return row.select(F.ceil(profiles.bound(0.05, 0.05, 1, 1, F.col("f"), F.col("top"), g.num_edges)).cast("long").alias("estimators"))


@query("error_profile_num_estimators")
def error_profile_num_estimators(spark, sf_dir):
    """A moving average runs through the points, which SQL has no form for."""
    g = cp(spark, sf_dir, weighted=False)
    n = profiles.ErrorProfile(pattern_edges=3, points=256, more=1 << 15, rate=0.3).num_estimators(g, estimators.triangle, 0.05, 0.95)
    return spark.createDataFrame([("triangle", 0.05, 0.95, n)], "pattern string, error double, confidence double, estimators long")


@query("time_profile")
def time_profile(spark, sf_dir):
    """The best estimate of wedges within two seconds; how far it comes depends on the machine."""
    state = profiles.within_time(cp(spark, sf_dir, weighted=False), estimators.wedge, 2.0, 61)
    return spark.createDataFrame([(state.n > 0, state.mean > 0)], "ran boolean, found boolean")


@query("replicate_statistics", "SELECT round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS variance FROM lineitem")
def replicate_statistics(spark, sf_dir):
    found = profiles.statistics(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x")), "x")
    return found.select(*(F.round(c, 4).alias(c) for c in ("mean", "sd", "variance")))


# Vertex sampling.

REPS, DRAWN = 30, 400
VERTEX = f"""{T}, q AS (SELECT rep, u AS v, row_number() OVER (PARTITION BY rep ORDER BY {r(67, 'rep', 'u')}, u) AS n FROM d, range({REPS}) t(rep)), s AS (SELECT rep, v FROM q WHERE n <= {DRAWN}),
i AS MATERIALIZED (SELECT x.rep, src, dst FROM e JOIN s x ON x.v = src JOIN s y ON y.v = dst AND y.rep = x.rep), b2 AS (SELECT rep, src AS u, dst AS v FROM i UNION ALL SELECT rep, dst, src FROM i),
dg AS (SELECT rep, u, count(*) AS deg FROM b2 GROUP BY rep, u)"""
FOUND = {
    "edges": "SELECT rep, count(*) AS found FROM i GROUP BY rep",
    "triangle": "SELECT x.rep, count(*) AS found FROM i x JOIN i y ON y.rep = x.rep AND y.src = x.dst JOIN i z ON z.rep = x.rep AND z.src = x.src AND z.dst = y.dst GROUP BY x.rep",
    "wedge": "SELECT rep, CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS found FROM dg GROUP BY rep",
    "four_chain": "SELECT x.rep, count(*) AS found FROM b2 x JOIN b2 y ON y.rep = x.rep AND x.v = y.u AND y.v <> x.u JOIN b2 z ON z.rep = x.rep AND y.v = z.u AND z.v <> y.u AND z.v <> x.u AND x.u < z.v GROUP BY x.rep",
    "five_star": "SELECT rep, CAST(sum(deg * (deg - 1) * (deg - 2) * (deg - 3) // 24) AS BIGINT) AS found FROM dg GROUP BY rep",
}
FOUND["three_motif"] = f"SELECT rep, CAST(sum(found) AS BIGINT) AS found FROM ({FOUND['wedge']} UNION ALL {FOUND['triangle']}) GROUP BY rep"


def _estimated(task: str) -> str:
    return f"est AS (SELECT t.rep, coalesce(found, 0) AS found, round(coalesce(found, 0) / pow(least(1.0, {DRAWN}::DOUBLE / (SELECT count(*) FROM d)), {vertex_sampling.SIZES[task]}), 3) AS estimate FROM range({REPS}) t(rep) LEFT JOIN ({FOUND[task]}) x ON x.rep = t.rep)"


def _vertex(task: str) -> None:
    @query(f"vertex_sample_{task}", f"{VERTEX}, {_estimated(task)} SELECT rep, found, estimate FROM est")
    def run(spark, sf_dir):
        return vertex_sampling.estimates(cp(spark, sf_dir, weighted=False), task, DRAWN, REPS, 67)


for _task in FOUND:
    _vertex(_task)


@query("vertex_allocation", f"SELECT rep, {r(71, 'rep', 'ball')} % 4 AS storage, count(*) AS m FROM range(10) t(rep), range(400) b(ball) GROUP BY 1, 2")
def vertex_allocation(spark, sf_dir):
    return vertex_sampling.allocation(4, 400, 10, 71, spark)


@query("storage_sample", f"""{T}, h AS (SELECT u AS v, CAST(floor((row_number() OVER (ORDER BY u) - 1) * 4 / (SELECT count(*) FROM d)::DOUBLE) AS BIGINT) AS storage FROM d),
m AS (SELECT rep, {r(71, 'rep', 'ball')} % 4 AS storage, count(*) AS m FROM range(10) t(rep), range(400) b(ball) GROUP BY 1, 2)
SELECT rep, v FROM (SELECT rep, v, m, row_number() OVER (PARTITION BY rep, storage ORDER BY {r(71, 'rep', 'v')}, v) AS n FROM h JOIN m USING (storage)) WHERE n <= m""")
def storage_sample(spark, sf_dir):
    return vertex_sampling.storage_sample(cp(spark, sf_dir, weighted=False), 4, 400, 10, 71)


@query("ie_stop", f"""{VERTEX}, {_estimated('wedge')}, x AS (SELECT rep + 1 AS t, avg(estimate) OVER o AS mean, stddev_pop(estimate) OVER o AS sd FROM est WINDOW o AS (ORDER BY rep))
SELECT t, round(mean, 1) AS mean, t >= 10 AND mean > 0 AND 1.96::DOUBLE * sd <= 0.1::DOUBLE * sqrt(t) * mean AS stop FROM x""")
def ie_stop(spark, sf_dir):
    found = vertex_sampling.estimates(cp(spark, sf_dir, weighted=False), "wedge", DRAWN, REPS, 67)
    return vertex_sampling.interval_rule(found, 0.05, 0.1).select("t", F.round("mean", 1).alias("mean"), "stop")


@query("stop_in_batches", f"""{VERTEX}, {_estimated('wedge')}, x AS (SELECT rep + 1 AS t, avg(estimate) OVER o AS mean, stddev_pop(estimate) OVER o AS sd FROM est WINDOW o AS (ORDER BY rep))
SELECT t, round(mean, 1) AS mean FROM x WHERE t >= 10 AND mean > 0 AND 1.96::DOUBLE * sd <= 0.2::DOUBLE * sqrt(t) * mean OR t = {REPS} ORDER BY t LIMIT 1""")
def stop_in_batches(spark, sf_dir):
    """Batches of replicates are drawn until the interval is narrow enough, or REPS are."""
    drawn = vertex_sampling.drawn_in_batches(cp(spark, sf_dir, weighted=False), "wedge", DRAWN, 67, 10, REPS)
    t, mean = vertex_sampling.interval_stop(drawn, 0.05, 0.2)
    return spark.createDataFrame([(t, round(mean, 1))], "t long, mean double")


@query("eb_stop")
def eb_stop(spark, sf_dir):
    """Empirical Bernstein stopping is a loop over replicates; at most REPS numbers reach the driver."""
    found = vertex_sampling.estimates(cp(spark, sf_dir, weighted=False), "edges", DRAWN, REPS, 67).orderBy("rep").toPandas().estimate
    t, mean = vertex_sampling.bernstein_stop(found, float(found.max() - found.min()) or 1.0, epsilon=0.2)
    return spark.createDataFrame([(t, round(mean, 1))], "t long, estimate double")


# Patterns.

NAMED = {"wedge": pattern.WEDGE, "triangle": pattern.TRIANGLE, "four_chain": pattern.FOUR_CHAIN, "four_clique": pattern.FOUR_CLIQUE, "five_star": pattern.FIVE_STAR, "five_chain": pattern.FIVE_CHAIN, "five_house": pattern.HOUSE}


@query("pattern_unique_forms", "SELECT * FROM (VALUES ('wedge', 3, 2), ('triangle', 1, 6), ('four_chain', 12, 2), ('four_clique', 1, 24), ('five_star', 5, 24), ('five_chain', 60, 2), ('five_house', 60, 2)) t(pattern, forms, automorphisms)")
def pattern_unique_forms(spark, sf_dir):
    return spark.createDataFrame([(k, len(p.forms), len(p.automorphisms)) for k, p in NAMED.items()], "pattern string, forms int, automorphisms int")


@query("canonical_orders", "SELECT * FROM (VALUES ('wedge', 1), ('triangle', 1), ('four_chain', 1), ('four_clique', 1), ('five_star', 1), ('five_chain', 1), ('five_house', 1)) t(pattern, orders)")
def canonical_orders(spark, sf_dir):
    """Each instance has one accepted order."""
    return spark.createDataFrame([(k, len(p.accepted_orders())) for k, p in NAMED.items()], "pattern string, orders int")


# Formats.


def _folder(spark: SparkSession) -> str:
    return f"{lineage.shared_folder(spark)}/formats-{uuid.uuid4().hex}"


@query("edgelist_roundtrip", f"{T} SELECT src, dst, weight FROM e")
def edgelist_roundtrip(spark, sf_dir):
    g, path = cp(spark, sf_dir), _folder(spark)
    text.write_edgelist(g.edges, path, g.degrees.count(), True)
    return text.read_edgelist(spark, path, True)


@query("biedgelist_roundtrip", f"{T} SELECT src, dst, weight FROM e")
def biedgelist_roundtrip(spark, sf_dir):
    g, path = cp(spark, sf_dir), _folder(spark)
    binary.write_biedgelist(g.edges, path.removeprefix("file://"), True)
    return binary.read_biedgelist(spark, path, True)


@query("partition_files_roundtrip", f"{T} SELECT u, v FROM a")
def partition_files_roundtrip(spark, sf_dir):
    g, path = cp(spark, sf_dir, weighted=False), _folder(spark)
    text.write_partitions(g.edges, path, 4, 1 + (g.edges.agg(F.max("dst")).first()[0] or 0))
    return text.read_partitions(spark, path).select("u", "v")


@query("edgelist_header_check", f"{T} SELECT (SELECT count(*) FROM d) AS vertices, count(*) AS edges, count(*) AS rows, true AS agrees FROM e")
def edgelist_header_check(spark, sf_dir):
    g, path = cp(spark, sf_dir, weighted=False), _folder(spark)
    text.write_edgelist(g.edges, path, g.degrees.count())
    return text.check_header(spark, path)


@query("snap_roundtrip", f"{T} SELECT src, dst FROM e")
def snap_roundtrip(spark, sf_dir):
    g, path = cp(spark, sf_dir, weighted=False), _folder(spark)
    comment = spark.range(1).select(F.lit("# FromNodeId ToNodeId").alias("value"))
    comment.union(g.edges.select(F.concat_ws("\t", "src", "dst").alias("value"))).write.text(path)
    return text.read_snap(spark, path)


@query("meta_roundtrip", f"{T} SELECT count(*) AS num_vertices FROM d")
def meta_roundtrip(spark, sf_dir):
    g, path = cp(spark, sf_dir, weighted=False), _folder(spark)
    text.write_meta(spark, path, g.degrees.count(), g.num_edges)
    return text.read_meta(spark, path)


@query("random_graph")
def random_graph(spark, sf_dir):
    return generators.random_graph(spark, 1000, 16_000, 1).agg(F.count(F.lit(1)).alias("edges"), F.sum(F.when(F.col("src") < F.col("dst"), 0).otherwise(1)).alias("wrong"))
