"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are rotated to their principal axes, most variance first. Two tiles are multiplied over a few leading axes; what the rest can add is at
most the product of the two suffix norms, so a pair is given up as soon as its partial product and that bound stay under the threshold. Rows and
columns without a surviving pair leave the tile, and the axes go on for the others. Pairs that survive are decided by their whole vectors as they
were given, in double precision.

Strips of the first axis bound which tiles meet at all: vectors whose first coordinates differ by more than sqrt(2 - 2 t) cannot reach a cosine of t.
Strips are cut at quantiles, counted, and a strip that holds too many vectors all the same (one first coordinate may be that of all) is dealt to
several cells by hash, so a task holds two cells of a bounded size. Each cell knows the range of cells that it meets; no list of pairs exists.
The rotation is fitted on a bounded sample (``SAMPLE_BYTES``); it only orders the work, any rotation gives the same links.

Equal vectors are one class with a count from the start. No pair is emitted: a task gives each vector's number of links and a spanning forest of
its links, at most one row a vector for each cell that its own cell meets.

Defined results: a vector that is null, of length 0, zero, or with a null or non-finite component links with nothing and is its own component.
Vectors of different lengths don't link. Rows that repeat a vec_id are one node and several vectors. A null vec_id links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import scratch
from tallygraph.llm.kernel import mix64
from tallygraph.llm.components import components, forest
from tallygraph.functions.ship import ship

TILE = 1024
CELL_BYTES = 16 << 20
#: Fewest strips, so that small inputs use more than one task.
STRIPS = 6
SAMPLE_BYTES = 8 << 20
#: Rounding of strips: their reach is this much wider.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def axes_of(sample: np.ndarray) -> np.ndarray:
    """Columns: the principal axes of unit vectors about the origin, most variance first."""
    _, v = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(v[:, ::-1])


def steps_of(d: int) -> list[int]:
    """Where the partial products stop to compare: 8, 16, 32, ... and all axes."""
    return [*(1 << k for k in range(3, 20) if 1 << k < d), d]


def slack(d: int) -> float:
    """How much wider than the threshold the bounds are: more than single precision loses in sums of d products."""
    return (4 * d + 64) * float(np.finfo(np.float32).eps)


def linked(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors (rows of a and b) whose cosine is at least ``least``; ra and rb are a and b rotated, in single precision."""
    d = ra.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total, start = np.zeros((len(a), len(b)), ra.dtype), 0
    floor = ra.dtype.type(least - slack(d))
    for stop in steps_of(d):
        total = total + ra[rows, start:stop] @ rb[cols, start:stop].T
        start = stop
        if stop == d:
            alive = total >= floor
        else:
            sa, sb = (np.sqrt(np.maximum(np.einsum("ij,ij->i", r[k, stop:], r[k, stop:]), 0)) for r, k in ((ra, rows), (rb, cols)))
            alive = total + np.multiply.outer(sa, sb) >= floor
        i, j = np.nonzero(alive)
        if len(i) == 0:
            return i, j
        if stop == d or len(i) * 64 < alive.size:
            break
        keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
        rows, cols, total = rows[keep_r], cols[keep_c], total[np.ix_(keep_r, keep_c)]
    i, j = rows[i], cols[j]
    ok = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536)])
    return i[ok], j[ok]


def _tiles(d: int):
    def made(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def tile(rows: pa.Table) -> pa.RecordBatch:
            values = np.ascontiguousarray(rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            blobs = [pa.array([rows.column(c).to_numpy().tobytes()], pa.binary()) for c in ("rep", "name", "many")]
            return pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int64()) for k in key[:3]), *blobs, pa.array([values.tobytes()], pa.binary())], ["cell", "lowest", "highest", "ids", "names", "many", "x"])

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= TILE:
                rows = pa.Table.from_batches(held)
                for k in range(0, len(rows) - TILE + 1, TILE):
                    yield tile(rows.slice(k, TILE))
                held = rows.slice(len(rows) // TILE * TILE).to_batches()
                count = sum(map(len, held))
        if count:
            yield tile(pa.Table.from_batches(held))

    return made


def _meet(d: int, axes, least: float):
    def met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = key[0].as_py(), key[1].as_py()
        tiles: dict[int, list] = {first: [], second: []}
        for batch in batches:
            for s, i, name, m, x in zip(*(batch.column(c).to_pylist() for c in ("cell", "ids", "names", "many", "x")), strict=True):
                unit = _unit(np.frombuffer(x).reshape(-1, d))
                tiles[s].append((np.frombuffer(i, np.int64), np.frombuffer(m, np.int64), unit, (unit @ axes.value).astype(np.float32), np.frombuffer(name, np.int64)))
        reach = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
        total = {s: [np.zeros(len(t[0]), np.int64) for t in tiles[s]] for s in tiles}
        us, vs, pending = [], [], 0
        for p, (ia, ma, xa, ra, _) in enumerate(tiles[first]):
            for q, (ib, mb, xb, rb, _) in enumerate(tiles[second]):
                if first == second and q < p or ra[:, 0].min() - rb[:, 0].max() > reach or rb[:, 0].min() - ra[:, 0].max() > reach:
                    continue
                i, j = linked(xa, xb, ra, rb, least)
                if first == second and p == q:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                total[first][p] += np.bincount(i, mb[j], len(ia)).astype(np.int64)
                total[second][q] += np.bincount(j, ma[i], len(ib)).astype(np.int64)
                u, v = forest(ia[i], ib[j])
                us.append(u)
                vs.append(v)
                pending += len(u)
                if pending > 1 << 19:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, pending = [u], [v], 0
        for s in tiles:
            for (ids, *_, names), n in zip(tiles[s], total[s], strict=True):
                at = n > 0
                if at.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(names[at]), pa.array(n[at]), pa.nulls(int(at.sum()), pa.int64())], ["u", "name", "n", "v"])
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(np.zeros(len(u), np.int64)), pa.array(v)], ["u", "name", "n", "v"])

    return met


def _found(classes: DataFrame, d: int, least: float) -> DataFrame:
    """(u, name, n, v): numbers of links of classes, and the links of a spanning forest of their representatives, for one length."""
    spark = classes.sparkSession
    rows = classes.where(F.size("x") == d)
    count = rows.count()
    sample = max(d + 1, SAMPLE_BYTES // (8 * d))
    some = rows.orderBy(F.xxhash64(F.lit(3), "rep")).limit(sample).select("x").toPandas()  # SAMPLE_BYTES
    unit = _unit(np.array(some.x.tolist()))
    axes = axes_of(unit)
    shared = spark.sparkContext.broadcast(axes)
    strips = max(min(STRIPS, -(-count // TILE)), -(-count * d * 8 // CELL_BYTES))
    cuts = np.quantile(unit @ axes[:, 0], np.arange(1, strips) / strips)
    lead = spark.sparkContext.broadcast((axes[:, 0], cuts))

    def strips_of(batch: pa.RecordBatch) -> np.ndarray:
        axis, at = lead.value
        x = np.ascontiguousarray(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        return np.searchsorted(at, _unit(x) @ axis if len(x) else np.zeros(0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strip, n = np.unique(strips_of(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(strip), pa.array(n)], ["strip", "n"])

    counts = np.zeros(strips, np.int64)
    for strip, n in rows.select("x").mapInArrow(counted, "strip long, n long").groupBy("strip").agg(F.sum("n")).collect():  # a row for each CELL_BYTES of vectors
        counts[strip] = n
    cells = spark.sparkContext.broadcast(cells_of(counts * d * 8, cuts, math.sqrt(max(0.0, 2 - 2 * least)) + SLACK))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, parts, lowest, highest = cells.value
        for batch in batches:
            strip = strips_of(batch)
            rep = batch.column("rep").to_numpy(zero_copy_only=False).astype(np.uint64)
            cell = base[strip] + (mix64(rep, 4) % parts[strip].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "name", "many", "x")), pa.array(cell), pa.array(lowest[strip]), pa.array(highest[strip])], ["rep", "name", "many", "x", "cell", "lowest", "highest"])

    dealt = rows.select("rep", "name", "many", "x").mapInArrow(placed, "rep long, name long, many long, x array<double>, cell long, lowest long, highest long")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(4)))  # a cell's tiles are packed by four tasks
    tiles = scratch.stage(dealt.groupBy("cell", "lowest", "highest", "part").applyInArrow(_tiles(d), "cell long, lowest long, highest long, ids binary, names binary, many binary, x binary"), "tiles")
    here = F.col("cell")
    meet = F.transform(F.sequence("lowest", "highest"), lambda j: F.struct(F.least(here, j).alias("a"), F.greatest(here, j).alias("b")))
    sent = tiles.withColumn("m", F.explode(meet)).select(F.col("m.a").alias("a"), F.col("m.b").alias("b"), "cell", "ids", "names", "many", "x")
    return sent.groupBy("a", "b").applyInArrow(_meet(d, shared, least), "u long, name long, n long, v long")


def cells_of(volumes: np.ndarray, cuts: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base, parts, lowest, highest) of each strip: its cells are base to base + parts - 1, and they meet the cells lowest to highest."""
    parts = np.maximum(1, -(-volumes // CELL_BYTES))
    base = np.cumsum(parts) - parts
    low, high = np.append(-np.inf, cuts), np.append(cuts, np.inf)
    first = np.searchsorted(high, low - reach)  # the first strip that ends within reach
    last = np.searchsorted(low, high + reach, side="right") - 1
    return base, parts, base[first], base[last] + parts[last] - 1


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    rows = scratch.stage(vectors.select("vec_id", x.alias("x")), "vectors")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    good = rows.where("vec_id is not null and size(x) > 0").where(~bad & F.exists("x", lambda v: v != 0))
    named = good.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    classes = scratch.stage(named.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")).withColumn("name", F.xxhash64("x", "rep")), "classes")
    lengths = [r[0] for r in classes.select(F.size("x")).distinct().collect()]  # the models' dimensions
    found = None
    for d in sorted(lengths):
        part = _found(classes, d, least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "u long, name long, n long, v long")
    found = scratch.stage(found, "links")
    member = scratch.stage(named.join(classes, "x").select("vec_id", "rep", "name", "many"), "members")
    counted = found.where("v is null").groupBy(F.col("u").alias("rep"), "name").agg(F.sum("n").alias("n"))
    tops = components(found.where("v is not null").select("u", "v").unionByName(member.where("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))))
    linked_rows = member.join(counted, ["rep", "name"], "left").join(tops.select(F.col("u").alias("vec_id"), F.col("v").alias("top")), "vec_id", "left")
    done = linked_rows.select("vec_id", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("top", "vec_id").alias("component_id"))
    alone = rows.where(F.col("vec_id").isNull() | F.coalesce(F.size("x") <= 0, F.lit(True)) | bad | ~F.exists("x", lambda v: v != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"))
    alone = alone.join(tops.select(F.col("u").alias("vec_id"), F.col("v").alias("top")), "vec_id", "left").select("vec_id", "n_links", F.coalesce("top", "vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
