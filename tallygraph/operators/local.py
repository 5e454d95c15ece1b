"""Triangles without a shuffle of wedges: vertices get one of few colours, and a task holds all edges between three colours.

With c colours a task's three blocks of edges are about 6 / c^2 of the graph, and each edge goes to c tasks, packed. So what is shuffled is c times the
edges, whatever the number of wedges; the number of colours follows the number of edges. A task points its edges from the smaller to the larger
degree, so a hub makes no quadratic number of wedges, and looks the wedges' third edges up in memory, some at a time.

``Blocks`` keeps the packed edges once, in the shared folder, and sends them to a part of the tasks at a time: then no more than ``COPIES`` copies of the
edges are in shuffle files at once, however many colours there are. Edges may repeat in what it reads; they don't in a block.

4-cycles: vertices are numbered by degree, so that a 4-cycle is two paths of two edges from its last vertex to the one across, both by smaller middles. The
directed edges are written in parts by their second end. A task reads two parts and has all paths between their vertices, whose number only it needs to
know: some at a time, in memory. Every two parts meet by a Cartesian product of the written rows, which shuffles nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.functions import lineage
from tallygraph.functions.ship import ship

#: Edges of a task, about; edges packed at once; wedges looked up at once.
TASK_EDGES, PACKED, WEDGES = 3_000_000, 1 << 21, 1 << 20
#: Graphs of fewer edges are one task.
ONE_TASK = 20_000
NONE = np.iinfo(np.int64).min
#: Copies of the edges that are sent to tasks at once.
COPIES = 3
PACKED_ROWS = "task long, n long, edges binary"
#: Directed edges of a part, about, of which every two meet in a task.
PART_EDGES = 2_000_000
#: Bytes of parts that a task reads of either side: its executor holds those of the right side.
PARTS_READ = "16m"
#: What a task by block gets: its edges, the tables of its two colours, the numbers of its edges.
EDGES, TABLE, NUMBERS = range(3)


def colours(num_edges: int) -> int:
    return 1 if num_edges <= ONE_TASK else max(4, math.ceil(math.sqrt(6 * num_edges / TASK_EDGES)))


def colour(ids: np.ndarray, count: int) -> np.ndarray:
    mixed = ids.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(factor)
    return ((mixed >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


def pack(columns: list[np.ndarray], short: bool = False) -> bytes:
    """Columns of 8 bytes, the first of them sorted, by planes of bytes; with ``short`` of numbers from 0 that fit 4."""
    first = np.diff(columns[0], prepend=np.int64(0))
    kind = np.dtype(np.uint32 if short else np.int64)
    planes = [np.ascontiguousarray(c.astype(kind, copy=False).view(np.uint8).reshape(-1, kind.itemsize).T) for c in (first, *columns[1:])]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _packed_row(task: int, n: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], ["task", "n", "edges"])


def unpack(blob: bytes, rows: int, columns: int, short: bool = False) -> list[np.ndarray]:
    kind = np.dtype(np.uint32 if short else np.int64)
    planes = np.frombuffer(pa.decompress(blob, rows * columns * kind.itemsize, codec="zstd"), np.uint8).reshape(columns, kind.itemsize, rows)
    found = [np.ascontiguousarray(p.T).view(kind).ravel() for p in planes]
    return [np.cumsum(found[0], dtype=np.int64), *found[1:]]


def _dealt(count: int, names: list[str], once: bool = False):
    """Packed edges, a row for each task that meets their two colours; or with ``once`` one row, by the block of their colours."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            p, q = colour(columns[0], count), colour(columns[1], count)
            block = np.minimum(p, q) * count + np.maximum(p, q)
            order = np.lexsort((columns[1], columns[0], block))
            columns, block = [c[order] for c in columns], block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                i, j = divmod(int(block[low]), count)
                tasks = [sorted((i, j, k)) for k in range(count)]
                blob = pack([c[low:high] for c in columns])
                if once:
                    yield _packed_row(int(block[low]), high - low, blob)
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([(a * count + b) * count + c for a, b, c in tasks], pa.int64()), pa.array([high - low] * count, pa.int64()), pa.array([blob] * count, pa.binary())], ["task", "n", "edges"])

        total = 0
        for batch in batches:
            if not len(batch):
                continue
            row = [batch.column(c).fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            held.append(row)
            total += len(batch)
            if total >= PACKED:
                yield from flush()
                held, total = [], 0
        if held:
            yield from flush()

    return packed


def closed_wedges(src: np.ndarray, dst: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y1, y2, e1, e2, e3) for some triangles at a time: their vertices, and the places of the edges x-y1, x-y2 and y1-y2 in the input."""
    m = len(src)
    ids, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
    n = len(ids)
    by_degree = np.argsort(np.bincount(ends, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_degree] = np.arange(n)
    ids, ends = ids[by_degree], rank[ends]
    key = np.minimum(ends[:m], ends[m:]) * n + np.maximum(ends[:m], ends[m:])
    del ends
    place = np.argsort(key, kind="stable")
    key = key[place]
    x, y = np.divmod(key, n)
    behind = np.cumsum(np.bincount(x, minlength=n))[x] - np.arange(m) - 1
    shift = np.uint64(64 - max(10, math.ceil(math.log2(8 * m + 1))))
    spread = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    there = np.zeros(1 << (64 - int(shift)), bool)
    there[spread(key)] = True
    upto = np.cumsum(behind)
    first = 0
    while first < m:
        done = upto[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(upto, done + WEDGES, side="right")))
        width = behind[first:stop]
        p = np.repeat(np.arange(first, stop), width)
        q = p + 1 + np.arange(len(p)) - np.repeat(upto[first:stop] - width - done, width)
        third = y[p] * n + y[q]
        may = np.flatnonzero(there[spread(third)])
        third = third[may]
        e = np.minimum(np.searchsorted(key, third), m - 1)
        ok = key[e] == third
        p, q, e = p[may[ok]], q[may[ok]], e[ok]
        if len(p):
            yield ids[x[p]], ids[y[p]], ids[y[q]], place[p], place[q], place[e]
        first = stop


def _unpacked(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    parts = [unpack(blob.as_py(), n.as_py(), columns) for batch in batches for n, blob in zip(batch.column("n"), batch.column("edges"), strict=True)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _distinct(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's edges, each once."""
    src, dst = _unpacked(batches, 2)
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = np.concatenate(([True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])))
    src, dst = src[new], dst[new]
    for first in range(0, len(src), PACKED):
        part = src[first : first + PACKED], dst[first : first + PACKED]
        yield _packed_row(key[0].as_py(), len(part[0]), pack(list(part)))


def _by_part(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packed rows for each part."""
    order = np.lexsort((*columns[::-1], part))
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield _packed_row(int(part[low]), int(high - low), pack([c[low:high] for c in columns]))


def _tallied(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, and the sum of its numbers."""
    found, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, times)
    return found, total


class Blocks:
    """The distinct edges of (src, dst) with src < dst, packed by the colours of their ends and written once."""

    def __init__(self, edges: DataFrame, num_edges: int) -> None:
        """``num_edges`` may be an upper bound."""
        self.spark, self.edges, self.count = edges.sparkSession, num_edges, colours(num_edges)
        ship(self.spark)
        named = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src < dst")
        sent = named.mapInArrow(_dealt(self.count, ["src", "dst"], True), PACKED_ROWS)
        self.rows = lineage.written(sent.groupBy("task").applyInArrow(_distinct, PACKED_ROWS), "blocks")
        del named, sent
        lineage.release(self.spark)

    def rounds(self, work, schema: str) -> DataFrame:
        """What ``work`` gives for each task of three colours; it gets (task, n, edges), some tasks at a time, and its rows are written."""
        c, out = self.count, None
        tasks = [(i, j, k) for i in range(c) for j in range(i, c) for k in range(j, c)]
        times = max(1, math.ceil(c / COPIES))
        for r in range(times):
            to = [(i * c + j, (t[0] * c + t[1]) * c + t[2]) for t in tasks[r::times] for i, j in sorted({(t[0], t[1]), (t[0], t[2]), (t[1], t[2])})]
            sent = self.rows.withColumnRenamed("task", "block").join(F.broadcast(self.spark.createDataFrame(to, "block long, task long")), "block").select("task", "n", "edges")
            done = lineage.written(sent.groupBy("task").applyInArrow(work, schema), "round")
            out = done if out is None else out.unionByName(done)
            del sent
            lineage.release(self.spark)
        return out

    def triangles(self) -> int:
        return int(self.rounds(_found(self.count, 2, False), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def wedges(self) -> int:
        """Pairs of edges at a vertex: the ends of a block's edges, added up for each colour of vertices."""
        count = self.count

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, blob in zip(batch.column("n").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                    ids, deg = np.unique(np.concatenate(unpack(blob, n, 2)), return_counts=True)
                    yield from _by_part(colour(ids, count), [ids, deg.astype(np.int64)])

        def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            deg = _tallied(*_unpacked(batches, 2))[1]
            yield pa.RecordBatch.from_arrays([pa.array([int((deg * (deg - 1) // 2).sum())], pa.int64())], ["n"])

        parts = self.rows.select("n", "edges").mapInArrow(ends, PACKED_ROWS)
        return int(parts.groupBy("task").applyInArrow(added, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def triangles_per_vertex(self) -> DataFrame:
        """(v, triangles) for vertices in any."""
        count, found = self.count, _corners(self.count)

        def tallied(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, times, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            for x, y1, y2 in found(key, batches):
                held += [x, y1, y2]
                size += 3 * len(x)
                if size > WEDGES:
                    ids, times = _tallied(np.concatenate((ids, *held)), np.concatenate((times, np.ones(size, np.int64))))
                    held, size = [], 0
            ids, times = _tallied(np.concatenate((ids, *held)), np.concatenate((times, np.ones(size, np.int64))))
            yield from _by_part(colour(ids, count), [ids, times])

        def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, times = _tallied(*_unpacked(batches, 2))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(times)], ["v", "triangles"])

        return self.rounds(tallied, PACKED_ROWS).groupBy("task").applyInArrow(added, "v long, triangles long")

    @cached_property
    def degree_rows(self) -> DataFrame:
        """The degrees, a packed row (ids, degrees) for each colour."""
        count = self.count

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, blob in zip(batch.column("n").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                    ids, deg = np.unique(np.concatenate(unpack(blob, n, 2)), return_counts=True)
                    yield from _by_part(colour(ids, count), [ids, deg.astype(np.int64)])

        def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, deg = _tallied(*_unpacked(batches, 2))
            yield _packed_row(key[0].as_py(), len(ids), pack([ids, deg]))

        return lineage.written(self.rows.select("n", "edges").mapInArrow(ends, PACKED_ROWS).groupBy("task").applyInArrow(added, PACKED_ROWS), "degrees")

    def degrees(self) -> DataFrame:
        """(v, deg) for all vertices."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, blob in zip(batch.column("n").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack(blob, n, 2)], ["v", "deg"])

        return self.degree_rows.select("n", "edges").mapInArrow(rows, "v long, deg long")

    def _ranks(self) -> tuple[DataFrame, int]:
        """Tables (ids, ranks) of the vertices by (degree, colour, id), a packed row for each colour; and the number of vertices."""

        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task, n, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "n", "edges")), strict=True):
                    deg, times = np.unique(unpack(blob, n, 2)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(deg), pa.array(np.full(len(deg), task)), pa.array(times.astype(np.int64))], ["deg", "task", "times"])

        # A row for each colour and different degree, of which there are fewer than the root of four times the edges.
        found = sorted(map(tuple, self.degree_rows.mapInArrow(levels, "deg long, task long, times long").collect()))
        begins: dict[int, tuple[list[int], list[int]]] = {}
        total = 0
        for deg, task, times in found:
            for held, value in zip(begins.setdefault(task, ([], [])), (deg, total), strict=True):
                held.append(value)
            total += times

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task, n, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "n", "edges")), strict=True):
                    ids, deg = unpack(blob, n, 2)
                    level = np.searchsorted(np.array(begins[task][0]), deg)
                    order = np.argsort(level, kind="stable")
                    among = np.arange(n) - np.searchsorted(level[order], level[order])
                    rank = np.empty(n, np.int64)
                    rank[order] = np.array(begins[task][1], np.int64)[level[order]] + among
                    yield _packed_row(task, n, pack([ids, rank]))

        return self.degree_rows.mapInArrow(numbered, PACKED_ROWS), total

    def _by_block(self, tables: DataFrame, work, numbers: DataFrame | None = None) -> DataFrame:
        """Packed rows that ``work`` gives for each block: of its edges, in order, the values of their ends in ``tables``, and the edges' numbers if there are any."""
        c = self.count
        of = [(k, i * c + j) for i in range(c) for j in range(i, c) for k in sorted({i, j})]
        tables = tables.withColumnRenamed("task", "colour").join(F.broadcast(self.spark.createDataFrame(of, "colour long, task long")), "colour")
        sent = self.rows.withColumn("kind", F.lit(EDGES)).unionByName(tables.drop("colour").withColumn("kind", F.lit(TABLE)))
        if numbers is not None:
            sent = sent.unionByName(numbers.withColumn("kind", F.lit(NUMBERS)))

        def looked_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple[list, list, list] = ([], [], [])
            for batch in batches:
                for kind, n, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "edges")), strict=True):
                    held[kind].append(unpack(blob, n, 2))
            src, dst = (np.concatenate(z) for z in zip(*held[EDGES], strict=True))
            order = np.lexsort((dst, src))
            src, dst = src[order], dst[order]
            ids, values = (np.concatenate(z) for z in zip(*held[TABLE], strict=True))
            order = np.argsort(ids)
            ids, values = ids[order], values[order]
            yield from work(src, dst, *(values[np.searchsorted(ids, end)] for end in (src, dst)), sum(z[1] for z in held[NUMBERS]))

        return sent.groupBy("task").applyInArrow(looked_up, PACKED_ROWS)

    def near_sums(self) -> DataFrame:
        """(v, s, q): the sum over a vertex's neighbours of their degrees less one, and that of the squares."""
        count = self.count

        def halves(src, dst, deg_src, deg_dst, _) -> Iterator[pa.RecordBatch]:
            yield from near(np.concatenate((src, dst)), np.concatenate((deg_dst, deg_src)) - 1)

        def near(v: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, s = _tallied(v, more)
            yield from _by_part(colour(ids, count), [ids, s, _tallied(v, more * more)[1]])

        def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, s, q = _unpacked(batches, 3)
            ids, total = _tallied(v, s)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(_tallied(v, q)[1])], ["v", "s", "q"])

        return lineage.written(self._by_block(self.degree_rows, halves).groupBy("task").applyInArrow(added, "v long, s long, q long"), "sums")

    def _triangles_on_edges(self) -> DataFrame:
        """The triangles on each edge of a block, the edges in order: a packed row (0, triangles) for each block."""
        count = self.count

        def tallied(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = key[0].as_py()
            mixed = len({task // count**2, task // count % count, task % count}) == 2
            src, dst = _unpacked(batches, 2)
            times = np.zeros(len(src), np.int64)
            for x, y1, y2, *places in closed_wedges(src, dst):
                if mixed:
                    c = colour(x, count)
                    keep = (c != colour(y1, count)) | (c != colour(y2, count))
                    places = [e[keep] for e in places]
                for e in places:
                    np.add.at(times, e, 1)
            p, q = colour(src, count), colour(dst, count)
            block = np.minimum(p, q) * count + np.maximum(p, q)
            order = np.lexsort((dst, src, block))
            block, times = block[order], times[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                yield _packed_row(int(block[low]), int(high - low), pack([np.zeros(high - low, np.int64), times[low:high]]))

        def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for n, blob in zip(batch.column("n").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                    total = total + unpack(blob, n, 2)[1]
            yield _packed_row(key[0].as_py(), len(total), pack([np.zeros(len(total), np.int64), total]))

        parts = self.rounds(tallied, PACKED_ROWS)
        found = lineage.written(parts.groupBy("task").applyInArrow(added, PACKED_ROWS), "on-edges")
        lineage.remove(parts)
        return found

    def _parts(self, numbers: DataFrame | None) -> tuple[DataFrame, int, int]:
        """The directed edges (u, w) by ranks, with their number if there are any, in parts by w: packed rows (u, w // parts[, number]), a row for each part.
        And how many parts and vertices."""
        tables, vertices = self._ranks()
        edges = int(self.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        parts = 1 if edges <= ONE_TASK else max(4, math.ceil(2 * edges / PART_EDGES))
        columns, short = 2 if numbers is None else 3, vertices < 1 << 32

        def directed(src, dst, a, b, number) -> Iterator[pa.RecordBatch]:
            w = np.concatenate((b, a))
            yield from _by_part(w % parts, [np.concatenate((a, b)), w // parts, *([np.concatenate((number, number))] if columns == 3 else [])])

        def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _unpacked(batches, columns)
            order = np.lexsort((found[1], found[0]))
            yield _packed_row(key[0].as_py(), len(order), pack([c[order] for c in found], short))

        return lineage.written(self._by_block(tables, directed, numbers).groupBy("task").applyInArrow(merged, PACKED_ROWS), "parts"), parts, vertices

    def _paths(self, rows: DataFrame, parts: int, vertices: int, numbered: bool) -> int:
        """Over all pairs of a last vertex and one across, with k paths between them: the sum of k (k - 1) / 2; or ``numbered`` that of k - 1 times the
        numbers of the paths' edges."""
        here, columns, short = vertices // parts + 1, 3 if numbered else 2, vertices < 1 << 32

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, left = -1, None
            for batch in batches:
                for i, n, blob, j, n2, blob2 in zip(*(batch.column(c) for c in ("task", "n", "edges", "task2", "n2", "edges2")), strict=True):
                    if i.as_py() != held:
                        held = i.as_py()
                        left = _down(unpack(blob.as_py(), n.as_py(), columns, short), parts, held)
                    total = _pairs_of_paths(left, unpack(blob2.as_py(), n2.as_py(), columns, short), parts, j.as_py(), here)
                    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

        other = rows.select(*(F.col(c).alias(f"{c}2") for c in rows.columns))
        pairs = rows.hint("shuffle_replicate_nl").crossJoin(other)  # each two written rows, read by their task
        once, files = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1"), ("spark.sql.files.maxPartitionBytes", PARTS_READ)
        with lineage.dropping(self.spark), lineage.setting(self.spark, *once), lineage.setting(self.spark, *files):  # a row is two parts
            return int(pairs.mapInArrow(met, "n long").agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(0))).first()[0])

    def four_cycles(self) -> int:
        """Two paths from a last vertex to one across are a 4-cycle."""
        rows, parts, vertices = self._parts(None)
        found = self._paths(rows, parts, vertices, False)
        lineage.remove(rows)
        return found

    def five_houses(self) -> int:
        """Over all edges the triangles (t) times the 4-cycles on them, less 2 t (t - 1): the pairs in which the roof is a corner of the square."""
        rows, parts, vertices = self._parts(self._triangles_on_edges())

        def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task, n, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "n", "edges")), strict=True):
                    t = _down(unpack(blob, n, 3, vertices < 1 << 32), parts, task)[2]
                    yield pa.RecordBatch.from_arrays([pa.array([int((2 * t * (t - 1)).sum())], pa.int64())], ["n"])

        less = int(rows.mapInArrow(corners, "n long").agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(0))).first()[0])
        found = self._paths(rows, parts, vertices, True) - less
        lineage.remove(rows)
        return found

    def four_cliques(self) -> int:
        """A 4-clique's triangles at its smallest vertex are a triangle of the edges between the other three."""
        fans, found = max(1, math.ceil(16 * self.edges / TASK_EDGES)), _corners(self.count)

        def by_smallest(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                corners = np.sort(np.column_stack([np.concatenate(c) for c in zip(*held, strict=True)]), axis=1)
                yield from _by_part(colour(corners[:, 0], fans), [np.ascontiguousarray(c) for c in corners.T])

            for corners in found(key, batches):
                held.append(corners)
                size += len(corners[0])
                if size > WEDGES:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        def closed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _closed_fans(key, iter([pa.RecordBatch.from_arrays([pa.array(c) for c in _unpacked(batches, 3)], ["a", "b", "c"])]))

        return int(self.rounds(by_smallest, PACKED_ROWS).groupBy("task").applyInArrow(closed, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _down(part: list[np.ndarray], parts: int, at: int) -> tuple[np.ndarray, ...]:
    """Of a part's edges (u, w) those to a smaller u: u and w, by w, and the edges' numbers if there are any."""
    u, w = part[0], part[1].astype(np.int64) * parts + at
    keep = np.flatnonzero(u < w)
    keep = keep[np.argsort(w[keep], kind="stable")]
    return u[keep], w[keep], *(c[keep].astype(np.int64) for c in part[2:])


def _pairs_of_paths(left: tuple[np.ndarray, ...], right: list[np.ndarray], parts: int, at: int, here: int) -> int:
    """What ``Blocks._paths`` sums, for the last vertices of one part and the vertices across of another, of which there are at most ``here``."""
    u, last = left[:2]
    across = right[1].astype(np.uint32)
    if here * parts <= len(right[0]):
        cuts = np.concatenate(([0], np.cumsum(np.bincount(right[0], minlength=here * parts))))
        low, width = cuts[u], cuts[u + 1] - cuts[u]
        del cuts
    else:
        low = np.searchsorted(right[0], u)
        width = np.searchsorted(right[0], u, side="right") - low
    there = np.flatnonzero(width)
    low, width, last = low[there], width[there], last[there]
    below = np.minimum((last - at + parts - 1) // parts, (1 << 32) - 1).astype(np.uint32)  # across comes before the last
    numbers = [left[2][there], right[2].astype(np.int64)] if len(left) > 2 else []
    m = len(there)
    new = np.diff(last, prepend=-1) != 0
    last, begins = np.cumsum(new) - 1, np.append(np.flatnonzero(new), m)
    ends = np.cumsum(width)
    total = first = 0
    while first < m:
        done = ends[first - 1] if first else 0
        stop = int(np.searchsorted(ends, done + WEDGES, side="right"))
        whole = last[stop] if stop < m else len(begins) - 1  # all paths of a last vertex together; their ends' numbers fit 32 bits
        stop = int(begins[min(max(whole, last[first] + 1), last[first] + (1 << 32) // here)])
        some = width[first:stop]
        q = np.arange(ends[stop - 1] - done) + np.repeat(low[first:stop] - (ends[first:stop] - some - done), some)
        w = across[q]
        keep = np.flatnonzero(w < np.repeat(below[first:stop], some))
        pair = (np.repeat(((last[first:stop] - last[first]) * here).astype(np.uint32), some) + w)[keep]
        if numbers:
            pair = (pair.astype(np.uint64) << np.uint64(31)) | (np.repeat(numbers[0][first:stop], some) + numbers[1][q])[keep].astype(np.uint64)
        first = stop
        if not len(pair):
            continue
        pair.sort()
        if numbers:
            number = (pair & np.uint64((1 << 31) - 1)).astype(np.int64)
            pair >>= np.uint64(31)
        at_new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        k = np.diff(np.append(at_new, len(pair)))
        total += int(((k - 1) * np.add.reduceat(number, at_new)).sum()) if numbers else int((k * (k - 1) // 2).sum())
    return total


def _corners(count: int):
    """The corners of the triangles of one task that have exactly its colours, some at a time."""

    def found(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        task = key[0].as_py()
        mixed = len({task // count**2, task // count % count, task % count}) == 2
        for x, y1, y2, *_ in closed_wedges(*_unpacked(batches, 2)):
            if mixed:
                c = colour(x, count)
                keep = (c != colour(y1, count)) | (c != colour(y2, count))
                x, y1, y2 = x[keep], y1[keep], y2[keep]
            yield x, y1, y2

    return found


def _found(count: int, columns: int, rows: bool):
    """The triangles of one task that have exactly its colours."""

    def closed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = key[0].as_py()
        mixed = len({task // count**2, task // count % count, task % count}) == 2  # such a task also holds triangles of one colour, which are another's
        parts = [unpack(blob.as_py(), n.as_py(), columns) for batch in batches for n, blob in zip(batch.column("n"), batch.column("edges"), strict=True)]
        edges = [np.concatenate(c) for c in zip(*parts, strict=True)]
        del parts
        total = 0
        for x, y1, y2, e1, e2, e3 in closed_wedges(edges[0], edges[1]):
            if mixed:
                c = colour(x, count)
                keep = (c != colour(y1, count)) | (c != colour(y2, count))
                x, y1, y2, e1, e2, e3 = (z[keep] for z in (x, y1, y2, e1, e2, e3))
            total += len(x)
            if rows:
                corners = np.column_stack((x, y1, y2))
                order = np.argsort(corners, axis=1)
                out = list(np.take_along_axis(corners, order, axis=1).T)
                names = ["a", "b", "c"]
                if columns == 3:
                    across = np.take_along_axis(np.column_stack((edges[2][e3], edges[2][e2], edges[2][e1])), order, axis=1)
                    out += [across[:, 2], across[:, 1], across[:, 0]]
                    names += ["w_ab", "w_ac", "w_bc"]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(o), pa.int64(), mask=(o == NONE) if at > 2 else None) for at, o in enumerate(out)], names)
        if not rows:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return closed


def triangles(edges: DataFrame, num_edges: int, rows: bool) -> DataFrame:
    """Of unique edges (src, dst[, weight]): the triangles (a, b, c[, w_ab, w_ac, w_bc]) with a < b < c, or with rows false parts of their number (n)."""
    ship(edges.sparkSession)
    count = colours(num_edges)
    names = ["src", "dst", *(["weight"] if "weight" in edges.columns else [])]
    sent = edges.select(*(F.col(c).cast("long").alias(c) for c in names)).mapInArrow(_dealt(count, names), "task long, n long, edges binary")
    out = "n long" if not rows else "a long, b long, c long" + (", w_ab long, w_ac long, w_bc long" if len(names) == 3 else "")
    return sent.groupBy("task").applyInArrow(_found(count, len(names), rows), out)


def _closed_fans(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many triangles the edges b-c make that have one ``a``."""
    parts = [[batch.column(c).to_numpy() for c in ("a", "b", "c")] for batch in batches]
    a, b, c = (np.concatenate(z) for z in zip(*parts, strict=True))
    del parts
    ids, ends = np.unique(np.concatenate((b, c)), return_inverse=True)  # a vertex counts apart for each a
    owner = np.unique(a, return_inverse=True)[1] * len(ids)
    total = sum(len(found[0]) for found in closed_wedges(owner + ends[: len(a)], owner + ends[len(a) :]))
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])
