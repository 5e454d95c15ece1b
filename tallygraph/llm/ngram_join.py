"""N-gram Jaccard self-join with several global token orders, and its classes.

A document's set holds the hashes of its distinct runs of ``size`` words. Two documents link when their sets' Jaccard similarity reaches
``percent`` / 100. For every total order of the tokens, two such sets share a token among the first n - ceil(t n) + 1 of each (its prefix). So
a pair is a candidate only if it does so under each of several orders; the first order finds pairs, the others strike pairs out, and the sets of
the rest are compared in full.

All orders put common tokens last: a sketch of the corpus' document frequencies (all documents, a fixed number of counters) gives each token a
level, and below that each order has its own hash. A passage that a third of all documents share is then in few prefixes.

Documents with equal sets are one class from the start, and only its smallest doc_id takes part in the join. A group of near copies isn't
expanded into pairs: each document is tied to the heads of its tokens' runs, by a few prefix tokens first and by all of them where parts are still
apart, then to a few documents drawn from the run's largest part; ties whose prefixes meet under every order connect the documents to parts. Then the runs are gone through for pairs of different parts alone, and those
that meet under every order join their parts to groups. So every pair that meets under all orders lies in one group. A group's documents are dealt to blocks by their size; every two
blocks meet in one task, which intersects the orders' filters for all their pairs at once, by products of incidence matrices of the prefixes, and compares the
sets of the pairs that are left; it gives no more than a spanning forest of its links. No link between different texts is lost.

Prefixes travel as packed blobs, one per task and bucket, so a shuffle has few rows; a bucket holds the tokens of one hash range.

Tokens are 64-bit hashes; two different shingles of a pair of documents meet with a chance of about n^2 / 2^64.

Defined results: a document without words has the empty set and links with nothing; one with fewer than ``size`` words has its whole sequence as
its only shingle. Rows with a null doc_id link with nothing, and their component is null. Rows that repeat a doc_id are one node. Empty tables give
empty results; extra columns are left out. A text of any length is read whole, in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import kernel, scratch
from tallygraph.llm.components import components, forest
from tallygraph.functions.ship import ship

SKETCH_BITS, CHUNKS = 24, 64
SKETCH = 1 << SKETCH_BITS
ORDERS = 3
#: A bucket's tokens: about so many bytes of packed prefixes.
BUCKET_BYTES = 24 << 20
#: Ids of candidates up to this number are sent to all tasks (8 bytes each); more are joined by hash.
BROADCAST_IDS = 1_000_000
#: Prefix tokens of a document that tie it to others.
TIES = 4
#: Documents of its run's largest part that a document of another part is tied to, before the run is gone through.
PROBES = 4
#: A block of a group: at most about so many documents, and so many shingles in all; shingles of small groups that share a task.
BLOCK, BLOCK_SHINGLES, PACK_SHINGLES = 1024, 2_000_000, 2_000_000


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = kernel.column_bytes(batch.column("text"))
    hashes, _, _, first = kernel.words(data, offsets)
    return [kernel.distinct(kernel.shingles(hashes[first[i] : first[i + 1]], size)) for i in range(len(batch))]


def levels(docs: DataFrame, size: int) -> np.ndarray:
    """A level for each of SKETCH counters: 0 for usual frequencies, then one more for each doubling of what is above the mean."""
    width = SKETCH // CHUNKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for s in _sets(batch, size):
                np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1)
        planes = (np.ascontiguousarray(total[k * width : (k + 1) * width].view(np.uint8).reshape(-1, 4).T).tobytes() for k in range(CHUNKS))  # most high bytes are 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([pack.compress(p) for p in planes], pa.binary())], ["chunk", "counts"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(width, np.uint64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total += np.ascontiguousarray(np.frombuffer(unpack.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        eighths = np.minimum(255, np.round(8 * np.log2(1 + total.astype(np.float64)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([eighths.tobytes()], pa.binary())], ["chunk", "total", "eighths"])

    parts = docs.select("text").mapInArrow(counted, "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInArrow(added, "chunk int, total long, eighths binary").toPandas().sort_values("chunk")  # SKETCH bytes
    if not len(rows):
        return np.zeros(SKETCH, np.uint8)
    mean = int(rows.total.sum()) / SKETCH
    spread = 4 * math.sqrt(mean) + 8  # what rare tokens that share a counter come to, above the mean
    above = np.maximum(2 ** (np.arange(256) / 8) - 1 - mean, 0) / spread
    level = np.where(above <= 1, 0, 1 + np.floor(np.log2(np.maximum(above, 1)))).astype(np.uint8)
    return level[np.frombuffer(b"".join(rows.eighths), np.uint8)]


def _keys(tokens: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """A token's place in an order: its level in the upper byte, then the order's own hash."""
    return (level[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (kernel.mix64(tokens, order) >> np.uint64(8))


def _prefix(tokens: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The keys of a set's prefix in an order, sorted."""
    p = prefix_length(len(tokens), percent) if len(tokens) else 0
    keys = _keys(tokens, level, order)
    return np.sort(np.partition(keys, p - 1)[:p]) if p else keys


def prefixes(docs: DataFrame, level, size: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, first, others): a set's size, signature, its prefix in the first order (sorted), and 32 bits of those in the others. Fewer bits
    would lose no pair, but let unrelated long documents pass."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums, first, others = [], [], [], []
            for s in _sets(batch, size):
                n.append(len(s))
                sums.append((int(kernel.mix64(s, 101).sum(dtype=np.uint64)), int(kernel.mix64(s, 102).sum(dtype=np.uint64))))
                own = [_prefix(s, level.value, o, percent) for o in range(ORDERS)]
                first.append(own[0].tobytes())
                others.append(b"".join(np.sort(k.astype(np.uint32)).tobytes() for k in own[1:]))
            marks = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), pa.array(first, pa.binary()), pa.array(others, pa.binary())], ["doc_id", "n", "s1", "s2", "first", "others"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, n long, s1 long, s2 long, first binary, others binary")


def _postings(buckets: int):
    """Packed (token, component, doc, n, place) of the prefixes of many sets, a row for each bucket."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("token", "<u8"), ("part", "<i8"), ("doc", "<i8"), ("n", "<i4"), ("place", "<i4")])
        pack, held, count = zstandard.ZstdCompressor(level=1), [], 0

        def flush():
            rows = np.concatenate(held)
            where = (kernel.mix64(rows["token"], 7) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            rows, where = rows[order], where[order]
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack.compress(rows[cuts[k] : cuts[k + 1]].tobytes()) for k in full], pa.binary())], ["bucket", "rows"])

        for batch in batches:
            parts, docs, ns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "doc_id", "n"))
            data, offsets = kernel.column_bytes(batch.column("first"))
            tokens, lengths = np.frombuffer(data.tobytes(), np.uint64), np.diff(offsets) // 8
            rows = np.empty(len(tokens), kind)
            rows["token"], rows["part"], rows["doc"], rows["n"] = tokens, np.repeat(parts, lengths), np.repeat(docs, lengths), np.repeat(ns, lengths)
            rows["place"] = np.arange(len(tokens)) - np.repeat(offsets[:-1] // 8, lengths)
            held.append(rows)
            count += len(rows)
            if count > 1 << 20:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return packed, np.dtype([("token", "<u8"), ("part", "<i8"), ("doc", "<i8"), ("n", "<i4"), ("place", "<i4")])


def _possible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets that share the token at these places can reach the threshold."""
    least = -(-percent * (a["n"].astype(np.int64) + b["n"]) // (100 + percent))
    most = np.minimum(a["place"], b["place"]) + 1 + np.minimum(a["n"] - a["place"], b["n"] - b["place"]) - 1
    return (np.minimum(a["n"], b["n"]).astype(np.int64) * 100 >= percent * np.maximum(a["n"], b["n"]).astype(np.int64)) & (most >= least)


def _candidates(kind: np.dtype, percent: int, heads_only: bool, probes: int = 0):
    """Pairs of sets of different parts in the token runs of one bucket; with heads_only each set and the heads of its run; with ``probes`` each set and at
    most so many drawn from those of its run's largest part that it can link with."""

    def found(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        rows = np.concatenate([np.frombuffer(unpack.decompress(b), kind) for batch in batches for b in batch.column("rows").to_pylist()])
        rows = rows[np.lexsort((rows["doc"], rows["n"], rows["token"]))]
        begins = np.flatnonzero(np.concatenate(([True], rows["token"][1:] != rows["token"][:-1])))
        sizes = np.diff(np.append(begins, len(rows)))
        many = sizes > 1
        rows = rows[np.repeat(many, sizes)]
        sizes = sizes[many]
        begins = np.cumsum(sizes) - sizes

        def batch_of(a, b, count):
            low, high = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(count)], ["u", "v", "hits"])

        def once(a, b):
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(low) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            return low[at], high[at], np.diff(np.append(at, len(low)))

        if heads_only:
            # Heads: the smallest document of the run, which is often the same in all runs of a family, and for every fourth token a document drawn for
            # this token, so that a family is tied together whatever its smallest document is like.
            run = np.repeat(np.arange(len(sizes)), sizes)
            pairs = []
            for drawn in (False, True):
                here = np.flatnonzero(rows["token"] % np.uint64(4) == 0) if drawn else np.arange(len(rows))
                rank = kernel.mix64(rows["doc"][here].astype(np.uint64) ^ rows["token"][here], 3) if drawn else rows["doc"][here]
                order = here[np.lexsort((rank, run[here]))]
                first = np.flatnonzero(np.concatenate(([True], run[order][1:] != run[order][:-1]))) if len(order) else order
                head = np.repeat(order[first], np.diff(np.append(first, len(order))))
                a, b = rows[head], rows[order]
                ok = (a["doc"] != b["doc"]) & (a["part"] != b["part"]) & _possible(a, b, percent)
                pairs.append(np.column_stack((np.minimum(a["doc"], b["doc"])[ok], np.maximum(a["doc"], b["doc"])[ok])))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            if len(pairs):
                yield batch_of(*once(pairs[:, 0], pairs[:, 1]))
            return
        # What is still open: pairs of different groups. In each run all but the largest group are few.
        run = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rows["part"], run))
        parts, runs = rows["part"][order], run[order]
        new = np.concatenate(([True], (parts[1:] != parts[:-1]) | (runs[1:] != runs[:-1]))) if len(parts) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        weight = np.diff(np.append(at, len(parts)))
        by_weight = np.lexsort((weight, runs[at]))
        largest = np.append(np.flatnonzero(np.diff(runs[at][by_weight])), len(at) - 1) if len(at) else np.zeros(0, np.int64)
        major = parts[at][by_weight][largest]
        minor = np.flatnonzero(rows["part"] != major[run]) if len(rows) else np.zeros(0, np.int64)
        # The sizes that can link with a set's lie together in its run.
        place = (run.astype(np.int64) << 32) | rows["n"]
        n = rows["n"][minor].astype(np.int64)
        low = np.searchsorted(place, (run[minor].astype(np.int64) << 32) | -(-n * percent // 100))
        high = np.searchsorted(place, (run[minor].astype(np.int64) << 32) | (n * 100 // percent), side="right")
        width = np.maximum(high - low, 0)
        ends = np.cumsum(width)
        first = 0
        if probes:
            pairs = np.zeros((0, 2), np.int64)
            largest_part = np.flatnonzero(rows["part"] == major[run]) if len(rows) else minor
            among = place[largest_part]
            low = np.searchsorted(among, (run[minor].astype(np.int64) << 32) | -(-n * percent // 100))
            high = np.searchsorted(among, (run[minor].astype(np.int64) << 32) | (n * 100 // percent), side="right")
            for k in range(probes):
                some = np.flatnonzero(high - low > k)  # the first draw is any of them, the next follow it in a circle
                a = rows[minor[some]]
                at = (kernel.mix64(a["doc"].astype(np.uint64) ^ a["token"], 5) % (high - low)[some].astype(np.uint64)).astype(np.int64) + k * np.maximum(1, (high - low)[some] // probes)
                b = rows[largest_part[low[some] + at % (high - low)[some]]]
                ok = (a["doc"] != b["doc"]) & _possible(a, b, percent)
                pairs = np.concatenate((pairs, np.column_stack((np.minimum(a["doc"], b["doc"])[ok], np.maximum(a["doc"], b["doc"])[ok]))))
            if len(pairs):
                yield batch_of(*once(pairs[:, 0], pairs[:, 1]))
            return
        while first < len(minor):
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 21), side="right")))
            w = width[first:stop]
            i = np.repeat(minor[first:stop], w)
            j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[first:stop], w)
            a, b = rows[i], rows[j]
            ok = (a["part"] != b["part"]) & (a["doc"] != b["doc"]) & _possible(a, b, percent)
            if ok.any():
                yield batch_of(*once(a["doc"][ok], b["doc"][ok]))
            first = stop

    return found


def _bucket_pairs(reps: DataFrame, buckets: int, percent: int, heads_only: bool, probes: int = 0) -> DataFrame:
    packed, kind = _postings(buckets)
    blobs = reps.select("doc_id", "n", "part", "first").mapInArrow(packed, "bucket int, rows binary")
    return blobs.groupBy("bucket").applyInArrow(_candidates(kind, percent, heads_only, probes), "u long, v long, hits long")


def _survivors(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose prefixes meet under each of the other orders too."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                a, b = (np.frombuffer(z, np.uint32).reshape(ORDERS - 1, -1) for z in (x, y))
                keep[i] = all(np.isin(p, q, kind="sort").any() if p[0] <= q[-1] and q[0] <= p[-1] else False for p, q in zip(a, b, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], ["u", "v"])

    asked = _only(reps.select("doc_id", "others"), pairs)
    x, y = (asked.select(F.col("doc_id").alias(k), F.col("others").alias(o)) for k, o in (("u", "x"), ("v", "y")))
    return pairs.select("u", "v").join(x, "u").join(y, "v").mapInArrow(kept, "u long, v long")


def _only(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose doc_id is in one of the pairs."""
    ids = scratch.stage(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def overlaps(sets: list[np.ndarray], split: int, columns: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common): the numbers of common tokens of sets[:split] with sets[split:], as products of incidence matrices."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = token[shared], owner[shared]
    token = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1 if len(token) else token
    total = np.zeros((split, len(sets) - split), np.float32)
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, columns):
        a, b = np.searchsorted(token, (first, first + columns))
        there = np.zeros((len(sets), columns), np.float32)
        there[owner[a:b], token[a:b] - first] = 1
        total += there[:split] @ there[split:].T
    i, j = np.nonzero(total)
    return i, j, total[i, j].astype(np.int64)


def _linked(ids: np.ndarray, sets: list[np.ndarray], split: int, percent: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of ids[:split] with ids[split:]; with split 0 of all with all. Pairs meet under every order before they are compared."""
    if split == 0:
        ids, sets, split, same = np.concatenate((ids, ids)), [*sets, *sets], len(sets), True
    else:
        same = False
    sizes = np.array([len(s) for s in sets])
    meet = np.ones((split, len(sets) - split), bool)
    if same:
        meet &= np.arange(split)[:, None] < np.arange(split)
    meet &= ids[:split, None] != ids[split:]
    small, large = np.minimum.outer(sizes[:split], sizes[split:]), np.maximum.outer(sizes[:split], sizes[split:])
    meet &= small * 100 >= percent * large
    for order in range(ORDERS):
        if not meet.any():
            return ids[:0], ids[:0]
        half = [_prefix(s, level, order, percent) for s in (sets[:split] if same else sets)]
        i, j, _ = overlaps([*half, *half] if same else half, split)
        there = np.zeros(meet.shape, bool)
        there[i, j] = True
        meet &= there
    rows, columns = np.flatnonzero(meet.any(axis=1)), np.flatnonzero(meet.any(axis=0))
    if not len(rows):
        return ids[:0], ids[:0]
    i, j, common = overlaps([*(sets[k] for k in rows), *(sets[split + k] for k in columns)], len(rows))
    i, j = rows[i], columns[j]
    a, b = sizes[i], sizes[split + j]
    ok = meet[i, j] & (100 * common >= percent * (a + b - common))
    return forest(ids[i[ok]], ids[split + j[ok]]) if ok.any() else (ids[:0], ids[:0])


def _block_links(size: int, percent: int, level):
    def compared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = key[1].as_py(), key[2].as_py()
        groups: dict[int, dict] = {}
        for batch in batches:
            for part, block, doc, tokens in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "doc_id")), _sets(batch, size), strict=True):
                groups.setdefault(part, {})[doc, len(tokens), int(tokens.sum(dtype=np.uint64))] = (block, tokens)  # rows that repeat are one
        us, vs = [], []
        for members in groups.values():
            rows = sorted(((block != first, doc, tokens) for (doc, _, _), (block, tokens) in members.items()), key=lambda x: x[0])
            split = 0 if first == second else sum(not x[0] for x in rows)
            if len(rows) > 1 and (first == second or 0 < split < len(rows)):
                u, v = _linked(np.array([x[1] for x in rows], np.int64), [x[2] for x in rows], split, percent, level.value)
                us.append(u)
                vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return compared


def _group_links(groups: DataFrame, docs: DataFrame, sizes: DataFrame, level, size: int, percent: int) -> DataFrame:
    """Links within each group (doc_id, part): its documents are dealt to blocks by their number and size, and every two blocks meet in one task. Small
    groups share tasks. The texts travel, being smaller than their sets."""
    weighed = scratch.stage(groups.join(sizes.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id"), "weighed")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    blocks = scratch.stage(weighed.groupBy("part").agg(need.cast("int").alias("blocks")), "blocks")
    packs = max(64, math.ceil((weighed.agg(F.sum("n")).first()[0] or 0) / PACK_SHINGLES))
    split = blocks.where("blocks > 1")
    split = F.broadcast(split) if split.count() <= BROADCAST_IDS else split
    dealt = weighed.drop("n").join(split, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.col("blocks")).cast("int"))
    dealt = F.broadcast(dealt) if weighed.count() <= BROADCAST_IDS else dealt
    here = F.col("block")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(here, j).alias("a"), F.greatest(here, j).alias("b")))
    tasks = docs.join(dealt, "doc_id").withColumn("m", F.explode(meet))
    home = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(packs)) - packs).otherwise(F.col("part"))
    sent = tasks.select(home.alias("home"), F.col("m.a").alias("a"), F.col("m.b").alias("b"), "part", "block", "doc_id", "text")
    return sent.groupBy("home", "a", "b").applyInArrow(_block_links(size, percent, level), "u long, v long")


def _with_tops(tops: DataFrame) -> DataFrame:
    """(doc_id, part) of all nodes of components."""
    return tops.select(F.col("u").alias("doc_id"), F.col("v").alias("part")).unionByName(tops.select(F.col("v").alias("doc_id"), F.col("v").alias("part")).distinct())


def classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    level = spark.sparkContext.broadcast(levels(docs, size))  # SKETCH bytes
    whole = scratch.stage(prefixes(docs, level, size, percent), "prefixes")
    made = scratch.stage(whole.drop("first", "others"), "sizes")
    usable = made.where("doc_id is not null and n > 0")
    least = whole.where("doc_id is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "first", "others")).alias("r"))
    reps = scratch.stage(least.select("n", "s1", "s2", "r.*"), "classes")
    scratch.remove(whole)
    del whole, least
    scratch.release(spark)
    volume = reps.agg(F.sum(F.length("first"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(volume * 4 / BUCKET_BYTES))
    member = usable.select("doc_id", "n", "s1", "s2").distinct().join(reps.select("n", "s1", "s2", F.col("doc_id").alias("rep")), ["n", "s1", "s2"])
    member = scratch.stage(member.select("doc_id", "rep"), "members")
    tops, placed = None, reps.withColumn("part", F.col("doc_id"))
    for first, probes in ((F.substring("first", 1, 8 * TIES), 0), (F.col("first"), 0), (F.col("first"), PROBES)):
        ties = scratch.stage(_bucket_pairs(placed.withColumn("first", first), buckets, percent, not probes, probes).select("u", "v").distinct(), "ties")
        likely = scratch.stage(_survivors(ties, reps), "likely")
        scratch.release(spark)
        tops = components(likely if tops is None else likely.unionByName(tops))
        placed = reps.join(tops.select(F.col("u").alias("doc_id"), F.col("v").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    open_pairs = scratch.stage(_bucket_pairs(placed, buckets, percent, False).select("u", "v").distinct(), "pairs")
    scratch.release(spark)
    groups = components(tops.unionByName(scratch.stage(_survivors(open_pairs, reps), "survivors")))
    scratch.remove(reps)
    del reps, placed
    scratch.release(spark)
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    links = scratch.stage(_group_links(_with_tops(groups), known, usable, level, size, percent), "links")
    scratch.release(spark)
    every = links.unionByName(member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    final = components(every)
    rows = made.select("doc_id", F.col("n").alias("n_shingles"))
    return rows.join(final.select(F.col("u").alias("doc_id"), "v"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("v", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that link, directly or by others, with one of a smaller doc_id."""
    found = classes(docs, size, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
