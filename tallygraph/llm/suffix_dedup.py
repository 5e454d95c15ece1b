"""Removal of repeated byte strings by merged Burrows-Wheeler transforms of shards.

A byte goes when a string of ``window`` bytes that covers it also starts in a document with a smaller doc_id. Finding these strings means sorting
suffixes as far as their first ``window`` bytes. Suffixes that cannot repeat are taken out first, without loss:

1. Sampling. Of every run of window - gram + 1 grams the one with the smallest hash is an anchor, so each window holds an anchor, at the same place
   wherever the window occurs. An anchor and the window - gram bytes to both sides (its context) hold all windows around it.
2. Anchors meet by hash, packed in blobs of many. Of equal contexts only those of the smallest document can still be new, so every other is a repeat,
   whole; a gram with one context in the corpus needs no more. What is left are grams with several contexts: the ends of shared passages and the
   surroundings of edits.
3. Every window reaches from its anchor's gram to one side by half of what it has besides the gram, or more. So a context of which neither the gram with the
   half to the left nor that with the half to the right is in another document's context has no repeat and is left out.
4. The other contexts are sorted by merging transforms. Contexts as they arrive at a bucket are cut into shards; a shard's rotations are sorted by
   themselves. The shards' transforms are merged by refining their interleave (Holt and McMillan 2014): each round distributes the interleaved
   transform by its symbols (four bytes at a time), which sorts all rotations four bytes deeper without comparing any; block borders that
   appear in a round give the common prefixes. After window / 4 rounds the blocks are the repeated intervals: all places of one window string.
   A block's smallest doc_id decides about the others.

Contexts of a document that repeats within one task are settled there, so a passage in a third of all documents is a row or so of each task.

Defined results: matches are of bytes and may begin inside a character. A null or empty text has 0 bytes and loses none. A document with a null doc_id loses
nothing and removes nothing. Rows with the same doc_id don't remove from each other; each row is judged by its own text. Texts shorter than ``window`` lose
nothing. A text of any length is read whole, in pieces that overlap. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import kernel, scratch
from tallygraph.functions.ship import ship

#: Anchors a bucket, anchors and contexts that a task holds before it packs them, contexts a bucket of step 3, contexts a shard at least.
BUCKET, FLUSH, CONTEXTS_FLUSH, CONTEXTS, SHARD = 1_200_000, 1 << 19, 1 << 16, 16_000, 1_000
#: Types that number the shards of a bucket, narrowest first: the sort is fastest on the first.
NUMBERS = (np.uint16, np.uint32)
PIECE = 1 << 19
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_LETTER = kernel.mix64(np.arange(256, dtype=np.uint64), 5)


class Shape:
    """Lengths that follow from the window."""

    def __init__(self, window: int) -> None:
        self.window, self.gram = window, max(1, window * 2 // 5)
        self.reach = window - self.gram
        self.context = self.gram + 2 * self.reach
        self.cyclic = self.context + -self.context % 4  # rotations of whole symbols


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _rolled(data: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each length a hash of that many bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        have, k = {1: _LETTER[data]}, 1
        while 2 * k <= min(max(lengths), len(data)):
            have[2 * k] = have[k][:-k] * _power(k) + have[k][k:]
            k *= 2
        made = []
        for length in lengths:
            if len(data) < length:
                made.append(np.zeros(0, np.uint64))
                continue
            out, done = None, 0
            for k in sorted(have, reverse=True):
                if length & k:
                    out = have[k] if out is None else out[: len(out) - k] * _power(k) + have[k][done : done + len(out) - k]
                    done += k
            made.append(kernel.mix64(out))
    return made


def _whole_hash(rows: np.ndarray) -> np.ndarray:
    """The same hash of whole rows of bytes."""
    length = rows.shape[1]
    powers = np.array([_power(length - 1 - k) for k in range(length)], np.uint64)
    with np.errstate(over="ignore"):
        return kernel.mix64((_LETTER[rows] * powers).sum(axis=1, dtype=np.uint64))


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours."""
    k = 1
    while 2 * k <= n:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(made: np.ndarray, n: int, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors in the pieces of n bytes that offsets cut; ``made`` are the hashes of all grams."""
    w, g = shape.window, shape.gram
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes from here to the end of the piece
    grams = np.full(n + w, _TOP)
    grams[: len(made)] = made
    grams[:n][left < g] = _TOP
    least = _slide(grams, shape.reach + 1, np.minimum)[:n]
    least[left < w] = 0
    most = _slide(np.concatenate((np.zeros(shape.reach, np.uint64), least)), shape.reach + 1, np.maximum)
    at = np.flatnonzero((most == grams[:n]) & (left >= g))
    return at, grams[at]


def _pieces(offsets: np.ndarray, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, begin, end) of about PIECE bytes; long texts in pieces that overlap."""
    group, size = [], 0
    for i in range(len(offsets) - 1):
        a, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            b = min(end, a + PIECE + overlap)
            group.append((i, a, b))
            size += b - a
            if size >= PIECE:
                yield group
                group, size = [], 0
            if b == end:
                break
            a += PIECE
    if group:
        yield group


def contexts(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """A row of bytes for each anchor; bytes outside its text are 0."""
    place = (at - shape.reach)[:, None] + np.arange(shape.context)
    out = data[np.clip(place, 0, max(0, len(data) - 1))]
    out[(place < offsets[text][:, None]) | (place >= offsets[text + 1][:, None])] = 0
    return out


def _sides(offsets: np.ndarray, text: np.ndarray, at: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of its text that a context has to the left of the anchor's start, and from there on."""
    return np.minimum(at - offsets[text], shape.reach), np.minimum(offsets[text + 1] - at, shape.gram + shape.reach)


def _row_hash(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    words = -(-rows.shape[1] // 8)
    wide = np.zeros((len(rows), words * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    wide, h = wide.view(np.uint64), start.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            h = kernel.mix64(h * np.uint64(0xD1342543DE82EF95) + wide[:, k])
    return h


def found_anchors(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(text, place in text, gram hash, context hash) of all anchors of a batch."""
    texts, places, grams, hashes = [], [], [], []
    for group in _pieces(offsets, shape.window - 1):
        cut = np.concatenate([data[a:b] for _, a, b in group])
        edges = np.cumsum([0, *(b - a for _, a, b in group)])
        made, around = _rolled(cut, [shape.gram, shape.context])
        at, gram = anchors(made, len(cut), edges, shape)
        piece = np.searchsorted(edges, at, side="right") - 1
        inside = (at - shape.reach >= edges[piece]) & (at + shape.gram + shape.reach <= edges[piece + 1])
        hashed = np.empty(len(at), np.uint64)
        hashed[inside] = around[at[inside] - shape.reach]
        text = np.array([i for i, _, _ in group])[piece]
        at = at - edges[piece] + np.array([a for _, a, _ in group])[piece]
        t, p = text[~inside], at[~inside]  # contexts that reach over the end of their piece
        left, right = _sides(offsets, t, p, shape)
        rows = contexts(data, offsets, t, p, shape)
        whole = (left == shape.reach) & (right == shape.gram + shape.reach)
        by_row = _row_hash(rows, (left << 32) | right)
        by_row[whole] = _whole_hash(rows[whole])
        hashed[~inside] = by_row
        hashes.append(hashed)
        texts.append(text)
        places.append(at - offsets[text])
        grams.append(gram)
    if not texts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    text, place, gram = map(np.concatenate, (texts, places, grams))
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.lexsort((place, text))  # pieces of one text overlap
    text, place, gram, hashed = text[order], place[order], gram[order], hashed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    return text[new], place[new], gram[new], hashed[new]


def _pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        yield int(bucket[a]), _pack([c[a:b] for c in columns])


def _batch(kind: int, packed: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(packed)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "kind", "rows"])


BLOBS = "bucket int, kind int, rows binary"
SETTLED, WAITING, ANCHORS, SPANS = 0, 1, 2, 3
PLACES = ["<i8", "<i8", "<i8"]  # doc, row, place
ANCHOR = ["<u8", "<u4", "<u2", *PLACES]  # gram hash, 48 bits of the context's, ...


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (kernel.mix64(doc.astype(np.uint64), 9) % np.uint64(buckets)).astype(np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _mapped(shape: Shape, buckets: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            gram, context, doc, row, place = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((doc, context, gram))
            gram, context, doc, row, place = (c[order] for c in (gram, context, doc, row, place))
            new = _groups(gram, context)
            again = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            yield _batch(SETTLED, _by_bucket(_doc_bucket(doc[again], buckets), [doc[again], row[again], place[again]]))
            gram, context, doc, row, place = (c[~again] for c in (gram, context, doc, row, place))
            order = np.lexsort((place, row))  # neighbours pack well
            gram, context, doc, row, place = (c[order] for c in (gram, context, doc, row, place))
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            yield _batch(ANCHORS, _by_bucket(bucket, [gram, (context >> np.uint64(32)).astype(np.uint32), context.astype(np.uint16), doc, row, place]))

        for batch in batches:
            data, offsets = kernel.column_bytes(batch.column("text"))
            docs, rows = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
            for first in range(0, len(batch), 512):
                cut = offsets[first : first + 513]
                text, place, gram, context = found_anchors(data[cut[0] : cut[-1]], cut - cut[0], shape)
                held.append((gram, context, docs[first + text], rows[first + text], place))
                count += len(text)
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return mapped


def _reduced(buckets: int):
    def reduced(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, found = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind == SETTLED:
                    settled.append(_unpack(blob, PLACES))
                else:
                    found.append(_unpack(blob, ANCHOR))
        waiting = []
        if found:
            gram, high, low, doc, row, place = map(np.concatenate, zip(*found, strict=True))
            found.clear()
            context = (high.astype(np.uint64) << np.uint64(16)) | low
            order = np.lexsort((doc, context, gram))
            gram, context, doc, row, place = (c[order] for c in (gram, context, doc, row, place))
            new_gram = _groups(gram)
            new = _groups(gram, context)
            least = doc[np.flatnonzero(new)]
            again = doc > least[np.cumsum(new) - 1]
            settled.append((doc[again], row[again], place[again]))
            # A gram whose contexts all begin with one document has nothing to compare.
            of = (np.cumsum(new_gram) - 1)[np.flatnonzero(new)]
            starts = np.flatnonzero(_groups(of))
            several = np.maximum.reduceat(least, starts) > np.minimum.reduceat(least, starts)
            wait = ~again & several[np.cumsum(new_gram) - 1]
            waiting = [doc[wait], row[wait], place[wait]]
        if settled:
            doc, row, place = map(np.concatenate, zip(*settled, strict=True))
            yield _batch(SETTLED, _by_bucket(_doc_bucket(doc, buckets), [doc, row, place]))
        if len(waiting) and len(waiting[0]):
            yield _batch(WAITING, _by_bucket(_doc_bucket(waiting[0], buckets), waiting))

    return reduced


def _per_row(shape: Shape):
    """Blobs of one bucket of documents to a row per document: the spans that are covered."""

    def gathered(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind == SPANS:
                    parts.append(_unpack(blob, [*PLACES, "<i8"]))
                else:
                    doc, row, place = _unpack(blob, PLACES)
                    parts.append((doc, row, place - shape.reach, place + shape.gram + shape.reach) if kind == SETTLED else (doc, row, place, place))
        doc, row, first, last = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((first, row, doc))
        doc, row, first, last = (c[order] for c in (doc, row, first, last))
        at = np.flatnonzero(_groups(doc, row))
        ends = np.append(at[1:], len(doc))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(row[at]), pa.array([first[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([last[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())],
            ["doc_id", "row", "first", "last"],
        )

    return gathered


CONTEXT = ["<i8", "<i8", "<i8", "<i4", "<i4"]  # doc, row, place, bytes to the left, bytes from there on


def _sent(shape: Shape, buckets: int):
    """Contexts of the waiting anchors, to the bucket of their gram."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            rows, *columns = map(np.concatenate, zip(*held, strict=True))
            gram = rows[:, shape.reach : shape.reach + shape.gram]
            bucket = (_row_hash(gram, np.zeros(len(rows))) % np.uint64(buckets)).astype(np.int64)
            return _batch(0, _by_bucket(bucket, [rows.view(f"V{shape.context}").ravel(), *columns]))

        for batch in batches:
            data, offsets = kernel.column_bytes(batch.column("text"))
            marks, edges = kernel.column_bytes(batch.column("first"))
            place, number = np.frombuffer(marks.tobytes(), np.int64), np.diff(edges) // 8
            docs, rows = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
            text = np.repeat(np.arange(len(batch)), number)
            for k in range(0, len(text), 1 << 15):
                t = text[k : k + (1 << 15)]
                p = offsets[t] + place[k : k + (1 << 15)]
                left, right = _sides(offsets, t, p, shape)
                held.append((np.ascontiguousarray(contexts(data, offsets, t, p, shape)), docs[t], rows[t], place[k : k + (1 << 15)], left.astype(np.int32), right.astype(np.int32)))
                count += len(t)
                if count >= CONTEXTS_FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return sent


def rotations(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's transform: (order, transform). ``order`` are the rotations row * length + start by their first 64 bytes or more; the
    transform has, for each in that order, the four bytes before it as one symbol."""
    m, length = rows.shape
    start = np.arange(length)
    key = np.zeros((m, length), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | rows[:, (start + k) % length]
    order = np.argsort(key, axis=None)
    depth = 8
    while True:
        flat = key.ravel()[order]
        rank = np.empty(m * length, np.uint64)
        rank[order] = np.cumsum(_groups(flat)).astype(np.uint64)
        if depth >= 64 or depth >= length:
            break
        rank = rank.reshape(m, length)
        key = (rank << np.uint64(32)) | rank[:, (start + depth) % length]
        order = np.argsort(key, axis=None)
        depth *= 2
    row, at = order // length, order % length
    before = np.zeros(len(order), np.uint32)
    for k in (4, 3, 2, 1):
        before = (before << np.uint32(8)) | rows[row, (at - k) % length]
    return order, before


def _by_symbol(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, symbols in that order), stable. Symbols and places in one number sort much faster than by a list of places."""
    if len(symbols) >= 1 << 32:
        order = np.argsort(symbols, kind="stable")
        return order, symbols[order]
    both = (symbols.astype(np.uint64) << np.uint64(32)) | np.arange(len(symbols), dtype=np.uint64)
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.uint32)


def interleave(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, block): from which shard each rotation of the merged order is, and the block of those that agree in ``depth`` bytes."""
    total = sum(map(len, transforms))
    place = np.arange(total, dtype=np.int32 if total < np.iinfo(np.int32).max else np.int64)  # in the joined transforms
    block = np.zeros_like(place)
    kind = next(k for k in NUMBERS if len(transforms) <= np.iinfo(k).max)
    shard = np.repeat(np.arange(len(transforms), dtype=kind), [len(t) for t in transforms])
    joined = np.concatenate(transforms) if transforms else np.zeros(0, np.uint32)
    # Where the rotation four bytes before each lies: in the same shard, by the order of the shard's symbols.
    before, base = np.empty_like(place), 0
    for t in transforms:
        before[_by_symbol(t)[0] + base] = np.arange(base, base + len(t))
        base += len(t)
    for first in range(0 if depth % 4 == 0 else depth % 4 - 4, depth, 4):
        symbols = joined[place]
        if first < 0:
            symbols &= np.uint32(0xFFFFFFFF << -8 * first & 0xFFFFFFFF)  # the depth that is left over comes first
        order, symbols = _by_symbol(symbols)
        block = np.cumsum(_groups(symbols, block[order]), dtype=place.dtype)
        place = place[order] if first < 0 else before[place[order]]
        if first < 0:  # each shard keeps its own order of whole symbols
            place[np.argsort(shard[place], kind="stable")] = np.arange(total)
    return shard[place], block


def repeated(shards: list[np.ndarray], docs: list[np.ndarray], lefts: list[np.ndarray], rights: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(context, start): windows of the contexts (numbered through all shards) that also occur in a smaller document."""
    made = [rotations(s) for s in shards]
    merged, block = interleave([t for _, t in made], shape.window)
    base = np.cumsum([0, *(len(s) for s in shards)])
    place = np.empty(len(merged), np.int64)
    by_shard = np.argsort(merged, kind="stable")
    place[by_shard] = np.concatenate([order + b * shape.cyclic for (order, _), b in zip(made, base, strict=False)])
    context, start = place // shape.cyclic, place % shape.cyclic
    doc, left, right = map(np.concatenate, (docs, lefts, rights))
    # Only rotations that begin with a whole window of their text count.
    real = (start >= shape.reach - left[context]) & (start + shape.window <= shape.reach + right[context])
    context, start, block = context[real], start[real], block[real]
    if not len(block):
        return context, start
    least = np.minimum.reduceat(doc[context], np.flatnonzero(_groups(block)))
    later = doc[context] > least[np.cumsum(_groups(block)) - 1]
    return context[later], start[later]


def may_repeat(rows: np.ndarray, doc: np.ndarray, shape: Shape) -> np.ndarray:
    """Which contexts share the gram and half the reach to one side with another document's context."""
    half, keep = -(-shape.reach // 2), np.zeros(len(rows), bool)
    for first, last in ((shape.reach - half, shape.reach + shape.gram), (shape.reach, shape.reach + shape.gram + half)):
        core = _row_hash(rows[:, first:last], np.zeros(len(rows)))
        order = np.lexsort((doc, core))
        new = _groups(core[order])
        starts = np.flatnonzero(new)
        several = doc[order][starts] != doc[order][np.append(starts[1:], len(order)) - 1]
        keep[order] |= several[np.cumsum(new) - 1]
    return keep


def _merged(shape: Shape, buckets: int):
    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for blob in batch.column("rows").to_pylist():
                rows, *columns = _unpack(blob, [f"V{shape.context}", *CONTEXT])
                parts.append((np.frombuffer(rows.tobytes(), np.uint8).reshape(-1, shape.context), *columns))
        every = list(map(np.concatenate, zip(*parts, strict=True)))
        parts.clear()
        keep = may_repeat(every[0], every[1], shape)
        every = [c[keep] for c in every]
        if not keep.any():
            return
        shards, docs, lefts, rights, owners = [], [], [], [], []
        known = 0
        for begin in range(0, len(every[0]), SHARD):
            rows, doc, row, place, left, right = (c[begin : begin + SHARD] for c in every)
            wide = np.zeros((len(rows), shape.cyclic), np.uint8)
            wide[:, : shape.context] = rows
            # A document's equal contexts are sorted once.
            name = _row_hash(wide, (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
            order = np.lexsort((name, doc))
            new = _groups(doc[order], name[order])
            one = order[np.flatnonzero(new)]
            owner = np.empty(len(rows), np.int64)
            owner[order] = np.cumsum(new) - 1 + known
            known += len(one)
            shards.append(wide[one])
            docs.append(doc[one])
            lefts.append(left[one])
            rights.append(right[one])
            owners.append((owner, doc, row, place))
        context, start = repeated(shards, docs, lefts, rights, shape)
        order = np.lexsort((start, context))
        context, start = context[order], start[order]
        new = _groups(context)
        new[1:] |= start[1:] > start[:-1] + shape.window  # spans of one context that touch are one
        at = np.flatnonzero(new)
        span_of, first, last = context[at], start[at] - shape.reach, start[np.append(at[1:], len(context)) - 1] - shape.reach + shape.window if len(at) else start
        owner, doc, row, place = map(np.concatenate, zip(*owners, strict=True))
        low, high = np.searchsorted(span_of, owner), np.searchsorted(span_of, owner, side="right")
        size = high - low
        who = np.repeat(np.arange(len(owner)), size)
        which = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + low[who]
        if len(who):
            yield _batch(SPANS, _by_bucket(_doc_bucket(doc[who], buckets), [doc[who], row[who], place[who] + first[which], place[who] + last[which]]))

    return merged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the covered bytes."""
    for batch in batches:
        data, offsets = kernel.column_bytes(batch.column("text"))
        removed, spans, kept = [], [], []
        for i, (first, last) in enumerate(zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            if first is None:
                removed.append(0)
                spans.append(0)
                kept.append(text.tobytes())
                continue
            a, b = (np.clip(np.frombuffer(x, np.int64), 0, len(text)) for x in (first, last))
            depth = np.bincount(a, minlength=len(text) + 1) - np.bincount(b, minlength=len(text) + 1)
            gone = np.cumsum(depth)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def cover(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, first, last): the covered spans of each row of ``docs`` (doc_id, row, text) that has any, as packed numbers."""
    spark, shape = docs.sparkSession, Shape(window)
    ship(spark)
    known = docs.where("doc_id is not null")
    volume = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-volume * 2 // (shape.reach + 2) // BUCKET))
    mapped = known.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInArrow(_mapped(shape, buckets), BLOBS)
    places = scratch.stage(mapped.groupBy("bucket").applyInArrow(_reduced(buckets), BLOBS), "places")
    rows = "doc_id long, row long, first binary, last binary"
    waiting = scratch.stage(places.where(F.col("kind") == WAITING).groupBy("bucket").applyInArrow(_per_row(shape), rows), "waiting")
    number = waiting.agg(F.sum(F.length("first"))).first()[0] or 0
    scratch.release(spark)
    joined = known.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").join(waiting.drop("last"), ["doc_id", "row"])
    second = max(least, number // 8 // CONTEXTS)
    spans = joined.mapInArrow(_sent(shape, second), BLOBS).groupBy("bucket").applyInArrow(_merged(shape, buckets), BLOBS)
    spans = scratch.stage(spans, "spans")
    scratch.release(spark)
    settled = places.where(F.col("kind") == SETTLED)
    return scratch.stage(settled.unionByName(spans).groupBy("bucket").applyInArrow(_per_row(shape), rows), "cover")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, which need not be UTF-8)."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = cover(rows, window)
    joined = rows.withColumn("id", F.col("doc_id").cast("long")).join(found.withColumnRenamed("doc_id", "id"), ["id", "row"], "left").select("doc_id", "text", "first", "last")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
