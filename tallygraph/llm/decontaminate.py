"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact edit verification.

A document is contaminated by an item when some window of its words is within ``(1 - similarity)`` times the item's number of words of it, in word
edit distance. The CGK random walk (Chakraborty, Goldenberg, Koucky 2016) turns a sequence of words into another one, whose Hamming distance follows
the edit distance: it copies the current word and advances or not by a random bit of step and word. Two sequences get the same walk, so they fall into
step again after an edit. LSH keys sample ``BITS`` steps of a walk; a window is a candidate for an item when a key agrees in one of the
repetitions. The number of repetitions is fitted on each length class: items are edited at random up to the allowed distance, and repetitions are added
until ``recall`` of these are found; the class that needs most sets the number for all. Walks of long items agree too rarely: a class that
``MOST_REPEATS`` repetitions don't bring to ``recall`` has all its windows (below) compared exactly instead. Every candidate is verified by the exact
distance, so nothing is reported that is not there.

Windows: by the pigeonhole principle an item within distance k of a window shares with it an unbroken run of (m - k) / (k + 1) words at least. Windows
start where such a run (of 3 words at most) puts them, and at the k starts to both sides of it; the others cannot verify and are not embedded.

The items are the query set: they are read in blocks of ``BLOCK_WORDS`` words, each of which is broadcast and meets all documents. Documents are never
shuffled.

Defined results: items and documents without words give nothing. Rows that repeat an item_id or a doc_id are each compared; the result has one row per
(doc_id, item_id), with the smallest distance. A null text is empty; a null doc_id is reported as null. Letters A-Z are compared lower-cased.
Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import kernel
from tallygraph.functions.ship import ship

BITS, MOST_REPEATS, RUN = 2, 64, 3
BLOCK_WORDS = 400_000
FILTER_BITS = 22
#: Length classes: items of m_c to GROWTH * m_c words have their keys sampled alike.
GROWTH = 1.25


def allowed(m: int, similarity: float) -> int:
    """The largest distance from an item of m words."""
    return int(math.floor((1 - similarity) * m + 1e-9))


def run_length(m: int, similarity: float) -> int:
    k = allowed(m, similarity)
    return max(1, min(RUN, -(-(m - k) // (k + 1))))


@dataclass(frozen=True)
class Walks:
    """Random bits of the walks and the sampled steps of each length class: (class start, steps of each repetition).

    repeats: by class, of those that have items; 0 where every window is compared exactly."""

    seed: int
    steps: tuple[tuple[int, tuple[tuple[int, ...], ...]], ...]
    repeats: dict[int, int] = field(default_factory=dict)

    def class_of(self, m: int) -> int:
        return max(i for i, (start, _) in enumerate(self.steps) if start <= m)


def class_steps(longest: int, seed: int, repeats: int) -> tuple:
    rng, start, out = random.Random(seed), 1, []
    while start <= longest:
        span = max(1, int(1.6 * start))  # the walk is then at about 0.8 of the shortest item of the class
        out.append((start, tuple(tuple(sorted(rng.sample(range(span), min(BITS, span)))) for _ in range(repeats))))
        start = max(start + 1, math.ceil(start * GROWTH))
    return tuple(out)


def keys(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, walks: Walks, repeat: int, classes: list[int]) -> dict[int, np.ndarray]:
    """For each class the key of each window, symbols[start:end] of which the walk reads as far as it comes."""
    wanted = {c: walks.steps[c][1][repeat] for c in classes}
    out = {c: np.full(len(starts), (c + 1) * 1_000_003 + repeat, np.uint64) for c in classes}
    at = starts.copy()
    padded = np.append(symbols, np.uint64(0))
    for step in range(max(w[-1] for w in wanted.values()) + 1):
        inside = at < ends
        now = np.where(inside, padded[np.where(inside, at, 0)], np.uint64(0))
        coin = kernel.mix64(now, (walks.seed * 131 + repeat) * 4099 + step)
        for c, w in wanted.items():
            if step in w:
                with np.errstate(over="ignore"):
                    out[c] = kernel.mix64(out[c] * np.uint64(0xD1342543DE82EF95) + now, step)
        at = at + (coin >> np.uint64(63)).astype(np.int64)
    return out


def distances(items: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Edit distance of each row of ``items`` (its first ``sizes`` words) to the nearest prefix of the same row of ``texts``."""
    width = texts.shape[1]
    small = np.int16 if width + items.shape[1] < 30_000 else np.int32
    ramp = np.arange(width + 1, dtype=small)
    row = np.zeros((len(items), width + 1), small)  # distances less the place, so that a step to the right costs nothing
    best = np.where(sizes == 0, 0, np.iinfo(np.int64).max)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + small(1), row[:, :-1] - (texts == items[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new, axis=1)
        done = sizes == i + 1
        if done.any():
            best[done] = (row[done] + ramp).min(axis=1)
    return best


def start_distances(items: np.ndarray, sizes: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row and each start in ``texts`` (its first ``lengths`` words) the edit distance of the item to the nearest piece that begins there."""
    width, rows = texts.shape[1], np.arange(len(items))[:, None]
    ramp = np.arange(width + 1, dtype=np.int32)
    # From the ends backwards, with a free end: the last row of the table has all starts.
    back = texts[rows, np.maximum(lengths[:, None] - 1 - np.arange(width), 0)]
    row = np.zeros((len(items), width + 1), np.int32)
    last = row.copy()
    for i in range(int(sizes.max(initial=0))):
        word = items[rows[:, 0], np.maximum(sizes - 1 - i, 0)]
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (back != word[:, None]), out=new[:, 1:])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        done = sizes == i + 1
        last[done] = row[done]
    return last[rows, np.maximum(lengths[:, None] - np.arange(width), 0)]


@dataclass(frozen=True)
class Items:
    """A block of items, ready to be looked up."""

    ids: list
    words: list[np.ndarray]
    similarity: float
    walks: Walks
    grams: tuple[tuple[int, np.ndarray, np.ndarray, np.ndarray], ...]
    keys: np.ndarray
    owners: np.ndarray

    def allowed(self, i: int) -> int:
        return allowed(len(self.words[i]), self.similarity)


def _edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``words`` after k random substitutions, insertions and deletions."""
    out = list(words)
    for _ in range(k):
        at, kind, fresh = int(rng.integers(0, max(1, len(out)))), int(rng.integers(0, 3)), np.uint64(rng.integers(1, 1 << 62))
        if kind == 0 and out:
            out[at] = fresh
        elif kind == 1:
            out.insert(at, fresh)
        elif out:
            del out[at]
    return np.array([*out, *rng.integers(1, 1 << 62, 2 * len(words) + 8).astype(np.uint64)], np.uint64)


def _sampled(word_lists: list[np.ndarray], walks: Walks) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all items in all repetitions, and whose they are, sorted by key."""
    by_class: dict[int, list[int]] = {}
    for i, w in enumerate(word_lists):
        if len(w):
            by_class.setdefault(walks.class_of(len(w)), []).append(i)
    flat = np.concatenate(word_lists) if word_lists else np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) for w in word_lists])
    found, owners = [], []
    for c, members in by_class.items():
        at = np.array(members)
        begin, end = ends[at] - np.array([len(word_lists[i]) for i in members]), ends[at]
        for r in range(walks.repeats[c]):
            found.append(keys(flat, begin, end, walks, r, [c])[c])
            owners.append(at)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, o = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(k, kind="stable")
    return k[order], o[order]


def fit_repeats(word_lists: list[np.ndarray], walks: Walks, similarity: float, recall: float, trials: int = 1000) -> dict[int, int]:
    """For each length class how many repetitions find ``recall`` of the items after as many random edits as are allowed, in the worst class too; 0 for a
    class in which MOST_REPEATS don't."""
    rng = np.random.default_rng(walks.seed)
    members: dict[int, list[np.ndarray]] = {}
    for w in word_lists:
        if len(w):
            members.setdefault(walks.class_of(len(w)), []).append(w)
    repeats = {}
    for c, usable in sorted(members.items()):
        chosen = [usable[int(rng.integers(len(usable)))] for _ in range(trials)]
        noisy = [_edited(w, allowed(len(w), similarity), rng) for w in chosen]
        clean, dirty = np.concatenate(chosen), np.concatenate(noisy)
        clean_end, dirty_end = np.cumsum([len(w) for w in chosen]), np.cumsum([len(w) for w in noisy])
        clean_at, dirty_at = clean_end - [len(w) for w in chosen], dirty_end - [len(w) for w in noisy]
        hit, repeats[c] = np.zeros(trials, bool), 0
        for r in range(MOST_REPEATS):
            hit |= keys(clean, clean_at, clean_end, walks, r, [c])[c] == keys(dirty, dirty_at, dirty_end, walks, r, [c])[c]
            if hit.mean() >= recall:
                repeats[c] = r + 1
                break
    most = max(repeats.values(), default=0)
    return {c: n and most for c, n in repeats.items()}


def prepare(ids: list, texts: list[str], similarity: float, recall: float, seed: int) -> Items:
    data, offsets = kernel.column_bytes(pa.array([t or "" for t in texts], pa.large_string()))
    hashes, _, _, first = kernel.words(data, offsets)
    word_lists = [hashes[first[i] : first[i + 1]] for i in range(len(ids))]
    longest = max([1, *map(len, word_lists)])
    walks = Walks(seed, class_steps(longest, seed, MOST_REPEATS))
    walks = replace(walks, repeats=fit_repeats(word_lists, walks, similarity, recall))
    grams = []
    for q in range(1, RUN + 1):
        rows = [(kernel.shingles(w, q), i) for i, w in enumerate(word_lists) if len(w) and run_length(len(w), similarity) == q]
        if rows:
            h = np.concatenate([g for g, _ in rows])
            item = np.concatenate([np.full(len(g), i) for g, i in rows])
            place = np.concatenate([np.arange(len(g)) for g, _ in rows])
            order = np.argsort(h, kind="stable")
            grams.append((q, h[order], item[order], place[order]))
    return Items(list(ids), word_lists, similarity, walks, tuple(grams), *_sampled(word_lists, walks))


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): the numbers first[i] to last[i] - 1 of each i."""
    size = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]


class Search:
    """Finds the items of one block in batches of documents."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.sizes = np.array([len(w) for w in items.words], np.int64)
        self.most = np.array([items.allowed(i) for i in range(len(items.words))], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.table = np.zeros((len(items.words), self.longest), np.uint64)
        for i, w in enumerate(items.words):
            self.table[i, : len(w)] = w
        self.filters = []
        for _, h, _, _ in items.grams:
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters.append(bits)
        self.repeats = items.walks.repeats
        self.exact = np.array([m > 0 and not self.repeats[items.walks.class_of(int(m))] for m in self.sizes], bool)

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start): where item-sized windows that can verify begin, each once; and (doc, item, from, to) of the starts for items compared exactly."""
        docs, starts, spans = [], [], []
        for (q, known, item, place), bits in zip(self.items.grams, self.filters, strict=True):
            if len(hashes) < q:
                continue
            grams = kernel.shingles(hashes, q)
            at = np.flatnonzero(bits[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(known, grams[at]), np.searchsorted(known, grams[at], side="right")
            owner, hit = _ranges(low, high)
            at = at[owner]
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + q <= first[doc + 1]
            at, hit, doc = at[inside], hit[inside], doc[inside]
            whole = self.exact[item[hit]]
            if whole.any():
                d, i = doc[whole], item[hit[whole]]
                begin = at[whole] - place[hit[whole]]
                spans.append(np.column_stack((d, i, np.maximum(begin - self.most[i], first[d]), np.minimum(begin + self.most[i] + 1, first[d + 1]))))
            at, hit, doc = at[~whole], hit[~whole], doc[~whole]
            k = self.most[item[hit]]
            owner, start = _ranges(at - place[hit] - k, at - place[hit] + k + 1)
            doc = doc[owner]
            fits = (start >= first[doc]) & (start < first[doc + 1])
            pair = np.unique(np.column_stack((doc[fits], start[fits])), axis=0)
            docs.append(pair[:, 0])
            starts.append(pair[:, 1])
        span = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), span
        pair = np.unique(np.column_stack((np.concatenate(docs), np.concatenate(starts))), axis=0)
        return pair[:, 0], pair[:, 1], span

    def candidates(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) that share a key in some repetition, each once."""
        found = []
        for r in range(max(self.repeats.values(), default=0)):
            made = keys(hashes, starts, ends, self.items.walks, r, [c for c, n in self.repeats.items() if n > r])
            for k in made.values():
                low, high = np.searchsorted(self.items.keys, k), np.searchsorted(self.items.keys, k, side="right")
                owner, at = _ranges(low, high)
                found.append(owner * np.int64(len(self.sizes)) + self.items.owners[at])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // max(1, len(self.sizes)), pair % max(1, len(self.sizes))

    def compared(self, hashes: np.ndarray, first: np.ndarray, span: np.ndarray, cells: int = 1 << 20) -> Iterator[np.ndarray]:
        """(doc, item, start, distance) within the allowed distance, of all starts of ``span``."""
        span = span[span[:, 2] < span[:, 3]]
        if not len(span):
            return
        span = span[np.lexsort((span[:, 2], span[:, 1], span[:, 0]))]
        # Overlapping spans become one: a pair's positions don't meet the next pair's, as they are moved apart.
        _, pair = np.unique(span[:, :2], axis=0, return_inverse=True)
        base = pair.reshape(-1).astype(np.int64) * (len(hashes) + 1)
        reached = np.maximum.accumulate(base + span[:, 3])
        begins = np.flatnonzero(np.concatenate(([True], base[1:] + span[1:, 2] > reached[:-1])))
        low, high = span[begins, 2], np.append(reached[begins[1:] - 1], reached[-1]) - base[begins]
        # Pieces of about an item's length keep the rows of a table alike.
        size = np.maximum(self.sizes[span[begins, 1]], 64)
        owner, piece = _ranges(np.zeros_like(low), -(-(high - low) // size))
        low, high = low[owner] + piece * size[owner], np.minimum(low[owner] + (piece + 1) * size[owner], high[owner])
        doc, item = span[begins[owner], 0], span[begins[owner], 1]
        stop = np.minimum(high + self.sizes[item] + self.most[item], first[doc + 1])
        order = np.lexsort((stop - low, self.sizes[item]))
        step = max(1, cells // int((stop - low).max()))
        for b in range(0, len(order), step):
            o = order[b : b + step]
            length = stop[o] - low[o]
            text = hashes[np.minimum(low[o][:, None] + np.arange(int(length.max())), len(hashes) - 1)]
            gap = start_distances(self.table[item[o]], self.sizes[item[o]], text, length)
            gap = np.where(np.arange(gap.shape[1]) < (high - low)[o][:, None], gap, np.iinfo(np.int32).max)
            best = gap.argmin(axis=1)
            least = gap[np.arange(len(o)), best]
            ok = least <= self.most[item[o]]
            yield np.column_stack((doc[o], item[o], low[o] + best - first[doc[o]], least))[ok]

    def search(self, hashes: np.ndarray, first: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, ...]:
        """(doc, item, start, distance) of everything within the allowed distance."""
        doc, start, span = self.windows(hashes, first)
        out = list(self.compared(hashes, first, span))
        for a in range(0, len(doc), step):
            d, s = doc[a : a + step], start[a : a + step]
            window, item = self.candidates(hashes, s, first[d + 1])
            order = np.argsort(self.sizes[item], kind="stable")  # items of a length share a table
            window, item = window[order], item[order]
            for b in range(0, len(window), 4096):
                w, i = window[b : b + 4096], item[b : b + 4096]
                reach = int((self.sizes[i] + self.most[i]).max())
                at = s[w][:, None] + np.arange(reach)
                text = np.where(at < first[d[w] + 1][:, None], hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
                gap = distances(self.table[i][:, : int(self.sizes[i].max())], self.sizes[i], text)
                ok = gap <= self.most[i]
                out.append(np.column_stack((d[w][ok], i[ok], s[w][ok] - first[d[w][ok]], gap[ok])))
        rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]
        if len(rows):
            rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
        return tuple(rows.T)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids, texts, words = [], [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(item)
        texts.append(text or "")
        words += texts[-1].count(" ") + 1
        if words >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.98, seed: int = 23) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, distance (words), n_words (of the item), start (first word of the window)."""
    spark = docs.sparkSession
    ship(spark)
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance long, n_words long, start long"
    item_type = benchmark.select("item_id").limit(0).toArrow().schema.field("item_id").type
    found = None
    for ids, texts in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(prepare(ids, texts, similarity, recall, seed))  # BLOCK_WORDS words

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value)
            for batch in batches:
                data, offsets = kernel.column_bytes(batch.column("text"))
                hashes, _, _, first = kernel.words(data, offsets)
                doc, item, start, gap = search.search(hashes, first)
                if len(doc):
                    names = pa.array([search.items.ids[i] for i in item], item_type)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), names, pa.array(gap), pa.array(search.sizes[item]), pa.array(start)], ["doc_id", "item_id", "distance", "n_words", "start"])

        part = docs.select("doc_id", "text").mapInArrow(searched, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct("distance", "n_words", "start")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the contaminated ones. Rows that share a doc_id go together; rows without one are told apart by their texts."""
    by_text = F.concat_ws("-", F.lit("text"), F.xxhash64("text"), F.xxhash64(F.lit(3), "text"))
    key = F.coalesce(F.concat(F.lit("id-"), F.col("doc_id").cast("string")), by_text)
    found = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, similarity).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(found, "__key", "left_anti").select(*docs.columns)
