"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained, one on text labelled good and one on text labelled bad. A text is compressed with each; the
difference of the sizes over their sum says which of the two it resembles, and their mean over the length how much the text repeats
itself. These two, the latter's square, and their products with the logarithm of the length become a probability by logistic
regression on labelled documents that the dictionaries used have not seen.

Fitting takes a bounded sample of the labelled training rows: the ``PER_CLASS`` documents of each label with the smallest hash
of their doc_id, half of them for the dictionaries and half for the calibration. With fewer than ``FEW`` documents of a class halves would teach too
little: then the dictionaries learn from all, and each fold is calibrated with its sizes by dictionaries of the other folds. The ridge of
the calibration is the one with the smallest loss on left-out folds. The log-odds are then moved from the sample's shares of the classes to those of all labels outside the held-out fold. Labels, lang, source and doc_id are no inputs of
a score. The held-out fold (crc32 of doc_id as text, mod 3, equal to 1) is never learned from. Whole texts are learned from and scored.

Defined results: a null or empty text scores as the calibration has it for length 0, always the same. When one class has no
training document the score is the share of the other; without any labels it is 0.5. A doc_id with labels of both kinds is learned
from as both. A null doc_id is not held out. Equal rows score alike; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygraph.functions.ship import ship

PER_CLASS = 1500
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
FEATURES = 6
FOLDS, FEW = 4, 200
#: Strengths of the ridge that are tried, on standardised features.
RIDGES = (0.01, 0.1, 1.0, 10.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _dictionary(texts: list[bytes]) -> bytes:
    """The most useful parts of ``texts``; short inputs, which cannot be trained on, are the dictionary themselves."""
    chunks = [t[i : i + 2000] for t in texts for i in range(0, len(t), 2000)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        """A function from bytes to the features of the regression."""
        if not self.good or not self.bad:
            return lambda text: np.zeros(FEATURES)
        packs = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_checksum=False) for d in (self.good, self.bad)]

        def features(text: bytes) -> np.ndarray:
            g, b = (len(p.compress(text)) for p in packs)
            x, c, n = (b - g) / (b + g), math.log((g + b) / 2 / (len(text) + 1)), math.log1p(len(text))
            return np.array((x, x * n, c, c * c, c * n, n))

        return features

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method on standardised features with a ridge on all weights but the first; the classes weigh as they are in ``y``."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    x = np.column_stack((np.ones(len(x)), (x - mean) / spread))
    pull, w = ridge * np.diag([1e-6, *np.ones(x.shape[1] - 1)]), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    w = np.append(w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread)
    return w


def _loss(x: np.ndarray, y: np.ndarray, fold: np.ndarray, ridge: float) -> float:
    total = 0.0
    for k in np.unique(fold):
        w = _logistic(x[fold != k], y[fold != k], ridge)
        z = np.clip(x[fold == k] @ w[1:] + w[0], -30, 30)
        total += float(np.log1p(np.exp(np.where(y[fold == k] > 0, -z, z))).sum())
    return total


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``2 * per_class`` labelled documents, which is what reaches the driver."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).orderBy(order, "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").dropDuplicates(["doc_id", "quality"]).toPandas()
    rows = rows.sort_values(["doc_id", "quality"])
    texts, marks = [t.encode() for t in rows.text], rows.quality.to_numpy(float)
    if not len(rows):
        return Model(b"", b"", (0.0,) * (FEATURES + 1))
    if marks.min() == marks.max():
        return Model(b"", b"", (30.0 if marks[0] else -30.0, *(0.0,) * FEATURES))
    dictionaries = lambda use: Model(*(_dictionary([t for t, u, m in zip(texts, use, marks, strict=True) if u and m == label]) for label in (1, 0)), ())
    half, fold, every = np.zeros(len(rows), bool), np.zeros(len(rows), int), np.ones(len(rows), bool)
    fewest = min(int((marks == label).sum()) for label in (0, 1))
    for label in (0, 1):
        at = np.flatnonzero(marks == label)
        half[at[::2]] = True
        fold[at] = np.arange(len(at)) // (2 if fewest >= FEW else 1) % FOLDS
    x, rest = np.zeros((len(rows), FEATURES)), ~half if fewest >= FEW else every
    made = dictionaries(half if fewest >= FEW else every)
    for k in range(FOLDS):
        # A class of one document can't be left out; it is then calibrated by itself.
        features = made.scorer() if fewest >= FEW else dictionaries((fold != k) | (fewest < 2)).scorer()
        for i in np.flatnonzero((fold == k) & rest):
            x[i] = features(texts[i])
    x, y, fold = x[rest], marks[rest], fold[rest]
    ridge = min(RIDGES, key=lambda r: _loss(x, y, fold, r)) if fewest >= 2 else RIDGES[-1]
    weights = _logistic(x, y, ridge)
    # The sample holds other shares of the classes than the labels do; that moves the log-odds by a constant.
    there = dict(known.groupBy("quality").count().collect())  # two rows
    weights[0] += math.log(there[1] / (y == 1).sum()) - math.log(there[0] / (y == 0).sum())
    return Model(made.good, made.bad, tuple(map(float, weights)))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and the column ``name``: the probability that the label is 1."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries: a fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value.scorer()
        for batch in batches:
            x = np.array([features((t or "").encode()) for t in batch.column(text).to_pylist()]).reshape(-1, FEATURES)
            arrays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(shared.value.probability(x))], [*(f.name for f in kept), name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f.name for f in kept]).mapInArrow(scored, f"{schema}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, per_class)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
