import random
import re

import numpy as np
import pytest

from tallygraph.llm import ngram_join
from tests.llm.data import corpus, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else top(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_against_brute_force(spark, seed, size, percent):
    rows = corpus(seed)
    rows += [(5, rows[5][1]), (5, "another text of the same id"), (7, rows[3][1])]  # repeated rows, and one id with several texts
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, size, percent).collect()), key=str)
    assert got == brute(rows, size, percent)


def test_a_family_of_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    base, rows = prose(rng, 90).split(" "), []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_empty_table(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps_of_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(9)] + [np.zeros(0, np.uint64)]
    i, j, common = ngram_join.overlaps(sets, 4, columns=7)
    got = {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), common.tolist(), strict=True)}
    assert got == {(a, b): n for a in range(4) for b in range(6) if (n := len(set(sets[a].tolist()) & set(sets[4 + b].tolist())))}


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "something else that is not alike")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == [1, 3]


def test_open_sets_are_tied_to_a_few_of_a_large_part_first():
    """A run of 300 sets of one part and 50 open ones: 15,000 pairs when it is gone through, at most PROBES a set before."""
    import pyarrow as pa
    import zstandard

    kind = ngram_join._postings(1)[1]
    rows = np.zeros(350, kind)
    rows["token"], rows["doc"], rows["n"] = 77, np.arange(350), 40
    rows["part"] = np.where(rows["doc"] < 300, 0, rows["doc"])
    batch = pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(rows.tobytes())], pa.binary())], ["rows"])
    pairs = [(u, v) for b in ngram_join._candidates(kind, 90, False, ngram_join.PROBES)((pa.scalar(0),), iter([batch])) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
    assert 50 <= len(pairs) <= 50 * ngram_join.PROBES
    assert {v for _, v in pairs} == set(range(300, 350)) and {u for u, _ in pairs} <= set(range(300))
    assert len({u for u, _ in pairs}) > 50  # not the same few for all
    every = sum(len(b) for b in ngram_join._candidates(kind, 90, False)((pa.scalar(0),), iter([batch])))
    assert every >= 50 * 300
