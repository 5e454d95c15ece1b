import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygraph.llm import components, kernel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="aAbé \t\n.\x0b0", max_size=40), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_of_a_batch(texts):
    data, offsets = kernel.column_bytes(pa.array(texts, pa.string()))
    hashes, starts, ends, first = kernel.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[s:e] for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [[w.encode() for w in WORD.findall(t)] for t in texts]
    names = {}
    for h, s, e in zip(hashes.tolist(), starts, ends, strict=True):
        assert names.setdefault(h, raw[s:e].lower()) == raw[s:e].lower()
    assert len(set(names.values())) == len(names)


def test_nulls_slices_and_long_texts(monkeypatch):
    monkeypatch.setattr(kernel, "PIECE", 16)
    texts = ["x" * 70 + " yy", None, "", "a b c d e f g h i j k l m", "Z"]
    whole = pa.array(["skip", *texts], pa.large_string()).slice(1)
    data, offsets = kernel.column_bytes(whole)
    _, _, _, first = kernel.words(data, offsets)
    assert np.diff(first).tolist() == [2, 0, 0, 13, 1]


def test_shingles_of_short_texts():
    h = np.arange(5, dtype=np.uint64)
    assert len(kernel.shingles(h, 3)) == 3 and len(kernel.shingles(h[:2], 3)) == 1 and len(kernel.shingles(h[:0], 3)) == 0
    assert kernel.shingles(h[:2], 3) != kernel.shingles(h[:1], 3)


@pytest.mark.parametrize("links", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1)], "random"])
def test_components(spark, links):
    if links == "random":
        rng = random.Random(3)
        links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long").repartition(3)
    got = {r.u: r.v for r in components.components(df).collect()}
    assert got == {x: top(x) for x in list(parent) if top(x) != x}
