"""Recall by length of item, and the exact comparison of long ones."""

import random

import numpy as np

from tallygraph.llm import decontaminate, kernel
from tests.llm.data import prose
from tests.llm.test_decontaminate import distance, edited


def found(items, texts, similarity=0.8):
    """{(doc, item): (start, distance)}"""
    search = decontaminate.Search(decontaminate.prepare(list(range(len(items))), items, similarity, 0.98, 23))
    data, offsets = kernel.column_bytes(decontaminate.pa.array(texts, decontaminate.pa.large_string()))
    hashes, _, _, first = kernel.words(data, offsets)
    return {(d, i): (s, g) for d, i, s, g in zip(*map(list, search.search(hashes, first)), strict=True)}


def test_long_items_among_short_ones_are_found():
    rng = random.Random(1)
    items = [prose(rng, 20) for _ in range(190)] + [prose(rng, 400) for _ in range(10)]
    texts, of = [], []
    for i in [*range(0, 190, 2), *[n for n in range(190, 200) for _ in range(6)]]:
        words = items[i].split()
        texts.append(" ".join([prose(rng, 15), *edited(rng, words, decontaminate.allowed(len(words), 0.8)), prose(rng, 15)]))
        of.append(i)
    got = found(items, texts)
    for long in (False, True):
        mine = [(n, i) for n, i in enumerate(of) if (i >= 190) == long]
        assert sum(p in got for p in mine) >= 0.95 * len(mine)


def test_exact_comparison_is_the_brute_force(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 0)  # every class is compared exactly
    rng = random.Random(2)
    items = [prose(rng, m) for m in (1, 2, 6, 12, 40, 70)] + [""]
    texts = [""]
    for _ in range(60):
        words = items[rng.randrange(6)].split()
        k = rng.randint(0, decontaminate.allowed(len(words), 0.8) + 1)
        texts.append(" ".join([prose(rng, rng.randint(0, 20)), *edited(rng, words, k), *(edited(rng, words, k) if k else []), prose(rng, rng.randint(0, 9))]))
    want = {}
    for d, t in enumerate(texts):
        words = t.split()
        for i, s in enumerate(items):
            item = s.split()
            k = decontaminate.allowed(len(item), 0.8)
            best = min(((distance(item, words[a : a + len(item) + k]), a) for a in range(len(words))), default=(k + 1, 0))
            if item and best[0] <= k:
                want[d, i] = (best[1], best[0])
    assert found(items, texts) == want and len(want) > 30


def test_distances_from_all_starts():
    rng = random.Random(3)
    for _ in range(50):
        a, t = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(12)]
        table, text = np.zeros((1, 9), np.uint64), np.zeros((1, 15), np.uint64)
        table[0, : len(a)], text[0, :12] = a, t
        got = decontaminate.start_distances(table, np.array([len(a)]), text, np.array([12]))[0]
        assert list(got[:12]) == [distance(a, t[s:]) for s in range(12)]
