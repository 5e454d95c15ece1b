"""The table of distances in few bytes, against the plain recurrence."""

import numpy as np

from tallygraph.llm.decontaminate import distances


def plain(item, text):
    row = list(range(len(text) + 1))
    for i, w in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j + 1] + 1, row[j] + (t != w), new[j] + 1))
        row = new
    return min(row)


def test_distances_are_those_of_the_recurrence():
    r = np.random.default_rng(1)
    sizes, items, texts = r.integers(0, 9, 200), r.integers(0, 4, (200, 8)).astype(np.uint64), r.integers(0, 4, (200, 11)).astype(np.uint64)
    assert list(distances(items, sizes, texts)) == [plain(i[:n], t) for i, n, t in zip(items, sizes, texts, strict=True)]


def test_wide_tables_do_not_overflow():
    items, texts = np.arange(1, 4, dtype=np.uint64)[None, :], np.full((1, 40_000), 9, np.uint64)
    assert list(distances(items, np.array([3]), texts)) == [3]
