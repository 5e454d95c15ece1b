import random

import numpy as np

from tallygraph.llm import decontaminate
from tests.llm.data import EDGES, prose


def distance(item, text):
    """To the nearest prefix of text."""
    row = list(range(len(text) + 1))
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(text):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (w != v)))
        row = new
    return min(row)


def brute(docs, items, similarity):
    out = set()
    for d, t in docs:
        words = (t or "").lower().split()
        for i, s in items:
            item = (s or "").lower().split()
            k = decontaminate.allowed(len(item), similarity)
            if item and any(distance(item, words[a : a + len(item) + k]) <= k for a in range(len(words))):
                out.add((d, i))
    return out


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = prose(rng, 1)
        elif kind == 1:
            words.insert(at, prose(rng, 1))
        else:
            del words[at]
    return words


def test_planted_passages_and_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([6, 12, 20, 40, 59]))) for i in range(12)] + [(90, None), (91, ""), (92, "  ")]
    docs = [(i, prose(rng, rng.randint(1, 150))) for i in range(30)]
    for n in range(60):
        i = rng.randrange(12)
        words = items[i][1].split()
        k = rng.choice([0, 0, decontaminate.allowed(len(words), 0.8) // 2, decontaminate.allowed(len(words), 0.8)])
        docs.append((100 + n, f"{prose(rng, rng.randint(0, 30))}\n{' '.join(edited(rng, words, k)).upper()}  {prose(rng, 25)}"))
    docs += [e for e in EDGES if e[1] is None or len(e[1]) < 100]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(a, t, 1) for a, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    want = brute(docs, items, 0.8)
    assert got <= want  # every report is exact
    assert len(got) >= 0.97 * len(want)  # the target recall
    exact = {(x, i) for x, t in docs for i, s in items if s and s.strip() and f" {' '.join(s.lower().split())} " in f" {' '.join((t or '').lower().split())} "}
    assert exact <= got


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    rng = random.Random(4)
    items = [(f"q{i}", prose(rng, 15)) for i in range(4)]
    d = spark.createDataFrame([(i, f"{prose(rng, 9)} {t}") for i, (_, t) in enumerate(items)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(i, f"q{i}") for i in range(4)}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(d, b).count() == 0 and decontaminate.remove_contaminated(d, b.limit(0)).count() == 4


def test_distances_against_the_plain_recursion():
    rng = random.Random(5)
    for _ in range(50):
        a, t = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(12)]
        table = np.zeros((1, 9), np.uint64)
        table[0, : len(a)] = a
        assert decontaminate.distances(table, np.array([len(a)]), np.array([t], np.uint64))[0] == distance(a, t)


def test_contaminated_rows_without_an_id_go(spark):
    """Of two rows without doc_id only the one that holds the item goes; nulls and empty texts stay; columns of any name are kept."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(None, f"x y {item} z", "a"), (None, "nothing of this is in it", "b"), (None, None, "c"), (1, item.upper(), "d"), (2, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == ["b", "c", "e"]
    assert decontaminate.remove_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 5
