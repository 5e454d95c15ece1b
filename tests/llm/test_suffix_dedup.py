import random

import numpy as np
import pytest

from tallygraph.llm import suffix_dedup
from tests.llm.data import corpus


def brute(rows, window):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1 if d is not None else 0):
            w = b[k : k + window]
            first[w] = min(first.get(w, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1 if d is not None else 0):
            if first[b[k : k + window]] < d:
                gone[k : k + window] = b"\1" * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "window", "small"), [(1, 50, False), (2, 20, True), (3, 7, True)])
def test_against_brute_force(spark, monkeypatch, seed, window, small):
    if small:  # many pieces, flushes and buckets
        for name, value in (("PIECE", 256), ("FLUSH", 200), ("CONTEXTS_FLUSH", 50), ("BUCKET", 500), ("CONTEXTS", 64)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(seed, 40)
    rows += [(200, "é" * 60), (201, "xé" + "é" * 59), (202, "abab" * 40), (203, "babab" + "abab" * 30), (3, rows[3][1]), (3, rows[9][1]), (204, "\0" * 70), (205, "\0" * 65)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, row int").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("depth", [1, 5, 6])
def test_merged_interleave_is_the_sorted_order(depth):
    """Shards' transforms merge into the order of all rotations, and blocks are the equal prefixes."""
    rng = np.random.default_rng(2)
    shards = [rng.integers(97, 99, (m, 12)).astype(np.uint8) for m in (5, 1, 7)]
    made = [suffix_dedup.rotations(s) for s in shards]
    merged, block = suffix_dedup.interleave([t for _, t in made], depth)
    taken, prefixes = [0] * 3, []
    for s in merged:
        row, start = divmod(int(made[s][0][taken[s]]), 12)
        taken[s] += 1
        prefixes.append(bytes(np.roll(shards[s][row], -start)[:depth]))
    assert prefixes == sorted(prefixes)
    assert all((a == b) == (x == y) for a, b, x, y in zip(prefixes, prefixes[1:], block, block[1:], strict=False))


def test_more_shards_than_the_narrow_type_numbers(monkeypatch):
    """With a narrow type that holds 4 numbers the merge of 9 shards is the same."""
    rng = np.random.default_rng(3)
    made = [suffix_dedup.rotations(rng.integers(97, 99, (3, 10)).astype(np.uint8))[1] for _ in range(9)]
    want = suffix_dedup.interleave(made, 6)
    widths = []
    monkeypatch.setattr(np, "iinfo", lambda k, old=np.iinfo: widths.append(k) or (type("Narrow", (), {"max": 4}) if k is np.uint16 else old(k)))
    got = suffix_dedup.interleave(made, 6)
    assert np.uint32 in widths and all((a == b).all() for a, b in zip(want, got, strict=True))


def test_contexts_left_out_have_no_repeat():
    """A context stays if it shares the gram and half the reach to either side with another document's."""
    shape = suffix_dedup.Shape(10)
    rows = np.frombuffer(b"abcdefGGGGhijklm" b"xxxdefGGGGyyyyyy" b"zzzzzzGGGGhijzzz" b"qqqqqqGGGGqqqqqq", np.uint8).reshape(4, shape.context)
    assert shape.reach == 6 and suffix_dedup.may_repeat(rows, np.array([1, 2, 3, 4]), shape).tolist() == [True, True, True, False]
    assert suffix_dedup.may_repeat(rows, np.array([1, 1, 1, 4]), shape).tolist() == [False] * 4
