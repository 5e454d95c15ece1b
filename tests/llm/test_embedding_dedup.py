import numpy as np

from tallygraph.llm import embedding_dedup


def brute(rows, least):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and d is not None for d, v in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, (a, v) in enumerate(rows):
        for j, (b, w) in enumerate(rows[:i]):
            if ok[i] and ok[j] and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links[i] += 1
                    links[j] += 1
                    p, q = top(a), top(b)
                    parent[max(p, q)] = min(p, q)
    return sorted(((d, n, None if d is None else top(d), d is None or top(d) == d) for (d, _), n in zip(rows, links, strict=True)), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.6])]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # one vector many times
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] * 24), (304, [1.0, None]), (305, [3.0, 4.0]), (306, [6.0, 8.0]), (None, rows[0][1]), (7, rows[8][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(d, v, "x") for d, v in rows], "vec_id long, embedding array<double>, rep string").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.9).collect()), key=str)
    assert got == brute(rows, 0.9)


def test_tiles_stop_early_without_losing_a_pair():
    rng = np.random.default_rng(6)
    x = embedding_dedup._unit(rng.normal(size=(300, 48)))
    x[150:] = embedding_dedup._unit(x[:150] + rng.normal(size=(150, 48)) * 0.06)
    axes = embedding_dedup.axes_of(x)
    i, j = embedding_dedup.linked(x[:150], x[150:], x[:150] @ axes, x[150:] @ axes, 0.9)
    want = np.argwhere(x[:150] @ x[150:].T >= 0.9)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(w) for w in want.tolist()]


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_strip_of_all_vectors(spark, monkeypatch):
    """All vectors have the same first coordinate: one strip, dealt to many cells."""
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    monkeypatch.setattr(embedding_dedup, "CELL_BYTES", 1024)
    monkeypatch.setattr(embedding_dedup, "axes_of", lambda sample: np.eye(sample.shape[1]))
    rng = np.random.default_rng(8)
    tails = rng.normal(size=(120, 5))
    tails[::3] = tails[1::3] + rng.normal(size=(40, 5)) * 0.2
    rows = [(i, [0.5, *(t / np.sqrt(t @ t) * np.sqrt(0.75)).tolist()]) for i, t in enumerate(tails)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.9).collect()), key=str)
    assert got == brute(rows, 0.9)


def test_cells_meet_all_within_reach(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_BYTES", 10)
    cuts = np.array([-0.5, 0.0, 0.0, 0.4])
    made = embedding_dedup.cells_of(np.array([5, 0, 35, 10, 11]), cuts, 0.45)
    base, parts, lowest, highest = made
    assert base.tolist() == [0, 1, 2, 6, 7] and parts.tolist() == [1, 1, 4, 1, 2]
    low, high = [-9, *cuts], [*cuts, 9]
    meet = [[lowest[i] <= base[j] and base[j] + parts[j] - 1 <= highest[i] for j in range(5)] for i in range(5)]
    assert all(meet[i][j] == meet[j][i] == (low[j] - high[i] <= 0.45 and low[i] - high[j] <= 0.45) for i in range(5) for j in range(5))
