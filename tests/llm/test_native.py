"""The operators that are DataFrame expressions alone."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tallygraph.llm import line_dedup, mixing, url_filter
from tests.llm.data import EDGES, prose

BLANK = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("batches", [1, 4, 11])
def test_line_dedup(spark, batches):
    rng = random.Random(batches)
    pool = [prose(rng, 3) for _ in range(6)] + ["", "  ", "É", "É "]
    docs = [(i, "\n".join(rng.choice([*pool, prose(rng, 4)]).upper() if rng.random() < 0.3 else rng.choice([*pool, f" {prose(rng, 2)}\r"]) for _ in range(rng.randint(1, 9)))) for i in range(60)] + EDGES
    docs += [docs[0], docs[0], (1, "a second text\n" + pool[0])]
    key = lambda line: line.strip(BLANK).translate(FOLD)
    seen = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            seen[key(line)].add(d)
    want = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(seen[key(x)]) < 10]
        want.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, kept int").repartition(3)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_lines(df, 10, batches).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_line_dedup_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", -1)
    df = spark.createDataFrame([(i, f"same\n{i}") for i in range(12)] + [(99, "same")], "doc_id long, text string")
    assert sorted(r.kept for r in line_dedup.drop_lines(df).collect()) == sorted([*map(str, range(12)), ""])
    assert line_dedup.dedup_documents(df).count() == 12  # one had nothing else


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.drop_lines(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.rule_table(spark, [("allow", "com", "/")])).count() == 0
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), url_filter.rule_table(spark, [])).first().verdict == "allow"


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "b.example.com", ""), ("allow", "example.com", "/en/x")]
URLS = [None, "", "no scheme", "http://", "http://WWW.Example.com/en/a?b#c", "http://m.example.com/en/a", "http://example.com/en/xyz", "http://badexample.com/en/", "https://x.net/es/", "https://x.net/ess", "http://net/fr/1", "http://org/", "ftp://a.b.example.com", "http://b.example.com?x/en/", "x://y://z.com/", "http://com", "http://example.com./en/", "http://.com/"]


def test_url_filter(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://{'.'.join(rng.choice(['a', 'b', 'example', 'www', 'net', 'com', 'z']) for _ in range(rng.randint(1, 4)))}{rng.choice(['/en/', '/es/q', '', '/en/x', '/'])}" for _ in range(300)]

    def judged(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
        fits = [(len(h), len(p), f"{h}{p}", v) for v, h, p in RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rule_table(spark, RULES)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}


def water(sizes, weights, share, epochs):
    """Targets as the rule is told: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("share", [1.0, 0.3, 2.9])
def test_mixing_meets_its_targets(spark, share):
    rng = random.Random(7)
    docs = [(i, prose(rng, rng.choice([1, 5, 40, 400])), rng.choice(["a", "b", "b", "b", "c", None, "tiny"]) if i % 17 else "tiny") for i in range(300)] + [(d, t, "e") for d, t in EDGES]
    docs += [(900, None, "nothing"), docs[4], docs[4]]
    df = spark.createDataFrame([(d, t, s, 1) for d, t, s in docs], "doc_id long, text string, source string, size int").repartition(4)
    rows = mixing.mix(df, share=share).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    aims = water(sizes, (1, 2, 3), share, 3.0)
    assert len(rows) == len(docs)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - aims[r.source]) < 1e-6 * (1 + aims[r.source])
        assert r.taken >= int(r.target // max(1, r.source_size)) * r.size  # complete epochs come first
    assert all(abs(taken[s] - aims[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(2), share=share).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mixing_prefers_quality(spark):
    rows = [(i, prose(random.Random(i), 20), "a" if i % 2 else "b", 1.0 if i % 4 < 2 else 0.02) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = mixing.mix(df, weights=(1,), share=0.3, quality="quality").join(df.select("doc_id", "quality"), "doc_id").collect()
    high, low = (sum(r.taken for r in got if (r.quality == 1) == q) for q in (True, False))
    assert high > 10 * low


def test_hashes_of_kept_lines():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_rules_with_empty_labels(spark):
    rules = url_filter.rule_table(spark, [("block", "a..b", "/"), ("block", "b.", "/"), ("allow", "x.b.", "/"), ("allow", "", "/")])
    urls = ["http://a..b/", "http://c.a..b/", "http://a.b/", "http://b./", "http://y.b./", "http://x.b./", "http://z.x.b./", "http://b/", "http:///p", "http://.b/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r.rule for r in url_filter.judge(df, rules, "none").orderBy("page_id").collect()]
    assert got == ["a..b/", "a..b/", None, "b./", "b./", "x.b./", "x.b./", None, "/", None]


def test_a_text_of_very_many_lines(spark):
    """Half of 200,000 lines go, in a time that grows with the lines."""
    shared = [f"line {i}" for i in range(1000)]
    long = "\n".join(x for i in range(100_000) for x in (shared[i % 1000], f"own {i}"))
    docs = spark.createDataFrame([(0, long), *((k, "\n".join(shared)) for k in range(1, 10))], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup.drop_lines(docs, min_docs=10).collect()}
    assert (rows[0].n_lines, rows[0].n_dropped) == (200_000, 100_000)
    assert rows[0].kept == "\n".join(f"own {i}" for i in range(100_000))
    assert all(rows[k].kept == "" and rows[k].n_dropped == 1000 for k in range(1, 10))
