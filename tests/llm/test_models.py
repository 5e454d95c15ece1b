"""Quality, token counts and main text."""

import random
import re
import zlib

import pytest

from tallygraph.llm import html_text, quality, tokens
from tests.llm.data import EDGES, prose


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = prose(rng, rng.randint(20, 120))
        docs.append((i, text if good else " | ".join(w.upper() + "!!" for w in text.split())))
        labels.append((i, int(good), 0))
    docs += EDGES
    d = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, score string")
    rows = quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {a: zlib.crc32(str(a).encode()) % 3 == 1 for a, _ in docs if a is not None}
    mark = {a: q for a, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in mark]
    assert sum(r.predicted == mark[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[900] == by[901]  # null and empty


def test_quality_without_one_class_or_any(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.classify(d, one).collect())
    assert {r.score for r in quality.classify(d, one.limit(0)).collect()} == {0.5}
    assert quality.classify(d.limit(0), one).count() == 0


def test_token_counts_are_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_str(tokens.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(2)
    odd = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "it's we'll  two   spaces \n\n x\t", "日本語のテキスト 🙂🙂", "\u00a0\u2003x ", "1234567 8,9.10", "a" * 5000, "é" * 300 + " ", " ", "\r\n"]
    docs = EDGES + [(i, t) for i, t in enumerate(odd)] + [(100 + i, "".join(rng.choice("ab 1'\n.é<|>🙂") for _ in range(80))) for i in range(60)]
    rows = tokens.count_tokens(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_tokens int"), limit=20).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for d, t in docs]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    pytest.importorskip("tokenizers")
    monkeypatch.setattr(tokens, "CACHE", 8)
    counting = tokens.Counting(tokens.vocabulary("byte_bpe_50k.json"), {})
    text = " ".join(f"w{i}x" for i in range(100))
    assert counting.count(text) == counting.count(text)
    assert len(counting.lengths) <= 8


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body><header><h1>My Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a>About</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Big &lt;News&gt;</h1><p><b>First   line<br>goes on.<p>Second &eacute; para &#x41; with <a href="/x">a link</a> in it.<script>if (a < b) { "</p>" }</script>
<aside class="ad">Buy now</aside><ul><li>one point that is made<li>another point that is made</ul></article><section class="comments"><div class="comment"><p>Nice post</p></div></section><form><label>Search</label></form><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    model = html_text.train()
    text = html_text.extract([PAGE, None, "", "plain words", "<nav><a>x</a></nav>"], model)
    assert text[0] == "Big <News>\nFirst line goes on.\nSecond é para A with a link in it.\none point that is made\nanother point that is made"
    assert text[1:4] == ["", "", "plain words"]


def test_held_out_pages():
    """Accuracy over elements of generated pages that the model has not seen, and no child of a dropped element kept."""
    model, rng = html_text.train(), random.Random(12345)
    right = total = 0
    for _ in range(200):
        drawn = html_text.Drawn(rng).draw()
        page = html_text.parse("".join(drawn.out))
        keep = html_text.decode(page, model.trees.log_odds(html_text.features(page, model.worth)))
        assert all(keep[page.parent[i]] or not keep[i] for i in range(1, len(keep)))
        held = {h for h in page.holder}
        right += sum(keep[i + 1] == m for i, m in enumerate(drawn.mark) if i + 1 in held)
        total += sum(i + 1 in held for i in range(len(drawn.mark)))
    assert right >= 0.95 * total


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "http://a", PAGE, "x"), (2, None, None, "y"), (1, "http://a", PAGE, "z")], "page_id long, url string, html string, text string")
    rows = html_text.main_text(df).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_broken_markup_is_read_to_the_end():
    for source in ("<p>a<", "a < b <p>c", "<div class='x>y'>t</div>", "</p></div>z", "<!-- open", "<script>never closed", "<p title=\"a>b\">q</p>"):
        page = html_text.parse(source)
        assert "".join(page.texts) in re.sub(r"\s+", " ", source) or page.texts
