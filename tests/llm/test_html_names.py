"""Names that training never saw, and pages that are long, deep or broken."""

import random
import re
import time

import pytest

from tallygraph.llm import html_text


def test_parts_whose_names_were_never_seen():
    """Every class and id of held-out pages is replaced by a word that no training page has."""
    model, rng = html_text.train(), random.Random(777)
    assert "zzqx" not in model.worth
    right = total = 0
    for _ in range(200):
        drawn = html_text.Drawn(rng).draw()
        page = html_text.parse(re.sub(r'(class|id)="[^"]*"', r'\1="zzqx"', "".join(drawn.out)))
        keep = html_text.decode(page, model.trees.log_odds(html_text.features(page, model.worth)))
        held = set(page.holder)
        right += sum(keep[i + 1] == m for i, m in enumerate(drawn.mark) if i + 1 in held)
        total += sum(i + 1 in held for i in range(len(drawn.mark)))
    assert right >= 0.97 * total


@pytest.mark.parametrize("name", ["ad", "unit", "zone-x", "kx92"])
def test_an_advert_of_any_name_goes(name):
    prose = "Words of the article that go on for a while, as articles do, and end in a full stop. " * 4
    page = f'<body><nav><ul><li><a href="/">home</a></li><li><a href="/b">news</a></li></ul></nav><div class="{name}">Buy one now.</div><article><h1>The title</h1><p>{prose}</p><p>{prose}</p></article><footer>Someone</footer></body>'
    assert html_text.extract([page], html_text.train()) == ["\n".join(["The title", prose.strip(), prose.strip()])]


@pytest.mark.parametrize("part", ['<a "', "<a '\"", "<!", "<", "<!--", "<div>", "<div><li>x", "<ul><li>", "<p>a</p></p>", "<svg>", "<title>", "</p>", "<object>x", "&#1"])
def test_a_megabyte_of_broken_markup(part):
    """The time grows with the length, not with its square."""
    began = time.process_time()
    page = html_text.parse("<p>first</p>" + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 20
    assert page.texts[0] == "first"


def test_deep_pages_and_long_numbers():
    deep = html_text.parse("<div>" * 100_000 + "x" + "</div>" * 100_000)
    assert deep.texts == ["x"] and len(deep.parent) == 100_001
    assert html_text.features(deep, {}).shape == (100_001, html_text.FEATURES)
    assert html_text.parse(f"<p>&#{'1' * 9000};&#{'0' * 9000}65;&#66;</p>").texts == ["\ufffdAB"]
