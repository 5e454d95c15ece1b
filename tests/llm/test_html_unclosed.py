"""Pages that leave end tags out keep what follows."""

import pytest

from tallygraph.llm import html_text


@pytest.mark.parametrize("source, want", [
    ("<head><title>no</title><meta charset=x><body><article><p>kept</p></article>", ["kept"]),
    ("<html><head><title>no</title><script>if (a < b) { '<body>' }</script><style>p{}</style><p>kept</p>", ["kept"]),
    ("<head><title>no</title></head><body><p>kept</p>", ["kept"]),
    ("<head><template><p>no</p></template><body><p>kept</p>", ["kept"]),
    ("<p>one</p><svg><path d='x'><p>two</p>", ["one", "two"]),
    ("<p>one</p><object data='x'><p>two</p><template><p>three</p>", ["one", "two", "three"]),
    ("<p>one</p><svg><text>no</text></svg><p>two</p>", ["one", "two"]),
])
def test_unclosed(source, want):
    assert html_text.parse(source).texts == want
