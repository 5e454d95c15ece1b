"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding of the whole tree.

A page is parsed into its elements. Each element that can hold blocks of text gets features: the density of its subtree (text per element, share
of text inside links, punctuation), what its tag name and attribute tokens were worth in training (its own and its ancestors'), its depth, and its
place among its siblings. Boosted trees turn them into the log-odds that the element belongs to the article.

Decoding is hierarchical: an element can be kept only if its parent is. The set of kept elements with the largest sum of log-odds under that rule
is found bottom-up (an element is worth its own log-odds and whatever of its children is positive), so no child of a dropped ancestor survives and
no kept element hangs in the air.

The model is trained here, on pages drawn by a seeded generator that knows which of its parts are the article. The vocabulary of tags and
attribute tokens below is what such pages are made of; the trees see only how often a token was inside articles. In part of the pages names are
hidden from the trees, which so learn to tell parts without a known name by their place, shape and text.

Text: character references are decoded, white space inside a block (line breaks too) becomes one space, blocks are trimmed and joined by \\n in page
order; scripts, styles, comments and other raw content are no text. Nothing else is dropped, and nothing is capped.

Defined results: a null or empty page, and one without an article, has the empty text and n_chars 0. A page that is plain text without elements is
one block. Unclosed and stray tags are repaired the way browsers do for paragraphs, list items, cells and options. Extra columns are left out.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallygraph.functions.ship import ship

# Element names as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math head title object canvas audio video textarea select".split())
#: What may stand in a head; any other element ends a head whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW_TEXT = frozenset("script style textarea title iframe noscript xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"])}
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_PART = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_ENDS = re.compile(r"[>\"']")
_NAME = re.compile(r"</?[a-zA-Z]")
#: More digits than any character has; Python refuses to read numbers of some thousand digits.
_LONG_NUMBER = re.compile(r"&#([0-9]{8,});?")


@dataclass
class Page:
    """Block elements in page order; blocks of text with the element that holds each."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [("#page",)])
    texts: list[str] = field(default_factory=list)
    holder: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


@lru_cache(maxsize=4096)
def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    found = [x for m in _ATTRIBUTE.finditer(attributes) for x in _TOKEN.findall((m[1] or m[2] or m[3] or "").lower())] if attributes else []
    return (f"<{tag}>", *dict.fromkeys(found))


def _unescape(text: str) -> str:
    short = _LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0') or '0'};" if len(m[1].lstrip("0")) < 8 else "\ufffd", text) if "&#" in text else text
    return html.unescape(short)


class _TagEnds:
    """Whether a tag that begins at a place has its end, quotes being skipped; one pass over the page for all places."""

    def __init__(self, source: str) -> None:
        self.at = [m.start() for m in _ENDS.finditer(source)]
        n = len(self.at)
        self.ended = [False] * (n + 1)
        closing = {"\"": n, "'": n}  # the next quote of each kind
        for k in range(n - 1, -1, -1):
            c = source[self.at[k]]
            self.ended[k] = c == ">" or self.ended[min(closing[c] + 1, n)]
            if c != ">":
                closing[c] = k

    def __call__(self, place: int) -> bool:
        return self.ended[bisect_left(self.at, place)]


def parse(source: str) -> Page:
    """The blocks and elements of a page, in time that grows with its length, however deep, broken or unclosed it is."""
    page, stack, names = Page(), [0], ["#page"]
    opened: dict[str, list[int]] = {}  # where in ``names`` each name is open
    ends: _TagEnds | None = None  # made when the first tag has no end
    last = source.rfind(">")
    buffer: list[str] = []
    in_link, link_chars, skip = 0, 0, ""
    unclosed: set[str] = set()  # raw elements without an end tag in what is left

    def flush() -> None:
        nonlocal link_chars
        if buffer:
            text = " ".join(_unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                page.texts.append(text)
                page.holder.append(stack[-1])
                page.linked.append(min(link_chars, len(text)))
            link_chars = 0

    def close(index: int) -> None:
        flush()
        for name in names[index:]:
            opened[name].pop()
        del stack[index:], names[index:]

    def innermost(some: Iterable[str]) -> int:
        return max((opened[x][-1] for x in some if opened.get(x)), default=0)

    at, end = 0, len(source)
    while at < end:
        tag = source[at] == "<" and _NAME.match(source, at) is not None
        if at > last and not source.startswith("<!--", at):  # no tag ends any more
            stop = source.find("<!--", at)
            m, text, at = None, source[at : stop if stop >= 0 else end], stop if stop >= 0 else end
        elif tag and ends is not None and not ends(at):
            m, text, at = None, "<", at + 1
        else:
            m = _PART.match(source, at)
            at = m.end()
            text = m[4]
            if tag and text is not None and ends is None:
                ends = _TagEnds(source)
        if text is not None:
            if skip == "head" and text.strip():
                skip = ""
            if not skip:
                buffer.append(text)
                if in_link:
                    link_chars += len(text)
            continue
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1]
        if closing:
            if name == skip:
                skip = ""
            if skip:
                continue
            if name == "a":
                in_link = 0
            elif name == "p" and not opened.get("p"):
                flush()
            elif name not in INLINE and opened.get(name):
                close(opened[name][-1])
            continue
        if skip == "head" and name not in IN_HEAD and name != "head":
            skip = ""
        if skip == "head" and (name in RAW_TEXT or name == "template"):
            stop = re.compile(rf"</{name}\s*>", re.I).search(source, at) if name not in unclosed else None
            at = stop.end() if stop else at
            unclosed.update([] if stop else [name])
        if skip:
            continue
        if name in RAW_TEXT:  # up to its own end tag, whatever is inside
            stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if name in RAW and not m[3].endswith("/"):
            # An element without its end tag loses the tag only, not the rest of the page.
            if name == "head" or name not in unclosed and re.compile(rf"</{name}[\s/>]", re.I).search(source, at):
                skip = name
            else:
                unclosed.add(name)
            continue
        if name == "a":
            in_link = 1
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                buffer.append(" ")
            continue
        flush()
        if name in ENDS_P and opened.get("p"):
            close(opened["p"][-1])
        if name in CLOSES and (inner := innermost(CLOSES[name])) > innermost(SCOPE[name]):
            close(inner)
        if name in VOID:
            continue
        page.parent.append(stack[-1])
        page.tag.append(name)
        page.tokens.append(_tokens(name, m[3]))
        stack.append(len(page.parent) - 1)
        opened.setdefault(name, []).append(len(names))
        names.append(name)
    flush()
    return page


FEATURES = 17


def features(page: Page, worth: dict[str, float]) -> np.ndarray:
    n = len(page.parent)
    parent = page.parent
    own, linked, marks, words, blocks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for text, holder, link in zip(page.texts, page.holder, page.linked, strict=True):
        own[holder] += len(text)
        linked[holder] += link
        marks[holder] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        words[holder] += text.count(" ") + 1
        blocks[holder] += 1
    direct = own.copy()
    size, kids, depth, place, same = [1] * n, [0] * n, [0] * n, [0] * n, [0] * n
    here = [0.0] * n
    least, most = [0.0] * n, [0.0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        place[i] = kids[p]
        kids[p] += 1
        here[i] = sum(worth.get(t, 0.0) for t in page.tokens[i])
        least[i], most[i] = min(least[p], here[i]), max(most[p], here[i])
    family = Counter(zip(parent, page.tag, strict=True))
    for i in range(1, n):
        same[i] = family[parent[i], page.tag[i]]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for sums in (own, linked, marks, words, blocks, size):
            sums[p] += sums[i]
    out = np.empty((n, FEATURES))
    up = np.array(parent)
    up[0] = 0
    own, linked, marks, words, blocks, size, kids, depth, place, same, direct, here = (np.array(v, float) for v in (own, linked, marks, words, blocks, size, kids, depth, place, same, direct, here))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = depth, kids, place, place / np.maximum(kids[up], 1)
    out[:, 4], out[:, 5] = same, np.log1p(own)
    out[:, 6] = linked / np.maximum(own, 1)
    out[:, 7], out[:, 8] = np.log1p(own / size), marks / np.maximum(words, 1)
    out[:, 9], out[:, 10] = words / np.maximum(blocks, 1), own / max(own[0], 1)
    out[:, 11], out[:, 12], out[:, 13] = here, least, most
    out[:, 14], out[:, 15], out[:, 16] = here[up], np.log1p(direct), own / np.maximum(own[up], 1)
    return out


class Boosted:
    """Boosted regression trees of one depth for the logistic loss, split at quantiles; stored as flat arrays."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins)) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(len(x), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(x), int)
            feature, threshold = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                choice = [(0, self.bins)] * width
                for f in range(x.shape[1]):
                    flat = node * self.bins + binned[:, f]
                    g = np.bincount(flat, gradient, width * self.bins).reshape(width, -1).cumsum(axis=1)
                    w = np.bincount(flat, weight, width * self.bins).reshape(width, -1).cumsum(axis=1)
                    gain = g**2 / (w + self.ridge) + (g[:, -1:] - g) ** 2 / (w[:, -1:] - w + self.ridge) - g[:, -1:] ** 2 / (w[:, -1:] + self.ridge)
                    k = gain.argmax(axis=1)
                    for i in range(width):
                        if gain[i, k[i]] > best[i] + 1e-9 and k[i] < len(cuts[f]):
                            best[i], choice[i] = gain[i, k[i]], (f, int(k[i]))
                for i, (f, k) in enumerate(choice):
                    feature[first + i] = f
                    threshold[first + i] = cuts[f][k] if k < len(cuts[f]) else np.inf
                chosen = np.array([f for f, _ in choice])[node]
                node = node * 2 + (x[np.arange(len(x)), chosen] > threshold[first + node])
            g, w = np.bincount(node, gradient, 2**self.depth), np.bincount(node, weight, 2**self.depth)
            leaf = self.rate * g / (w + self.ridge)
            self.trees.append((feature, threshold, leaf))
            z = z + leaf[node]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > threshold[at])
            z += leaf[node]
        return z


# Names that the generator gives to the parts of its pages; a page of the table may use any others.
ARTICLE_NAMES = "article content post entry main story body text maincontent article-body post-content entry-content blog-post hentry articleBody page-content".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs pager pagination".split(),
    "header": "header masthead site-header banner top branding".split(),
    "footer": "footer site-footer bottom copyright colophon legal".split(),
    "aside": "sidebar aside widget related recommended trending popular rail".split(),
    "div": "ad ads advert advertisement sponsor promo cookie notice consent popup newsletter subscribe share social toolbar banner".split(),
    "form": "form search login signup subscribe".split(),
    "section": "comments comment-list comment replies discussion reader-comments disqus".split(),
}


class Drawn:
    """One page of the generator: its source, and of each element (in page order) whether it is of the article."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.mark = rng, [], []

    def open(self, tag: str, good: bool, names: list[str] | None = None) -> None:
        if tag not in INLINE:  # those are part of their block
            self.mark.append(good)
        name = f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}"' if names else ""
        self.out.append(f"<{tag}{name}>")

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def prose(self, least: int, most: int) -> str:
        rng, words = self.rng, []
        for _ in range(rng.randint(least, most)):
            word = "".join(rng.choice("aeiourstlnmdc") for _ in range(rng.randint(1, 9)))
            words.append(word + rng.choice(["", "", "", "", "", "", "", ",", ".", rng.choice("!?;:%")]))
        text = " ".join(words)
        return text + rng.choice([".", ".", ""])

    def leaf(self, tag: str, good: bool, least: int, most: int, names: list[str] | None = None, link: bool = False) -> None:
        self.open(tag, good, names)
        text = self.prose(least, most)
        self.out.append(f'<a href="/x">{text}</a>' if link else text)
        self.close(tag)

    def links(self, tag: str, n: int) -> None:
        self.open(tag, False)
        for _ in range(n):
            self.leaf("li", False, 1, 3, link=True)
        self.close(tag)

    def other(self, kind: str, bare: bool) -> None:
        rng = self.rng
        tag = kind if rng.random() < 0.6 else "div"
        named = OTHER_NAMES[kind] if tag == "div" or rng.random() < 0.5 else None
        self.open(tag, False, None if bare and tag != "div" else named)
        if kind in ("nav", "header", "aside") and rng.random() < 0.8:
            if kind != "nav":
                self.leaf(rng.choice(["h1", "h2", "h3", "div", "p"]), False, 1, 6)
            self.links("ul", rng.randint(2, 9))
        elif kind == "section":
            for _ in range(rng.randint(1, 6)):
                self.open("div", False, ["comment", "reply", "comment-body"])
                self.leaf("p", False, 3, 60)
                self.close("div")
        elif rng.random() < 0.5:
            self.out.append(self.prose(2, 25))
        else:
            for _ in range(rng.randint(1, 3)):
                self.leaf(rng.choice(["p", "p", "div", "span"]) if kind != "form" else "label", False, 2, 25) if rng.random() < 0.9 else self.links("ul", 3)
        self.close(tag)

    def article(self) -> None:
        rng = self.rng
        wrap = rng.choice([0, 0, 1, 2])
        tags = []
        for _ in range(wrap):
            tags.append(rng.choice(["div", "section", "main", "td"]) if rng.random() < 0.8 else "main")
            tags[-1] = "div" if tags[-1] == "td" else tags[-1]
            self.open(tags[-1], True, rng.choice([None, ARTICLE_NAMES, ["wrapper", "container", "row", "col", "page"]]))
        tag = rng.choice(["article", "article", "main", "div", "section"])
        self.open(tag, True, ARTICLE_NAMES if rng.random() < 0.4 else None)
        if rng.random() < 0.8:
            self.leaf("h1", True, 2, 12)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 30])):
            kind = rng.random()
            if kind < 0.75:
                self.leaf("p", True, *rng.choice([(1, 4), (5, 40), (20, 90), (60, 200)]))
            elif kind < 0.82:
                self.leaf(rng.choice(["h2", "h3"]), True, 1, 9)
            elif kind < 0.87:
                self.open(rng.choice(["ul", "ol"]), True)
                for _ in range(rng.randint(1, 6)):
                    self.leaf("li", True, 3, 25)
                self.out.append("</ul></ol>")
            elif kind < 0.91:
                self.open("blockquote", True)
                self.leaf("p", True, 8, 50)
                self.close("blockquote")
            elif kind < 0.94:
                self.leaf("pre", True, 5, 40)
            else:
                self.other(rng.choice(["div", "aside"]), False)
        self.close(tag)
        for t in reversed(tags):
            self.close(t)

    def draw(self) -> Drawn:
        rng, bare = self.rng, self.rng.random() < 0.3
        self.open("html", True)
        self.open("body", True)
        for kind in ("header", "nav", "div"):
            if rng.random() < 0.6:
                self.other(kind, bare)
        if rng.random() < 0.97:
            self.article()
        for kind in ("aside", "div", "section", "form", "footer"):
            if rng.random() < 0.45:
                self.other(kind, bare)
        self.out.append("</body></html>")
        return self


@dataclass(frozen=True)
class Model:
    worth: dict[str, float]
    trees: Boosted


@lru_cache(maxsize=4)
def train(pages: int = 1000, seed: int = 29) -> Model:
    """The model, from ``pages`` generated pages: the first half gives the worth of tokens, both halves the trees, which see part of the names only."""
    rng = random.Random(seed)
    drawn = [Drawn(rng).draw() for _ in range(pages)]
    inside, outside = Counter(), Counter()
    for d in drawn[: pages // 2]:
        page = parse("".join(d.out))
        for tokens, good in zip(page.tokens[1:], d.mark, strict=True):
            (inside if good else outside).update(tokens)
    a, b = sum(inside.values()), sum(outside.values())
    worth = {t: float(np.log((inside[t] + 1) / (a + 2)) - np.log((outside[t] + 1) / (b + 2))) for t in inside | outside}
    x, y = [], []
    for d in drawn:
        page = parse("".join(d.out))
        # Names that the table's pages use were mostly never seen: in two pages of three some names, or all, are hidden from the trees.
        hidden = {t: rng.random() for t in dict.fromkeys(t for tokens in page.tokens for t in tokens[1:])}
        share = rng.choice([0.0, 0.5, 1.0])
        page.tokens = [(tokens[0], *(t for t in tokens[1:] if hidden[t] >= share)) for tokens in page.tokens]
        x.append(features(page, worth)[1:])
        y += d.mark
    return Model(worth, Boosted().fit(np.concatenate(x), np.array(y, float)))


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """Which elements are kept: the best set in which every kept element's parent is kept. The page itself always is."""
    n = len(page.parent)
    total = log_odds.tolist()
    for i in range(n - 1, 0, -1):
        if total[i] > 0:
            total[page.parent[i]] += total[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and total[i] > 0
    return keep


def extract(sources: list[str | None], model: Model) -> list[str]:
    """The main texts of pages; the trees run over all elements of all pages at once."""
    pages = [parse(s or "") for s in sources]
    if not pages:
        return []
    made = [features(p, model.worth) for p in pages]
    scores = np.split(model.trees.log_odds(np.concatenate(made)), np.cumsum([len(m) for m in made])[:-1])
    out = []
    for page, score in zip(pages, scores, strict=True):
        keep = decode(page, score)
        out.append("\n".join(t for t, h in zip(page.texts, page.holder, strict=True) if keep[h]))
    return out


def main_text(pages: DataFrame, model: Model | None = None, batch_bytes: int = 1 << 22) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # some thousand numbers

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            sizes = np.array([len(h or "") for h in batch.column("html").to_pylist()])
            while a < len(batch):
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), batch_bytes, side="right")))
                part = batch.slice(a, b - a)
                texts = extract(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                a = b

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
