"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded so that nodes agree with their ancestors.

A page becomes a tree of block elements, whose runs of text are leaves. Every node has features of its tag, its attribute
tokens and its ancestors', depth, density of text and links in its subtree, its siblings, how often its attributes repeat,
and where it stands to the element that holds most running text. Boosted trees, trained on generated pages whose layout is
random and whose labels are therefore known, give each node the log-odds that it holds main text. Most generated pages use
names that no list has, so that structure has to tell; words of the list (``_TOKENS``) only help where a page uses them. Decoding picks the set of nodes with the largest sum of log-odds in which every node's parent is
picked too; so nothing is kept under a dropped menu, and no ancestor of kept text is dropped.

Spark partitions the pages; a task parses and scores an Arrow batch at a time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|iframe|textarea)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][\w:-]*)[^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements that are left out with all they hold; of one that has no end tag, only the tag is.
_HIDDEN = {t: re.compile(rf"<(?P<end>/?){t}(?=[\s/>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.I) for t in ("svg", "object", "select", "template", "noscript")}
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Elements that make a node; all others are part of the text around them.
_BLOCKS = {*"html head title body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption nav header footer aside form fieldset label button details summary dialog address center menu hgroup".split()}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Groups of tags and of attribute tokens; the place in the list is the feature.
_TAGS = [{"#text"}, {"p", "pre", "blockquote"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"article", "main"}, {"div", "section", "center"}, {"nav", "menu"}, {"header"}, {"footer", "address"}, {"aside"}, {"form", "fieldset", "label", "button", "dialog"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"head", "title"}, {"html", "body"}]
_TOKENS = [
    {"article", "content", "main", "post", "story", "entry", "body", "text", "maincontent"},
    {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "adsense"},
    {"nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc"},
    {"sidebar", "side", "related", "widget", "aside", "recommended", "trending", "popular", "complementary", "rail"},
    {"footer", "foot", "contentinfo", "copyright", "legal", "colophon", "bottom"},
    {"header", "masthead", "top", "logo", "site"},
    {"comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "commentlist"},
    {"cookie", "consent", "notice", "alert", "gdpr", "modal", "popup", "overlay", "message", "warning", "dialog"},
    {"share", "social", "newsletter", "subscribe", "signup", "login", "search", "form", "tags", "meta", "byline"},
]
_TAG_OF = {t: k for k, group in enumerate(_TAGS) for t in group}
_TOKEN_OF = {t: k for k, group in enumerate(_TOKENS) for t in group}
_BAD_TAGS = {5, 6, 7, 8, 9, 13}
N_FEATURES = len(_TAGS) + 2 * len(_TOKENS) + 25
#: Places of the tags whose text runs on: text, paragraphs, headings, and lists, tables and figures.
_RUNNING = {0, 1, 2} | {_TAG_OF[t] for t in ("ul", "table", "dl", "figure") if t in _TAG_OF}


@dataclass
class Page:
    """Nodes in page order, parents before children; a leaf's text is kept in ``text``, others have None."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[int, ...]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)  # class, id and role as they stand
    text: list[str | None] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, tokens: tuple[int, ...] = (), text: str | None = None, links: int = 0, names: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.names.append(names)
        self.text.append(text)
        self.links.append(links)
        return len(self.tag) - 1


@lru_cache(4096)
def _groups(attrs: str) -> tuple[tuple[int, ...], str]:
    """The groups of ``_TOKENS`` that an element's names have words of, and the names."""
    names = " ".join("".join(m) for m in _ATTR.findall(attrs))
    return tuple(sorted({_TOKEN_OF[w] for w in _SPLIT.split(names.lower()) if w in _TOKEN_OF})), names


def _ends(source: str, tag: str) -> dict[int, int]:
    """Where the elements of a tag that are closed end, by where they start. An svg may close itself."""
    opened: list[int] = []
    ends = {}
    for m in _HIDDEN[tag].finditer(source):
        if m["end"]:
            if opened:
                ends[opened.pop()] = m.end()
        elif tag == "svg" and m[0].endswith("/>"):
            ends[m.start()] = m.end()
        else:
            opened.append(m.start())
    return ends


def parse(source: str) -> Page:
    """The tree of a page, however its tags are nested or left open.

    As in HTML5, a script, style, iframe or textarea without an end tag takes the rest of the page.
    """
    page = Page()
    stack, open_tags = [page.add(-1, "html")], ["html"]
    there: Counter[str] = Counter()  # how many of each tag are open, but for the first
    run: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.add(stack[-1], "#text", (), text, min(linked, len(text)))
            run.clear()
        linked = 0

    def close() -> None:
        there[open_tags.pop()] -= 1
        stack.pop()

    hidden: dict[str, dict[int, int]] = {}
    found = _TOKEN.finditer(source)
    while m := next(found, None):
        if m.start() > at:
            run.append(source[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["end"] or m["end2"])
        if tag in _HIDDEN:
            if tag not in hidden:
                hidden[tag] = _ends(source, tag)
            if m.start() in hidden[tag]:
                at = hidden[tag][m.start()]
                found = _TOKEN.finditer(source, at)
            continue
        if tag not in _BLOCKS:
            if tag in ("br", "hr", "img", "input"):
                run.append(" ")
            elif tag == "a":
                in_link = not closing
            continue
        flush()
        in_link = False
        if closing:
            if there[tag]:
                while open_tags[-1] != tag:
                    close()
                close()
            continue
        if tag in ("html",):
            continue
        if open_tags[-1] == "p":
            close()
        if tag in _CLOSES and any(there[t] for t in _CLOSES[tag]):
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k] in _SCOPE[tag]:
                    break
                if open_tags[k] in _CLOSES[tag]:
                    while len(stack) > k:
                        close()
                    break
        if tag == "body" and there["head"]:
            while there["head"]:
                close()
        groups, names = _groups(m["attrs"] or "")
        stack.append(page.add(stack[-1], tag, groups, names=names))
        open_tags.append(tag)
        there[tag] += 1
    if at < len(source):
        run.append(source[at:])
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """One row of features for each node."""
    n = len(page.tag)
    parent = page.parent
    chars, links, marks, nodes, leaves = [0] * n, list(page.links), [0] * n, [1] * n, [0] * n
    for i, text in enumerate(page.text):
        if text is not None:
            chars[i], leaves[i] = len(text), 1
            marks[i] = text.count(".") + text.count(",")
    children, place, alike, depth = [0] * n, [0] * n, {}, [0] * n
    kinds = [_TAG_OF.get(t, 4) for t in page.tag]
    bad, up = [0] * n, [0] * n  # up: the tokens of all ancestors, a bit each
    for i in range(1, n):
        p = parent[i]
        place[i] = children[p]
        children[p] += 1
        key = (p, kinds[i])
        alike[key] = alike.get(key, 0) + 1
        depth[i] = depth[p] + 1
        bad[i] = bad[p] + (kinds[p] in _BAD_TAGS)
        up[i] = up[p] | sum(1 << t for t in page.tokens[p])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        nodes[p] += nodes[i]
        leaves[p] += leaves[i]
    out = np.zeros((n, N_FEATURES), np.float32)
    row = np.arange(n)
    out[row, kinds] = 1
    base = len(_TAGS)
    for i in range(n):
        for t in page.tokens[i]:
            out[i, base + t] = 1
    out[:, base + len(_TOKENS) : base + 2 * len(_TOKENS)] = np.array(up)[:, None] >> np.arange(len(_TOKENS)) & 1
    base += 2 * len(_TOKENS)
    c, a = np.array(chars, np.float32), np.maximum(np.array(parent), 0)
    k, same = np.array(kinds), np.array([alike.get((parent[i], kinds[i]), 1) for i in range(n)], np.float32)
    total = max(float(c[0]), 1.0)
    size = np.array(children, np.float32)
    more = _around(page, kinds, chars, links, depth)
    out[:, base:] = np.stack(
        [
            np.array(depth), np.log1p(c), np.array(links) / np.maximum(c, 1), np.array(marks) / np.maximum(c, 1),
            c / np.array(nodes), c / total, c / np.maximum(c[a], 1), size, np.array(place) / np.maximum(size[a], 1),
            same, np.array(bad), k[a], np.log1p(c / np.maximum(np.array(leaves), 1)), *more,
        ],
        axis=1,
    )
    return out


def _around(page: Page, kinds: list[int], chars: list[int], links: list[int], depth: list[int]) -> list[np.ndarray]:
    """Features of repetition, and of where nodes stand to the page's main holder of running text.

    That holder has the most characters, links aside, in children whose text runs on, those of its own children counting
    half. No word of an attribute is looked at, only whether there are any and how often they repeat.
    """
    n, parent = len(page.tag), page.parent
    named = [bool(x) for x in page.names]
    alike = Counter((parent[i], page.tag[i], page.names[i]) for i in range(1, n) if named[i])
    everywhere = Counter((page.tag[i], page.names[i]) for i in range(1, n) if named[i])
    own = [0.0] * n
    for i in range(1, n):
        if kinds[i] in _RUNNING:
            own[parent[i]] += chars[i] - links[i]
    score = list(own)
    for i in range(1, n):
        score[parent[i]] += own[i] / 2
    holder = max(range(n), key=lambda i: (score[i], -i))
    inside, repeated, above, between, titled, before = [False] * n, [0] * n, [0] * n, [0] * n, [False] * n, [0] * n
    seen = 0
    for i in range(n):
        before[i] = seen
        if page.text[i] is not None:
            seen += chars[i]
        if i == 0:
            inside[0] = holder == 0
            continue
        p = parent[i]
        repeated[i] = alike[parent[i], page.tag[i], page.names[i]] if named[i] else 0
        above[i] = max(above[p], repeated[i])
        inside[i] = inside[p] or i == holder
        # named elements between the holder and this one, itself included, paragraphs and items aside
        between[i] = between[p] + (named[i] and kinds[i] not in _RUNNING) if inside[p] else 0
    for i in range(n - 1, 0, -1):
        titled[i] = titled[i] or page.tag[i] == "h1"
        titled[parent[i]] = titled[parent[i]] or titled[i]
    over = [False] * n
    i = holder
    while i >= 0:
        over[i] = True
        i = parent[i]
    last = before[holder] + chars[holder]
    place = [0 if over[i] or inside[i] else -1 if before[i] < last and before[i] <= before[holder] else 1 for i in range(n)]
    total, held = max(chars[0], 1), max(score[holder], 1.0)
    many = [everywhere[page.tag[i], page.names[i]] if named[i] else 0 for i in range(n)]
    columns = [named, repeated, above, many, inside, over, place, between, [depth[i] - depth[holder] if inside[i] else -9 for i in range(n)], [b / total for b in before], titled, [x / held for x in score]]
    return [np.array(x, np.float32) for x in columns]


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: at level l, node j of a tree splits feature[t, 2^l - 1 + j] at cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        rows = np.arange(len(x))
        z = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += leaf[at - (2**self.depth - 1)]
        return z


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 5, rate: float = 0.25, bins: int = 24) -> Boosted:
    """Gradient-boosted trees for 0/1 labels, by second-order gains over quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(width)], axis=1)
    inner, base = 2**depth - 1, float(np.log(y.mean() / (1 - y.mean())))
    z, out = np.full(n, base), Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base, depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            best, pick = np.full(here, 1e-6), [(0, np.inf, bins)] * here
            for f in range(width):
                key = (at - first) * (bins + 1) + binned[:, f]
                sg, sh = (np.bincount(key, v, minlength=here * (bins + 1)).reshape(here, -1).cumsum(axis=1) for v in (g, h))
                G, H = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + 1) + (G - sg) ** 2 / (H - sh + 1) - G**2 / (H + 1)
                gain[(sh < 1) | (H - sh < 1)] = 0
                for j in range(here):
                    b = int(gain[j, : len(cuts[f])].argmax()) if len(cuts[f]) else 0
                    if len(cuts[f]) and gain[j, b] > best[j]:
                        best[j], pick[j] = gain[j, b], (f, float(cuts[f][b]), b)
            for j, (f, cut, _) in enumerate(pick):
                out.feature[t, first + j], out.cut[t, first + j] = f, cut
            side = binned[np.arange(n), np.array([q[0] for q in pick])[at - first]] > np.array([q[2] for q in pick])[at - first]
            at = 2 * at + 1 + side
        k = at - inner
        out.leaf[t] = rate * np.bincount(k, g, minlength=inner + 1) / (np.bincount(k, h, minlength=inner + 1) + 1)
        z += out.leaf[t][k]
    return out


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The nodes of the largest sum of log-odds in which each node's parent is picked."""
    gain = odds.tolist()
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = [g > 0 for g in gain]
    for i in range(1, len(keep)):
        keep[i] = keep[i] and keep[parent[i]]
    return np.array(keep)


_MARK = "\ue000"


class _Maker:
    """Pages with random layouts and known main text: the training data, made by rule from a seed.

    ``strange`` is the share of pages whose names are made up, letters and all, for that page.
    """

    def __init__(self, seed: int, strange: float = 0.7):
        self.r = np.random.default_rng(seed)
        self.strange = strange
        self.start()

    def start(self) -> None:
        """Choose how the next page names things, writes its paragraphs and shows its comments."""
        self.made_up: dict[str, str] | None = {} if self.chance(self.strange) else None
        self.paragraph = f' class="{self.name("text")}"' if self.chance(0.2) else ""
        self.item = self.pick(["div", "li", "article", "section"])
        self.by = int(self.r.integers(3))

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def pick(self, items: list):
        return items[int(self.r.integers(len(items)))]

    def name(self, known: str) -> str:
        if self.made_up is None:
            return known
        if known not in self.made_up:
            letters = "abcdefghijklmnopqrstuvwxyz0123456789"
            self.made_up[known] = "q" + "".join(self.pick(list(letters)) for _ in range(int(self.r.integers(3, 10))))
        return self.made_up[known]

    def words(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high + 1))
        out = ["".join(self.pick(["an", "to", "re", "li", "so", "mu", "ek", "du", "ir"]) for _ in range(int(self.r.integers(1, 4)))) for _ in range(n)]
        return " ".join(w + ("." if self.chance(0.09) else "," if self.chance(0.07) else "") for w in out).capitalize()

    def link(self) -> str:
        return f'<a href="/{self.pick(["a", "b"])}">{self.words(1, 3)}</a>'

    def wrapped(self, tag: str, names: list[str], body: str, p: float = 0.7) -> str:
        attr = f' {self.pick(["class", "class", "id"])}="{self.name(self.pick(names))}"' if self.chance(p) else ""
        return f"<{tag}{attr}>{body}</{tag}>"

    def list_of_links(self) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(int(self.r.integers(2, 9)))) + "</ul>"

    def comments(self) -> str:
        """What readers say: items alike, each with a name, a time or an answer link, and some paragraphs."""
        items = ""
        for _ in range(int(self.r.integers(1, 9))):
            who = ["", f"<span>{self.words(1, 2)}</span> ", f"<div>{self.link()} {self.words(1, 3)}</div>"][self.by]
            items += f'<{self.item} class="{self.name("comment")}">{who}' + "".join(f"<p>{self.words(3, 60)}</p>" for _ in range(int(self.r.integers(1, 3)))) + (self.link() if self.by else "") + f"</{self.item}>"
        items = f"<ul>{items}</ul>" if self.item == "li" else items
        heading = f"<h{self.pick([2, 3])}>{self.words(1, 3)}</h3>" if self.chance(0.5) else ""
        return self.wrapped(self.pick(["div", "section"]), ["comments", "comment-list", "disqus", "reader-comments"], heading + items, 1)

    def junk(self) -> str:
        kind = int(self.r.integers(10))
        prose = "".join(f"<p>{self.words(3, 40)}</p>" for _ in range(int(self.r.integers(1, 3))))
        loose = self.words(2, 25)
        if kind == 0:
            return self.wrapped("nav", ["menu", "main-nav", "breadcrumb"], self.list_of_links(), 0.4)
        if kind == 1:
            return self.wrapped("div", ["ad", "ads", "advert", "promo", "ad-banner", "sponsored"], self.pick([loose, prose]), 1)
        if kind == 2:
            return self.wrapped("aside", ["sidebar", "related", "widget"], self.pick([prose, self.list_of_links(), loose]), 0.6)
        if kind == 3:
            return self.wrapped("form", ["newsletter", "search", "login"], f"<label>{self.words(1, 4)}</label><button>{self.words(1, 2)}</button>{self.pick(['', prose])}", 0.5)
        if kind == 4:
            return self.comments()
        if kind == 5:
            return self.wrapped("div", ["cookie-notice", "notice", "consent", "alert", "popup"], self.pick([loose, prose]), 1)
        if kind == 6:
            return self.wrapped("div", ["share", "social", "subscribe", "newsletter"], self.pick([loose, self.list_of_links()]), 1)
        if kind == 7:
            return self.wrapped("div", ["sidebar", "related", "menu", "nav", "popular"], self.pick([prose, self.list_of_links()]), 1)
        if kind == 8:
            return self.wrapped("header", ["site-header", "masthead"], loose + self.pick(["", self.list_of_links()]), 0.4)
        return self.wrapped("footer", ["footer", "site-footer"], self.pick([loose, "&copy; " + loose, prose]), 0.4)

    def block(self) -> str:
        kind = int(self.r.integers(12))
        text = self.words(1, 8) if self.chance(0.15) else self.words(5, 90)
        if self.chance(0.25):
            text += f" {self.link()} " + self.words(2, 12)
        mark = lambda x: f"<main-text>{x}</main-text>"
        if kind < 7:
            return f"<p{self.paragraph}>{self.pick(['', '<b>'])}{mark(text)}{self.pick(['</p>', '</p>', '<br>'])}"
        if kind == 7:
            return f"<h2>{mark(self.words(2, 8))}</h2>"
        if kind == 8:
            return "<ul>" + "".join(f"<li>{mark(self.words(3, 20))}</li>" for _ in range(int(self.r.integers(2, 5)))) + "</ul>"
        if kind == 9:
            return f"<blockquote><p>{mark(text)}</p></blockquote>"
        if kind == 10:
            return "<table>" + "".join(f"<tr><td>{mark(self.words(1, 5))}</td><td>{mark(self.words(1, 9))}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{mark(text)}</div>"

    def page(self) -> str:
        self.start()
        title = f"<h1>{'<main-text>' + self.words(2, 12) + '</main-text>'}</h1>" if self.chance(0.85) else ""
        if title and self.chance(0.2):  # the article's own header is its title's
            title = f"<header>{title}</header>"
        body = ""
        for _ in range(int(self.r.integers(1, 9))):
            body += self.junk() if self.chance(0.08) else self.block()
        if self.chance(0.15):
            body = "".join(f"<section><h2>{'<main-text>' + self.words(1, 6) + '</main-text>'}</h2>{self.block()}{self.block()}</section>" for _ in range(int(self.r.integers(2, 5))))
        body = title + body
        kind = int(self.r.integers(6))
        if kind < 3:
            main = self.wrapped("article", ["post", "entry", "article"], body, 0.3)
        elif kind == 3:
            main = self.wrapped("main", ["content", "main"], body, 0.4)
        else:
            main = self.wrapped("div", ["content", "article-body", "post-content", "main", "story", "entry-text"], body, 1)
        if self.chance(0.25):
            main = self.wrapped("div", ["wrapper", "container", "page"], main)
        top = "".join(self.junk() for _ in range(int(self.r.integers(0, 4))))
        end = "".join(self.junk() for _ in range(int(self.r.integers(0, 4)))) + (self.comments() if self.chance(0.2) else "")
        head = f"<head><title>{self.words(2, 12)}</title></head>" if self.chance(0.9) else ""
        return f"<!DOCTYPE html><html>{head}<body>{top}{main}{end}</body></html>"


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A generated page without its marks, and which of its nodes hold main text in their subtree."""
    page = parse(source.replace("<main-text>", _MARK).replace("</main-text>", ""))
    y = np.zeros(len(page.tag))
    for i, text in enumerate(page.text):
        if text is not None and _MARK in text:
            y[i] = 1
            page.text[i] = text.replace(_MARK, "")
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return page, y


def train(pages: int = 600, seed: int = 5) -> Boosted:
    maker = _Maker(seed)
    made = [labelled(maker.page()) for _ in range(pages)]
    return boost(np.concatenate([features(p) for p, _ in made]), np.concatenate([y for _, y in made]))


def texts_of(sources: list[str], model: Boosted) -> list[str]:
    """The main texts of some pages, scored together."""
    pages = [parse(s) for s in sources]
    odds = model.raw(np.concatenate([features(p) for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        keep = decode(p.parent, odds[at : at + len(p.tag)])
        at += len(p.tag)
        out.append(" ".join(p.text[i] for i in np.flatnonzero(keep) if p.text[i] is not None))
    return out


def extract(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text (empty if there is none), n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one. A null
    html is an empty one. Repeated rows are extracted each; ids and urls, null or not, are carried along. An empty table
    gives an empty one. Other columns are not read.
    """
    handed = pages.sparkSession.sparkContext.broadcast(model or train())  # some kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 1 << 20):
            found = pa.array(texts_of([x or "" for x in batch.column("html").to_pylist()], handed.value), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], ["page_id", "url", "text"])

    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in ("page_id", "url"))
    return source.mapInArrow(run, f"{kinds}, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
