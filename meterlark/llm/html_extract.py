"""Main-text extraction: gradient-boosted trees over DOM nodes with hierarchical decoding.

A page is parsed into elements (implied end tags, raw script and style text). Each element is described by
the text, links, punctuation and tags of its subtree, tokens of its tag and attributes, depth and siblings, and
by what its ancestors are. Boosted trees give the probability that all text below it is article text.

Decoding picks the most likely consistent labelling of the tree: an element is outside (its children are free),
content (its children are content or rejected) or rejected (its descendants are rejected too), so no element
contradicts its ancestors. A heading right before content belongs to it; a page that has no box for its article, or
of which nothing is content, is the article itself, but for its menus, headers, footers, forms and the like.

The trees are trained here, on pages that a generator with known main text makes (containers, menus, banners,
notices, forms, comments under many names) and on at most `max_pages` pages of the table of at most MAX_CHARS
characters, those with the smallest hashes of page_id, whose own article or main element tells the label; in training, semantic names
are hidden at random so that the trees learn shape and text as well.

Text: character references decoded, white space inside a block one space, trimmed, blocks joined by one line
feed in page order. Defined results: null or empty html gives the empty text, as does a page without text outside of menus and the like;
rows that repeat a page_id each come out; an empty table gives an empty result; other columns are ignored.
"""

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import cut

#: The table's pages in the training sample, their characters at most, and the pages that the generator makes.
MAX_PAGES, MAX_CHARS, MADE_PAGES = 200, 1 << 16, 500
#: What it costs, in nats, to reject an element inside content.
SWITCH = 2.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style template noscript head title meta link svg iframe object select option button textarea input".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
#: What an opening tag closes, if it is open nearer than the given container.
_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tbody thead select body article main section div".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_MARKUP = re.compile(r"<[a-zA-Z/!?]")
#: A tag without quotes; it stops at the next "<", so looking for it never reads far.
_PLAIN = re.compile(r"<([a-zA-Z][^\s<>/\"']*)([^<>\"']*)>")
_NAME, _SKIP, _EQUALS, _BARE = (re.compile(x) for x in (r"[^\s>/]+", r"[\s/]*", r"\s*=\s*", r"[^\s>]*"))
_ATTRIBUTE = re.compile(r"[^\s>/][^\s=>/]*")
_NAMING = frozenset("class id role itemprop aria-label name".split())
_WORD = re.compile(r"[a-z]+")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

BAD = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot header masthead sidebar side aside widget "
    "cookie cookies consent notice notices alert popup modal overlay gdpr comment comments reply replies disqus respond share sharing social related recommended recommend more tags tag "
    "subscribe newsletter signup login form search pagination pager copyright legal skip toolbar rail teaser outbrain taboola contentinfo complementary dialog".split()
)
GOOD = frozenset("article articlebody body content entry main post story text page prose blog hentry".split())
TAGS = ("article main section div p h1 h2 h3 ul ol li a nav header footer aside form table figure blockquote pre span b body html".split())
SHAPE = 26
FEATURES = SHAPE + len(TAGS)


class Node:
    __slots__ = ("tag", "parent", "children", "items", "tokens", "chars", "links", "tags", "marks", "words", "depth", "at", "label")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.children, self.items, self.tokens = tag, parent, [], [], ()
        self.chars = self.links = self.tags = self.marks = self.words = 0
        self.depth, self.at, self.label = (parent.depth + 1 if parent else 0), 0, 0
        if parent:
            self.at = len(parent.children)
            parent.children.append(self)


def _tokens(attributes: list[tuple[str, str]]) -> tuple:
    found = []
    for name, value in attributes:
        if name.lower() in _NAMING:
            found += _WORD.findall(_SPLIT_CAMEL.sub(" ", value).lower())
    return tuple(found)


class Scanner:
    """Reads tags in time that is linear in the page, however its quotes and brackets are broken.

    An unquoted value ends at white space or ">". A quote that is never closed, or whose closing one is
    followed by neither space nor end of tag while the value holds a ">", ends at the next ">".
    """

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.missing: set[str] = set()  # quotes that do not come any more
        self.quotes = True  # whether quotes still mean something

    def end_of(self, at: int) -> int:
        """Behind the next ">", or the end of the page."""
        end = self.page.find(">", at)
        return self.size if end < 0 else end + 1

    def tag(self, at: int) -> tuple[str, list[tuple[str, str]], bool, int]:
        """Name, attributes, whether it closes itself, and what follows the opening tag at `at`."""
        m = _PLAIN.match(self.page, at)
        if m is not None:
            inside = m.group(2)
            attributes = [tuple(x.split("=", 1)) for x in inside.split() if "=" in x] if "=" in inside else []
            return m.group(1).lower(), attributes, inside.rstrip().endswith("/"), m.end()
        name = _NAME.match(self.page, at + 1)
        if self.quotes:
            attributes, end = self._attributes(name.end())
            if end is not None:
                return name.group().lower(), attributes, self.page[end - 2] == "/", end
            self.quotes = False  # a wrong quote has eaten the rest of the page
        return name.group().lower(), [], False, self.end_of(name.end())

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int | None]:
        page, found = self.page, []
        while True:
            at = _SKIP.match(page, at).end()
            if at >= self.size:
                return found, None
            if page[at] == ">":
                return found, at + 1
            m = _ATTRIBUTE.match(page, at)
            name, at = m.group(), m.end()
            m = _EQUALS.match(page, at)
            if m is None:
                continue
            at = m.end()
            if at < self.size and page[at] in "\"'":
                value, at = self._quoted(page[at], at + 1)
            else:
                m = _BARE.match(page, at)
                value, at = m.group(), m.end()
            found.append((name, value))

    def _quoted(self, quote: str, at: int) -> tuple[str, int]:
        page = self.page
        end = -1 if quote in self.missing else page.find(quote, at)
        if end < 0:
            self.missing.add(quote)
        elif page[end + 1 : end + 2].strip("/> \t\n\r\f") == "" or ">" not in page[at:end]:
            return page[at:end], end + 1
        end = page.find(">", at)
        end = self.size if end < 0 else end
        return page[at:end], end


class _Open:
    """The open elements, with what is needed to close them in constant time each."""

    def __init__(self, root: "Node"):
        self.stack, self.at = [root], {}
        self.blocks, self.scopes = [0], [0]  # depths of open elements that are no inline ones, and of containers

    def push(self, node: "Node") -> None:
        depth = len(self.stack)
        self.at.setdefault(node.tag, []).append(depth)
        if node.tag not in INLINE:
            self.blocks.append(depth)
        if node.tag in _SCOPE:
            self.scopes.append(depth)
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Close the element at a depth and all inside it."""
        while len(self.stack) > depth:
            tag, last = self.stack.pop().tag, len(self.stack)
            self.at[tag].pop()
            if self.blocks[-1] == last:
                self.blocks.pop()
            if self.scopes[-1] == last:
                self.scopes.pop()

    def end_tag(self, tag: str) -> None:
        # An inline end tag does not close blocks.
        if self.at.get(tag) and not (tag in INLINE and self.blocks[-1] > self.at[tag][-1]):
            self.close(self.at[tag][-1])

    def before(self, tag: str) -> None:
        """Close what the start of an element of this tag implies to be closed."""
        if tag in _CLOSES_P and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in _ITEM:
            inside = [depths[k] for depths in (self.at.get(t, ()) for t in _ITEM[tag]) if (k := bisect_right(depths, self.scopes[-1])) < len(depths)]
            if inside:
                self.close(min(inside))


_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


def parse(page: str) -> Node:
    """The element tree; items of a node are its child nodes and pieces of raw text, in page order."""
    root = Node("#root", None)
    scan, opened = Scanner(page), _Open(root)
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        start = n if m is None else m.start()
        if start > at:
            opened.stack[-1].items.append(page[at:start])
        if m is None:
            break
        kind = page[start + 1]
        if kind == "!" and page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
        elif kind in "!?":
            at = scan.end_of(start)
        elif kind == "/":
            name = _NAME.match(page, start + 2)
            if name is not None:
                opened.end_tag(name.group().lower())
            at = scan.end_of(start)
        else:
            tag, attributes, closed, at = scan.tag(start)
            opened.before(tag)
            node = opened.stack[-1]
            made = Node(tag, node)
            if attributes:
                made.tokens = _tokens(attributes)
            node.items.append(made)
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = scan.end_of(end.end()) if end else n
            elif tag not in VOID and not closed:
                opened.push(made)
    return root


_MARKS = re.compile(r"[.,;:!?]")
_BLANK = " \t\n\r\f\x0b\x01"


def measure(root: Node) -> list[Node]:
    """All visible nodes, parents first, with their subtree sums."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in HIDDEN:
            continue
        nodes.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(nodes):
        for item in node.items:
            if isinstance(item, str):
                text = item.strip(_BLANK)
                if text:
                    node.chars += len(text)
                    node.words += text.count(" ") + 1
                    node.marks += len(_MARKS.findall(text))
        node.tags += 1
        if node.tag == "a":
            node.links = node.chars
        if node.parent:
            p = node.parent
            p.chars += node.chars
            p.links += node.links
            p.tags += node.tags
            p.marks += node.marks
            p.words += node.words
    return nodes


_TAG_AT = {t: i for i, t in enumerate(TAGS)}


def describe(nodes: list[Node], hide=None) -> np.ndarray:
    """One row of features for each node; hide(node) tells whether its names are hidden (in training)."""
    out = np.zeros((len(nodes), FEATURES), dtype=np.float32)
    total = max(1, nodes[0].chars)
    inherited: dict[int, tuple[float, float, float, float, float]] = {}
    for row, node in enumerate(nodes):
        names = () if hide is not None and hide(node) else (node.tag, *node.tokens)
        bad, good = sum(x in BAD for x in names), sum(x in GOOD for x in names[1:]) + (node.tag in ("article", "main") and bool(names))
        p = node.parent
        above = inherited.get(id(p), (0.0, 0.0, 0.0, 0.0, 0.0))
        article = 1.0 if node.tag in ("article", "main") and names else above[4]
        inherited[id(node)] = (above[0] + bad, above[1] + good, max(above[2], float(bool(bad))), above[3] + (node.tag == "a"), article)
        brothers = p.children if p is not None else ()
        chars = node.chars
        around = p if p is not None else node
        f = out[row]
        f[0:SHAPE] = (
            np.log1p(chars), chars / total, chars / node.tags, node.links / max(1, chars), node.marks / max(1, chars), node.words / max(1, node.tags), chars / max(1, node.words),
            np.log1p(node.tags), node.depth, node.at, node.at / max(1, len(brothers)), len(brothers), len(node.children), chars / max(1, around.chars),
            bad, good, above[0], above[1], above[2], above[3], len(node.tokens), around.links / max(1, around.chars),
            np.log1p(around.chars), around.marks / max(1, around.chars), around.chars / around.tags, article,
        )
        at = _TAG_AT.get(node.tag)
        if at is not None and names:
            f[SHAPE + at] = 1.0
    return out


# --- boosted trees ----------------------------------------------------------------------------------


class Boosted:
    """Logistic boosting of trees of fixed depth over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.25, least: float = 5.0):
        self.rounds, self.depth, self.bins, self.rate, self.least = rounds, depth, bins, rate, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        width = self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cutoff = np.zeros(2**self.depth - 1, np.int32), np.full(2**self.depth - 1, np.inf)
            at = np.zeros(len(y), np.int64)  # leaf within the level
            for level in range(self.depth):
                leaves = 2**level
                best, where, value = np.full(leaves, 1e-9), np.zeros(leaves, np.int32), np.full(leaves, width, np.int64)
                gt, ht = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    key = at * width + binned[:, f]
                    gl = np.cumsum(np.bincount(key, g, leaves * width).reshape(leaves, width), axis=1)
                    hl = np.cumsum(np.bincount(key, h, leaves * width).reshape(leaves, width), axis=1)
                    gr, hr = gt[:, None] - gl, ht[:, None] - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gt**2 / (ht + 1))[:, None]
                    gain[(hl < self.least) | (hr < self.least)] = 0
                    k = gain[:, : len(edges[f])].argmax(axis=1)
                    top = gain[np.arange(leaves), k]
                    better = top > best
                    best[better], where[better], value[better] = top[better], f, k[better]
                for leaf in range(leaves):
                    node = leaves - 1 + leaf
                    feature[node] = where[leaf]
                    cutoff[node] = edges[where[leaf]][value[leaf]] if value[leaf] < width else np.inf
                at = 2 * at + (binned[np.arange(len(y)), where[at]] > value[at])
            n = 2**self.depth
            leaf = -self.rate * np.bincount(at, g, n) / (np.bincount(at, h, n) + 1)
            self.trees.append((feature, cutoff.astype(np.float64), leaf))
            score += leaf[at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cutoff, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (x[rows, feature[node]] > cutoff[node])
            score += leaf[at]
        return 1 / (1 + np.exp(-score))


# --- decoding -----------------------------------------------------------------------------------------

_OUTSIDE, _CONTENT, _REJECTED = 0, 1, 2


def decode(nodes: list[Node], p: np.ndarray) -> None:
    """Set label of each node to the cheapest consistent labelling, weighted by the text a node holds itself."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = -np.log(p), -np.log(1 - p)
    cost: dict[int, tuple[float, float, float]] = {}
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        o = c = r = 0.0
        for child in node.children:
            of = cost.get(id(child))
            if of is not None:
                o += min(of)
                c += min(of[_CONTENT], of[_REJECTED] + SWITCH)
                r += of[_REJECTED]
        cost[id(node)] = (o + float(no[i]), c + float(yes[i]), r + float(no[i]))
    for node in nodes:
        o, c, r = cost[id(node)]
        above = node.parent.label if node.parent is not None else _OUTSIDE
        if above == _REJECTED:
            node.label = _REJECTED
        elif above == _CONTENT:
            node.label = _CONTENT if c <= r + SWITCH else _REJECTED
        else:
            node.label = _CONTENT if c < o and c < r else _OUTSIDE if o <= r else _REJECTED


_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are never the article of a page, whatever else is on it.
_ASIDE = frozenset(("nav", "header", "footer", "aside", "form"))


def join_heads(nodes: list[Node]) -> None:
    """Headings outside of the content that stand right before content of the same parent belong to it."""
    for node in nodes:
        after = None
        for child in reversed(node.children):
            if child.tag in HIDDEN:
                continue
            if child.tag in _HEADS and child.label == _OUTSIDE and after is not None and after.label == _CONTENT:
                mark(child, _CONTENT)
            if child.chars:
                after = child


def mark(node: Node, label: int) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        x.label = label
        stack.extend(x.children)


#: Elements that may hold the article as one part of a page.
_BOXES = frozenset(("article", "main", "section", "div", "table"))


def take_bare(nodes: list[Node]) -> None:
    """A page without a box around its article, or of which nothing was found to be content, is one itself, but for parts named otherwise."""
    for node in nodes:
        above = node.parent.label if node.parent is not None else _CONTENT
        named = node.tag in _ASIDE or any(x in BAD for x in node.tokens)
        node.label = _REJECTED if above == _REJECTED or named else _CONTENT


def main_text(root: Node) -> str:
    blocks: list[str] = []
    piece: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(piece)).split())
        if text:
            blocks.append(text)
        piece.clear()

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, tuple):  # text and whether it is content
            if item[1]:
                piece.append(item[0])
        elif item.tag == "br":
            piece.append(" ")
        elif item.tag not in HIDDEN:
            content = item.label == _CONTENT
            block = item.tag not in INLINE
            if block:
                end()
                stack.append(None)
            for x in reversed(item.items):
                stack.append((x, content) if isinstance(x, str) else x)
    end()
    return "\n".join(blocks)


# --- training -------------------------------------------------------------------------------------------


_SYLLABLES = "an er ou la de th ti on ge ver ein ra que es ca mo ist in al re".split()


def _made_page(rng: random.Random) -> tuple[str, str]:
    """A page with known main text; content paragraphs carry the mark \\x01 to label them."""

    def words(lo: int, hi: int) -> str:
        out = ["".join(rng.choices(_SYLLABLES, k=rng.randrange(1, 4))) for _ in range(rng.randrange(lo, hi))]
        return " ".join(w + ("," if rng.random() < 0.08 else "") for w in out).capitalize() + "."

    def pick(*options):
        return rng.choice(options)

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(rng.randrange(lo, hi)))

    def boiler(kinds: int = 12) -> str:
        kind = rng.randrange(kinds)
        if kind == 0:
            return f"<nav>{pick('<ul>', '<ul class=menu>')}{links(2, 10)}</ul></nav>"
        if kind == 1:
            return f'<div class="{pick("ad", "ads", "advert", "sponsored", "promo-box", "banner")}">{words(3, 25)}</div>'
        if kind == 2:
            return f"<footer>&copy; {words(2, 15)}</footer>"
        if kind == 3:
            return f"<header><{pick('h1', 'div', 'p')}>{words(1, 6)}</{'div'}></header>"
        if kind == 4:
            return f'<aside class="sidebar"><h3>{words(1, 4)}</h3><ul>{links(2, 8)}</ul><p>{words(5, 30)}</p></aside>'
        if kind == 5:
            return f'<div class="{pick("cookie-notice", "notice", "consent", "alert")}"><p>{words(6, 30)}</p><button>OK</button></div>'
        if kind == 6:
            return f'<form action="/s"><label>{words(1, 5)}</label><input name=q><p>{words(3, 12)}</p></form>'
        if kind == 7:
            return f'<section class="comments"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(4, 40)}</p></div>' for _ in range(rng.randrange(1, 6))) + "</section>"
        if kind == 8:
            return f'<div class="{pick("share", "social", "related", "newsletter")}"><p>{words(2, 15)}</p><ul>{links(1, 6)}</ul></div>'
        if kind == 9:
            return f'<div id="{pick("menu", "navigation", "breadcrumbs", "footer", "header", "sidebar")}">{links(2, 8)}<p>{words(2, 14)}</p></div>'
        if kind == 10:
            return f"<div><ul>{links(3, 9)}</ul></div>"
        return f"<div><p>{words(2, 8)}</p><a href=/x>{words(1, 4)}</a></div>"

    def short() -> str:
        """Small pieces that belong to an article all the same."""
        cells = "".join(f"<tr><th>\x01{words(1, 3)}</th><td>\x01{words(1, 4)}</td></tr>" for _ in range(rng.randrange(1, 5)))
        return pick(f"<p>\x01{words(1, 3)}</p>", f"<h3>\x01{words(1, 3)}</h3>", f"<figure><img src=x><figcaption>\x01{words(1, 8)}</figcaption></figure>", f"<table>{cells}</table>", f"<dl><dt>\x01{words(1, 3)}</dt><dd>\x01{words(1, 9)}</dd></dl>", f"<p><em>\x01{words(1, 3)}</em></p>")

    tiny, bare = rng.random() < 0.2, rng.random() < 0.2
    inner = [f"<h1>\x01{words(3, 12)}</h1>"] if rng.random() < (0.3 if tiny else 0.8) else []
    for _ in range(rng.randrange(1, 3) if tiny else rng.randrange(1, 12)):
        if tiny:
            inner.append(short() if rng.random() < 0.7 else f"<p>\x01{words(2, 12)}</p>")
            continue
        body = f"\x01{words(1, 90) if rng.random() < 0.7 else words(1, 4)}"
        if rng.random() < 0.2:
            body += f' <a href="/l">\x01{words(1, 5)}</a> \x01{words(1, 20)}'
        inner.append(pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p><b>{body}<br><p>\x01{words(3, 30)}</p>", f"<h2>\x01{words(1, 6)}</h2><p>{body}</p>", f"<ul><li>\x01{words(2, 20)}</li><li>\x01{words(2, 20)}</li></ul>", f"<blockquote>{body}</blockquote>", f"<pre>\x01{words(1, 4)}\n{words(1, 6)}</pre>", f"<p>\x01{words(1, 3)}<br>\x01{words(1, 3)}</p>", f"<div>\x01{words(1, 30)}</div>", short()))
        if rng.random() < 0.12:
            inner.append(boiler(10))  # without a name of its own it would be part of the article
    box = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="story">', "</div>"), ('<section class="post-body">', "</section>"), ("<div>", "</div>"), ("<main><article>", "</article></main>"))
    if tiny:
        box = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"))
    most = 1 if bare else 4
    page = "".join([boiler() for _ in range(rng.randrange(0, most))] + [box[0] + "".join(inner) + box[1]] + [boiler() for _ in range(rng.randrange(0, most))])
    if rng.random() < 0.3:
        page = f'<div class="{pick("page", "wrapper", "container", "")}">{page}</div>'
    if bare and rng.random() < 0.5:
        return page
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>"


def _marked_labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes all of whose text carries the mark."""
    good, every = {}, {}
    for node in reversed(nodes):
        own = [x for x in node.items if isinstance(x, str) and x.strip()]
        good[id(node)] = sum(x.lstrip().startswith("\x01") for x in own) + sum(good.get(id(c), 0) for c in node.children)
        every[id(node)] = len(own) + sum(every.get(id(c), 0) for c in node.children)
    # An article with a few boilerplate pieces inside is content still.
    return np.array([float(every[id(x)] > 0 and good[id(x)] >= 0.7 * every[id(x)] and x.tag not in ("html", "body", "#root")) for x in nodes])


def _own_labels(nodes: list[Node]) -> np.ndarray | None:
    """Labels by the page's own article or main element, where there is one."""
    inside: dict[int, int] = {}
    found = False
    out = np.zeros(len(nodes))
    for i, node in enumerate(nodes):
        above = inside.get(id(node.parent), 0) if node.parent is not None else 0
        names = (node.tag, *node.tokens)
        state = 2 if above == 2 or any(x in BAD for x in names) else 1 if above == 1 or node.tag in ("article", "main") else 0
        inside[id(node)] = state
        found |= state == 1
        out[i] = float(state == 1 and node.chars > 0)
    return out if found else None


def train(pages: list[str], made: int = MADE_PAGES, seed: int = 11) -> Boosted:
    rng = random.Random(seed)
    xs, ys = [], []
    for i in range(made + len(pages)):
        nodes = measure(parse(_made_page(rng) if i < made else pages[i - made]))
        labels = _marked_labels(nodes) if i < made else _own_labels(nodes)
        if labels is None:
            continue
        blind = rng.random() < 0.35
        xs.append(describe(nodes, (lambda node: node.tag not in ("a", "p", "li", "ul") and rng.random() < 0.8) if blind else None))
        ys.append(labels)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str], model: Boosted) -> list[str]:
    """The main text of each page."""
    roots = [parse(p) for p in pages]
    nodes = [measure(r) for r in roots]
    if not nodes:
        return []
    p = model.predict(np.concatenate([describe(n) for n in nodes]))
    at, out = 0, []
    for root, own in zip(roots, nodes, strict=True):
        decode(own, p[at : at + len(own)])
        join_heads(own)
        at += len(own)
        text = main_text(root) if any(x.tag in _BOXES and x.chars for x in own) else ""
        if not text and root.chars:
            take_bare(own)
            text = main_text(root)
        out.append(text)
    return out


def extract_main_text(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    spark = pages.sparkSession
    source = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    chosen = cut(source.where("page_id IS NOT NULL").where(F.length("html") <= MAX_CHARS).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages), "page-sample").distinct()
    sample = source.where(F.length("html") <= MAX_CHARS).join(F.broadcast(chosen), "page_id", "left_semi").orderBy("page_id", "html").limit(max_pages)
    model = spark.sparkContext.broadcast(train([r["html"] for r in sample.select("html").collect()]))  # at most max_pages pages of MAX_CHARS characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = extract(part.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return source.mapInArrow(run, schema)
