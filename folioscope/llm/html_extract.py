"""Main text of web pages by boosted trees over DOM nodes, decoded along the tree.

A page is read into block nodes (inline elements belong to the block around
them).  Gradient-boosted trees give each node a probability of being, or
holding, main text from its tag, attribute tokens, depth, subtree densities and
siblings.  The labelling of all nodes that is most likely as a whole, and in
which nothing inside a rejected node is accepted, is found exactly by dynamic
programming; so an ancestor and a descendant never contradict each other.

The trees are fitted on a bounded sample of pages whose markup names its parts
(article, nav, footer and so on: weak labels), and on a few labelled examples.

Defined results: null and empty html give the empty text; unclosed, stray and
cut-off tags are tolerated; scripts, styles, comments and the head never count;
text directly in the body, or in a page without markup, is a block of its own
between the elements around it and judged like any other; repeated rows get the
same text each.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, bounded_batches, give_back, hash_sample

#: Expected bound of the pages that the trees are fitted on, and of their nodes.
TRAIN_PAGES, TRAIN_NODES = 400, 40_000
TREES, DEPTH, RATE, BINS, RIDGE = 40, 4, 0.3, 24, 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of the head; any other tag, or text, ends it where ``</head>`` is left out.
HEAD = frozenset("html head title meta link base style script noscript template".split())
RAW = frozenset("script style noscript template iframe svg textarea select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Open elements that a start tag of the same family ends.
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KINDS = ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "figure", "blockquote", "pre", "body")
def _words(*stems: str) -> re.Pattern:
    """Any of the words as a whole part of a name: ``nav`` in ``top-nav`` and ``nav_2``, not in ``navy``."""
    return re.compile(rf"(?<![a-z])(?:{'|'.join(stems)})s?(?![a-z])")


#: Parts of names, in the languages of the pages, that speak against main text and for it.
AGAINST = _words(
    "nav", "navbar", "navi", "navigation", "topnav", "menu", "header", "footer", "sidebar", "side", "aside", "ad", "advert", "adverti[sz]ement", "adverti[sz]ing", "promo", "promotion", "sponsor(?:ed)?", "banner", "cookie", "consent", "notice", "alert", "popup", "modal", "dialog", "comment", "disqus", "repl(?:y|ies)", "share", "sharing", "social", "related", "recommend(?:ed|ation)?", "breadcrumb", "login", "signup", "subscri(?:be|ption)", "newsletter", "widget", "toolbar", "pagination", "pager", "copyright", "legal", "masthead", "search", "form",
    "fusszeile", "kopfzeile", "werbung", "anzeige", "kommentar", "kommentare", "hinweis", "pied", "publicite", "commentaire", "pie", "publicidad", "anuncio", "comentario", "barra",
)
IN_FAVOUR = _words("article", "content", "main", "post", "entry", "story", "body", "text", "prose", "artikel", "inhalt", "beitrag", "contenu", "contenido", "articulo")
#: Quotes delimit a value directly after an equals sign only.
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
NAMING = frozenset(("class", "id", "role"))
SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Block nodes of a page in document order; node 0 is the root."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    tokens: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    inline: list[int] = field(default_factory=lambda: [0])
    #: Text runs: the node they stand in, and the run; a block's text is its runs joined.
    runs: list[tuple[int, str]] = field(default_factory=list)


#: Text directly in these stands in a block of its own, between the elements around it.
LOOSE = frozenset(("#root", "html", "body"))


def attribute_tokens(text: str) -> str:
    """Values of the attributes that name an element, in lower case."""
    return " ".join(a or b or c for name, a, b, c in ATTRIBUTE.findall(text) if name.lower() in NAMING).lower()


def read_page(html: str) -> Page:
    page, stack, inline, at, links, head = Page(), [0], [], 0, 0, False
    tags, end = page.tag, len(html)
    opened: dict[str, int] = {}
    # place of the open paragraph in the stack (there is one at most), and the open block of loose text
    paragraph = loose = 0

    def add(name: str, tokens: str) -> int:
        page.parent.append(stack[-1])
        page.depth.append(len(stack))
        page.end.append(len(tags) + 1)
        page.linked.append(0)
        page.inline.append(0)
        page.tokens.append(tokens)
        tags.append(name)
        return len(tags) - 1

    def place() -> int:
        """The node that text stands in."""
        return loose if loose and tags[stack[-1]] in LOOSE else stack[-1]

    def text(a: int, b: int) -> None:
        nonlocal loose
        nonlocal head
        if a < b and head:
            head = not html[a:b].strip()
        if a < b and not head:
            run = entities.unescape(html[a:b])
            blank_run = not run.strip()
            if tags[stack[-1]] in LOOSE and not loose:
                if blank_run:
                    return
                loose = add("p", "")
            page.runs.append((place(), run))
            if links:
                page.linked[place()] += len(run.strip())

    def close(depth: int) -> None:
        nonlocal links, paragraph, loose
        while len(stack) > depth:
            k = stack.pop()
            page.end[k] = len(tags)
            opened[tags[k]] = opened.get(tags[k], 1) - 1
        if paragraph >= depth:
            paragraph = 0
        inline.clear()
        links = loose = 0

    while at < end:
        found = TAG.search(html, at)
        if not found:
            text(at, end)
            break
        text(at, found.start())
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "head":
                head = False
            elif name in INLINE:
                if name in inline:
                    inline.reverse()
                    inline.remove(name)
                    inline.reverse()
                    links -= name == "a"
            elif opened.get(name, 0) > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        close(k)
                        break
            continue
        head = head and name in HEAD
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name == "hr":
                loose = 0
            if name in ("br", "hr") and tags[place()] not in LOOSE:
                page.runs.append((place(), " "))
            continue
        if name in INLINE:
            inline.append(name)
            links += name == "a"
            page.inline[place()] += 1
            continue
        if name == "head":
            head = True
            continue
        if name == "body":
            head = False
        if name in ENDS_P and paragraph:
            close(paragraph)
        for same in ENDS_SAME.get(name, ()):
            if tags[stack[-1]] == same:
                close(len(stack) - 1)
        if name == "p":
            paragraph = len(stack)
        stack.append(add(name, attribute_tokens(found[3]) if found[3] else ""))
        opened[name] = opened.get(name, 0) + 1
        inline.clear()
        links = loose = 0
    close(0)
    return page


@functools.lru_cache(65536)
def _marks(tag: str, tokens: str) -> tuple[bool, bool, bool, bool]:
    return bool(AGAINST.search(tag)), bool(AGAINST.search(tokens)), bool(IN_FAVOUR.search(tag)), bool(IN_FAVOUR.search(tokens))


FEATURES = (*(f"tag={x}" for x in KINDS), "against_tag", "against_tokens", "for_tag", "for_tokens", "under_against", "under_for", "depth", "chars", "own_chars", "link_share", "node_density", "inline", "stops", "commas", "children", "place", "siblings", "like_siblings", "sibling_chars", "page_share")


def node_features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent, end, depth = np.array(page.parent), np.array(page.end), np.array(page.depth)
    own, stops, commas = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, run in page.runs:
        own[k] += len(run.strip())
        stops[k] += run.count(".") + run.count("!") + run.count("?")
        commas[k] += run.count(",")

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[end] - total[: len(x)]

    marks = np.array([_marks(t, k) for t, k in zip(page.tag, page.tokens)], float)
    under = np.zeros((n, 2))
    for k in range(1, n):
        p = page.parent[k]
        under[k, 0] = under[p, 0] + (marks[p, 0] or marks[p, 1])
        under[k, 1] = under[p, 1] + (marks[p, 2] or marks[p, 3])
    chars, linked, size = below(own), below(np.array(page.linked, float)), end - np.arange(n)
    up = np.maximum(parent, 0)
    kids = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
    first = np.zeros(n)
    seen: dict[int, int] = {}
    for k in range(1, n):
        first[k] = seen[page.parent[k]] = seen.get(page.parent[k], -1) + 1
    number = {t: i for i, t in enumerate(dict.fromkeys(page.tag))}
    family = up * len(number) + np.array([number[t] for t in page.tag])
    _, of, like = np.unique(family, return_inverse=True, return_counts=True)
    chars_of_kids = np.bincount(up[1:], chars[1:], n) if n > 1 else np.zeros(n)
    kind = np.array([KINDS.index(t) if t in KINDS else -1 for t in page.tag])
    out = np.zeros((n, len(FEATURES)))
    out[kind >= 0, kind[kind >= 0]] = 1
    rest = (*marks.T, *np.minimum(under, 3).T, depth, np.log1p(chars), np.log1p(own), linked / np.maximum(chars, 1), size / np.maximum(chars, 1), page.inline, np.log1p(below(stops)), np.log1p(below(commas)), kids, first / np.maximum(kids[up], 1), kids[up], like[of], np.log1p(chars_of_kids[up] / np.maximum(kids[up], 1)), chars / max(chars[0], 1))
    out[:, len(KINDS) :] = np.stack([np.asarray(x, float) for x in rest], axis=1)
    return out


@dataclass
class Trees:
    """Boosted trees of equal depth: split features and thresholds by level order, leaf values, and a start."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic gradient boosting over binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    z, inner = np.full(len(y), start), 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        node, f, t = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 0.0
            if len(rows):
                whole = g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
                for c, e in enumerate(edges):
                    gs = np.cumsum(np.bincount(binned[rows, c], g[rows], len(e) + 1))
                    hs = np.cumsum(np.bincount(binned[rows, c], h[rows], len(e) + 1))
                    gain = gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE) - whole
                    if len(gain) and gain.max() > best + 1e-9:
                        best, f[k], t[k] = gain.max(), c, e[int(np.argmax(gain))]
            node[rows] = 2 * k + 1 + (x[rows, f[k]] > t[k])
        at = node - inner
        leaf = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        z += leaf[at]
        features.append(f)
        thresholds.append(t)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


#: Parts that markup names: what is inside is, or isn't, main text.
NAMED_MAIN, NAMED_OTHER = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))
OTHER_TOKENS = _words("ad", "advert\\w*", "sidebar", "comment", "cookie", "newsletter", "related", "share", "social", "menu", "footer", "header", "navbar", "promo\\w*", "banner", "notice")


def weak_labels(page: Page) -> np.ndarray:
    """1, 0, or -1 for unknown, of each node: main text or what holds it, something else, or no named part near."""
    label = np.full(len(page.tag), -1)
    for k in range(1, len(page.tag)):
        above, tag = label[page.parent[k]], page.tag[k]
        other = tag in NAMED_OTHER or bool(OTHER_TOKENS.search(page.tokens[k]))
        if above == 0 or other:
            label[k] = 0
        elif above == 1 or tag in NAMED_MAIN:
            label[k] = 1
    if not (label == 1).any():
        return np.full(len(label), -1)
    for k in range(len(label) - 1, 0, -1):
        if label[k] == 1 and label[page.parent[k]] == -1:
            label[page.parent[k]] = 1
    return label


def _example(main: str, *others: str) -> tuple[str, str]:
    return main, "".join(others)


_LINES = "Some words of a story, told at length. It has sentences, with commas, and it ends. "
_LINKS = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(6))
#: Labelled examples: main markup, and what stands around it.
EXAMPLES = tuple(
    (f'<div class="{wrap}"><h1>A title of some words</h1>' + "".join(f"<p>{_LINES * n}</p>" for n in (1, 3, 2)) + f'<h2>Part</h2><p>{_LINES}</p><ul><li>One point</li><li>Two points</li></ul></div>', other)
    for wrap in ("content", "post-body", "entry", "story text", "c1")
    for other in (
        f'<ul class="menu">{_LINKS}</ul>',
        f'<div class="sidebar"><h3>More</h3><ul>{_LINKS}</ul></div>',
        f'<div id="comments"><div class="comment"><p>{_LINES}</p></div><div class="comment"><p>I say so too.</p></div></div>',
        '<div class="cookie-notice"><p>We use cookies. By going on you agree.</p><button>Accept</button></div>',
        f'<div class="ad">{_LINES}</div>',
        '<div class="footer"><p>All rights reserved.</p><a href="/a">About</a> <a href="/b">Terms</a></div>',
        '<form><p>Your address</p><input><button>Subscribe</button></form>',
        f'<div class="related"><h3>Related</h3><ul>{_LINKS}</ul></div>',
        f'<section id="comments"><h3>Comments</h3><div class="comment"><p>{_LINES * 2}</p></div><div class="comment"><p>Well said, I agree!</p></div></section>',
        f'<aside class="sidebar"><h3>Related</h3><p>{_LINES}</p><ul>{_LINKS}</ul></aside>',
        f'<aside><p>{_LINES}</p></aside>',
        f'<header><h2>Site name</h2><p>A tag line of it.</p><ul>{_LINKS}</ul></header>',
        '<footer><p>Copyright of the site. All rights reserved.</p></footer>',
        f'<div class="share-buttons"><ul>{_LINKS}</ul></div>',
        f'<div class="advert"><p>{_LINES}</p></div>',
        f'<div class="newsletter"><p>{_LINES}</p><form><p>Your address</p></form></div>',
    )
)


#: Text that stands directly in the body, and a page that is text alone.
BARE = (f"<h1>A title of some words</h1>{_LINES * 3}<br><br>{_LINES * 2}<br>{_LINES}", f"{_LINES * 4}<br>{_LINES}", f"<h1>A title</h1>{_LINES * 2}<p>{_LINES * 2}</p>{_LINES}<ul><li>One point</li></ul>{_LINES * 2}")
ALONE = ("Some words of a page.", "plain words", _LINES, _LINES * 5, f"{_LINES}<br><br>{_LINES * 2}", f"<b>A title</b><br>{_LINES}", f"<p>{_LINES}</p>", "<p>A few words</p>", f"<div>{_LINES}</div><div>{_LINES * 2}</div>", f"<center>{_LINES * 2}</center>")
#: Names that say nothing, so structure alone has to tell.
SILENT = ("a1", "row", "box-2", "performance", "col left", "")


def labelled_examples() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of pages made of each example: its other part before, after, beside and inside the main one."""
    xs, ys = [], []
    for main, other in EXAMPLES:
        head = read_page(other)
        inner = main.removesuffix("</div>")
        for body in (f"{main}{other}", f"{other}{main}", f"<main>{main}{other}</main>", f"<main><article>{main}</article>{other}</main>", f"<article>{inner[inner.index('>') + 1 :]}{other}</article>", f"<div>{other}{main}</div>", f"{inner}{other}</div>"):
            page = read_page(f"<html><body>{body}</body></html>")
            at = next(k for k in range(1, len(page.tag)) if (page.tag[k], page.tokens[k]) == (head.tag[1], head.tokens[1]) and page.end[k] - k == head.end[1] - 1)
            label = np.ones(len(page.tag), int)
            label[at : page.end[at]] = 0
            xs.append(node_features(page))
            ys.append(label)
    for bare in BARE:
        for _, other in EXAMPLES[:16]:
            head = read_page(other)
            for body in (f"{bare}{other}", f"{other}{bare}"):
                page = read_page(f"<html><body>{body}</body></html>")
                at = next(k for k in range(1, len(page.tag)) if (page.tag[k], page.tokens[k]) == (head.tag[1], head.tokens[1]) and page.end[k] - k == head.end[1] - 1)
                label = np.ones(len(page.tag), int)
                label[at : page.end[at]] = 0
                xs.append(node_features(page))
                ys.append(label)
    for alone in ALONE:
        for body in (alone, f"<html><body>{alone}</body></html>", f'<html><body><div class="page">{alone}</div></body></html>'):
            page = read_page(body)
            for _ in range(4):
                xs.append(node_features(page))
                ys.append(np.ones(len(page.tag), int))
    for name in SILENT:
        page = read_page(f'<html><body><article><h1>A title</h1><p class="{name}">{_LINES * 2}</p><div class="{name}"><p>{_LINES}</p></div></article><nav><ul>{_LINKS}</ul></nav></body></html>')
        label = np.ones(len(page.tag), int)
        label[page.tag.index("nav") :] = 0
        xs.append(node_features(page))
        ys.append(label)
    return np.concatenate(xs), np.concatenate(ys)


def train(pages: DataFrame, html: str = "html") -> Trees:
    """Fit the trees; at most about ``TRAIN_NODES`` feature rows of a bounded sample of pages come to the driver."""
    bounded_batches(pages.sparkSession)
    whole = pages.select("page_id", blank(html).alias("h"))
    sample = hash_sample(whole, ("page_id", "h"), TRAIN_PAGES, pages.count()).select("h")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["h"]:
                page = read_page(text)
                label = weak_labels(page)
                if (label >= 0).any():
                    x = node_features(page)[label >= 0]
                    keep = np.linspace(0, len(x) - 1, min(len(x), TRAIN_NODES // TRAIN_PAGES)).astype(int)
                    out += [{"x": a.tolist(), "y": int(b)} for a, b in zip(x[keep], label[label >= 0][keep])]
            if out:
                yield pd.DataFrame(out, columns=["x", "y"])

    got = sample.mapInPandas(rows, "x array<double>, y int").toArrow().to_pandas()
    x, y = labelled_examples()
    weight = np.full(len(y), 1.0)
    if len(got):
        # pages as a whole count twice as much as the examples
        x, y = np.concatenate((x, np.stack(got["x"].to_list()))), np.concatenate((y, got["y"].to_numpy()))
        weight = np.concatenate((weight, np.full(len(got), 2 * len(weight) / len(got))))
    return boost(x, y.astype(float), weight)


def decode(page: Page, p: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which every accepted node's ancestors are accepted too.  The root and body always are."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    accept, reject = yes.tolist(), no.tolist()
    for k in range(len(p) - 1, 0, -1):
        up = page.parent[k]
        accept[up] += max(accept[k], reject[k])
        reject[up] += reject[k]
    out = np.zeros(len(p), bool)
    out[0] = True
    for k in range(1, len(p)):
        out[k] = out[page.parent[k]] and (accept[k] > reject[k] or page.tag[k] in ("html", "body"))
    return out


def main_text(page: Page, accepted: np.ndarray) -> str:
    """The accepted blocks' texts in page order, white space made single, one line each."""
    blocks, previous = [], -1
    for node, run in page.runs:
        if accepted[node]:
            if node != previous:
                blocks.append([])
            blocks[-1].append(run)
        if run.strip() or node == previous:
            previous = node
    lines = (SPACE.sub(" ", "".join(x)).strip() for x in blocks)
    return "\n".join(x for x in lines if x)


def extract_text(html: str, trees: Trees) -> str:
    if not html:
        return ""
    page = read_page(html)
    return main_text(page, decode(page, trees.probability(node_features(page))))


def extract(pages: DataFrame, trees: Trees, html: str = "html", into: str = "main_text") -> DataFrame:
    """Add text column ``into``, in place of one of that name.  The trees' size is fixed (some kB), so they are broadcast."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for part in range(0, len(texts), 64):
                read = [read_page(t) for t in texts.iloc[part : part + 64]]
                p = shared.value.probability(np.concatenate([node_features(x) for x in read]))
                at = 0
                for page in read:
                    out.append(main_text(page, decode(page, p[at : at + len(page.tag)])))
                    at += len(page.tag)
            yield pd.Series(out)
        give_back()

    return pages.withColumn(into, run(blank(html)))
