"""HTML main text: gradient-boosted trees over DOM nodes, decoded from the root down.

A tolerant parser builds the tree of block elements; text that stands
directly in a block, between its child blocks, is a node of its own. Inline
markup belongs to the text around it. Each node has features: its subtree's
text and its density in tags and links, its share of the page, hashed attribute
tokens (class, id, role) of itself and its ancestors, tag, depth, and how it
compares with its siblings. Trees trained on generated pages of many layouts
give each node the log-odds that it holds main text.

Decoding is hierarchical: of all choices in which a node is kept only if its
parent is, the one with the greatest sum of log-odds is taken, by one pass up
and one down the tree. No kept node can thus stand in a dropped one.

The names on the training pages join words of articles or of noise to words for
places, and noise words stand on some articles too, so that no word decides
about a subtree against its text.

Scripts, styles, forms' controls, comments of the markup and the like never
count as text. Null and empty pages, and pages without main text, give "".
Repeated rows and ids have a row each. Pages of any length are read whole, a
very long one by itself, so memory follows the longest page. A node whose
log-odds are 0 is dropped. An empty table gives an empty result; further
columns are not kept.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
OPEN = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that end the block before them; all others, unknown ones too, belong to the text around them.
BLOCKS = frozenset("html body div section article main nav header footer aside form ul ol menu dir li p h1 h2 h3 h4 h5 h6 hgroup blockquote pre table caption colgroup thead tbody tfoot tr td th figure figcaption dl dd dt address details summary dialog fieldset legend hr center search option optgroup noscript frameset noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; they part no block.
RAW = frozenset("script style template textarea title iframe svg select button annotation annotation-xml canvas audio video head datalist".split())
#: Those of them that run to the page's end if they are not closed; of the others only the tag goes.
TO_END = frozenset("script style textarea title".split())
#: Those that hold none of their own kind: another one that opens shows that the first is not closed.
FLAT = frozenset("iframe select button annotation canvas audio video datalist".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
BARRIER = frozenset("table ul ol dl div article section main body nav aside header footer form blockquote".split())
TAGS = "#text html body div section article main nav header footer aside form ul ol li p h1 h2 h3 h4 blockquote pre table tr td figure figcaption dl dd dt address details fieldset".split()
#: Tags of which one column says that any is there.
ASIDE_TAGS = "nav header footer aside form fieldset address".split()
#: Added to each node's log-odds: to lose a piece of main text counts as much as to keep five of noise.
LEAN = 1.6
#: Places that the words of class, id and role are hashed to.
WORD_PLACES = 4096


class Node:
    __slots__ = ("attrs", "children", "link", "parent", "parts", "tag")

    def __init__(self, tag, parent, attrs=()):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.link = 0
        if parent is not None:
            parent.children.append(self)


@functools.lru_cache(maxsize=1 << 16)
def _words(attrs: str) -> tuple[int, ...]:
    """Places of the words of class, id and role."""
    if "=" not in attrs:
        return ()
    words = {w.lower() for m in ATTRIBUTE.finditer(attrs) for w in WORD.findall(m[2] or m[3] or m[4] or "")}
    return tuple(sorted({zlib.crc32(w.encode("utf-8", "replace")) % WORD_PLACES for w in words}))


def parse(page: str) -> Node:
    """Tree of blocks; leaves are text nodes whose text is decoded, with single spaces."""
    root = Node("html", None)
    at, run, in_link, linked = root, [], False, 0

    def flush():
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                leaf = Node("#text", at)
                leaf.parts, leaf.link = [text], min(linked, len(text))
            run, linked = [], 0

    pos, n, unclosed = 0, len(page), set()
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            piece = html.unescape(page[pos:lt])  # each run by itself: no reference stands across markup
            run.append(piece)
            if in_link:
                linked += len(piece.strip())
            pos = lt
            if pos == n:
                break
        m = TOKEN.match(page, pos) or LOOSE.match(page, pos)
        if not m:
            if page.startswith(("<!", "<?"), pos) or OPEN.match(page, pos):
                break  # a tag that never ends
            if page.startswith("</", pos) and pos + 2 < n:  # no name: a comment to the next ">"
                end = page.find(">", pos + 2)
                pos = end + 1 if end >= 0 else n
                continue
            run.append("<")
            pos += 1
            continue
        pos = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m[1]
        if name == "br":
            run.append(" ")
            continue
        if name in RAW:
            if m[1] or name in unclosed or (m[3].endswith("/") and name == "svg"):
                continue
            end = re.compile(rf"<{'/?' if name in FLAT else '/'}{re.escape(name)}(?=[\s/>])[^>]*>?" if name != "head" else r"</head\s*>|(?=<body\b)", re.I).search(page, pos)
            if end and (name not in FLAT or end[0].startswith("</")):
                pos = end.end()
            elif name in TO_END:
                pos = n
            elif not end:
                unclosed.add(name)
            continue
        if name not in BLOCKS or (name == "noscript" and at.tag == "p"):
            continue
        if m[1]:
            up = at
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None or name == "p":  # one that ends nothing does not part the text
                flush()
                in_link = False
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        flush()
        if name in VOID:
            continue
        if name in ("html", "body") and any(x.tag == name for x in _line(at)):
            continue
        if at.tag == "p":
            at = at.parent
        elif name in CLOSED_BY:
            up = at
            while up.parent is not None and up.tag not in BARRIER:
                if up.tag in CLOSED_BY[name]:
                    at = up.parent
                up = up.parent
        else:
            up = at
            while up.parent is not None and up.tag not in BARRIER and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                at = up.parent
        at = Node(name, at, _words(m[3]))
    flush()
    return root


def _line(node):
    while node is not None:
        yield node
        node = node.parent


@dataclass
class Words:
    """Of each place of attribute words the log-odds of main text, and its own column or -1."""

    odds: np.ndarray
    column: np.ndarray


NUMERIC = 21
#: Log-odds of a node's attribute words that flags ask for: the least is below, the greatest above.
BELOW, ABOVE = (-1.5, -2.5), (0.5, 1.5)
#: Places of words that have a column of their own: the most frequent ones of the training pages.
OWN_WORDS = 96
N_FLAGS = len(TAGS) + 1 + len(BELOW) + len(ABOVE) + OWN_WORDS
TAG_AT = {t: i for i, t in enumerate(TAGS)}


def features(roots: list[Node], words: Words) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
    """(nodes of all trees in page order, place of each one's parent or -1, depth, feature rows)."""
    nodes, parents, depths = [], [], []
    for root in roots:
        stack = [(root, -1, 0)]
        while stack:
            node, up, d = stack.pop()
            me = len(nodes)
            nodes.append(node)
            parents.append(up)
            depths.append(d)
            if node.children:
                d += 1
                stack.extend([(c, me, d) for c in reversed(node.children)])
    n = len(nodes)
    text, link, stops, tags = [0] * n, [0] * n, [0] * n, [TAG_AT.get(x.tag, len(TAGS)) for x in nodes]
    own = np.zeros((n, N_FLAGS), np.float32)
    said = np.zeros((n, 2))  # the least and the greatest of a node's words
    for i, x in enumerate(nodes):
        if x.parts:
            t = x.parts[0]
            text[i], link[i] = len(t), x.link
            stops[i] = t.count(". ") + t.count(", ") + (t[-1] in ".!?")
        elif x.attrs:
            places = list(x.attrs)
            odds = words.odds[places]
            columns = words.column[places]
            own[i, len(TAGS) + 1 + len(BELOW) + len(ABOVE) + columns[columns >= 0]] = 1
            said[i] = min(odds.min(), 0), max(odds.max(), 0)
    parent, depth, tag = np.array(parents), np.array(depths), np.array(tags)
    text = np.array(text, np.float64)
    leaf = (tag == TAG_AT["#text"]).astype(np.float64)
    first = parent < 0
    page = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    before = np.cumsum(text) - text
    before -= before[start][page]
    longest = text.copy()
    sums = np.stack([text, np.array(link, np.float64), np.array(stops, np.float64), leaf, 1 - leaf, (tag == TAG_AT["p"]).astype(np.float64)], axis=1)
    by_depth = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=0) + 2))
    levels = [by_depth[a:b] for a, b in zip(edges[1:-1], edges[2:], strict=True)]  # without the roots
    for own_level in reversed(levels):
        np.add.at(sums, parent[own_level], sums[own_level])
        np.maximum.at(longest, parent[own_level], longest[own_level])
    text, link, stops, leaves, n_tags, paras = sums.T
    known = np.flatnonzero(tag < len(TAGS))
    own[known, tag[known]] = 1
    own[:, len(TAGS)] = own[:, [TAG_AT[t] for t in ASIDE_TAGS]].max(axis=1)
    own[:, len(TAGS) + 1 : N_FLAGS - OWN_WORDS] = np.stack([*(said[:, 0] < x for x in BELOW), *(said[:, 1] > x for x in ABOVE)], axis=1)
    above = np.zeros_like(own)
    for own_level in levels:
        above[own_level] = np.maximum(above[parent[own_level]], own[parent[own_level]])
    up = np.where(first, np.arange(n), parent)
    total = np.maximum(text[start], 1)[page]
    order = np.argsort(up, kind="stable")
    place = np.empty(n)
    place[order] = np.arange(n) - np.searchsorted(up[order], up[order])
    k = np.maximum(np.bincount(up, minlength=n)[up], 1)
    pair = up * (len(TAGS) + 1) + tag
    ordered = np.sort(pair)
    like = np.searchsorted(ordered, pair, "right") - np.searchsorted(ordered, pair, "left")
    log = np.log1p
    numeric = [
        log(text), link / np.maximum(text, 1), log(text / (n_tags + 1)), text / total, log(leaves), log(longest), stops / np.maximum(text, 1) * 100, log(paras),
        depth, before / total, text / np.maximum(text[up], 1), log(text / np.maximum(leaves, 1)), log(text[up]), link[up] / np.maximum(text[up], 1), log(paras[up]), log(stops),
        log(k), place / k, like / k, log(text[up] / k), log(text) - log(text[up] / k),
    ]
    return nodes, parent, depth, np.concatenate([np.stack(numeric, axis=1).astype(np.float32), own, above], axis=1)


def choose(parent: np.ndarray, depth: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the greatest sum of log-odds such that a kept node's parent is kept. Roots are always kept."""
    worth = odds.astype(np.float64).copy()
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(edges[1:-1], edges[2:], strict=True)]
    for level in reversed(levels):
        good = level[worth[level] > 0]
        np.add.at(worth, parent[good], worth[good])
    keep = parent < 0
    for level in levels:
        keep[level] = keep[parent[level]] & (worth[level] > 0)
    return keep


@dataclass
class Model:
    words: Words
    trees: trees.Boosted


def main_text(page: str | None, model: Model) -> str:
    """Blocks of the main text of one page, joined by blank lines."""
    return main_texts([page], model)[0]


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page; pages are worked on in groups of about 4 MB, so that numpy sees many nodes at once."""
    out = [""] * len(pages)
    lo = 0
    while lo < len(pages):
        hi, size = lo, 0
        while hi < len(pages) and (hi == lo or size + len(pages[hi] or "") <= 4 << 20):
            size += len(pages[hi] or "")
            hi += 1
        nodes, parent, depth, x = features([parse(p or "") for p in pages[lo:hi]], model.words)
        keep = choose(parent, depth, model.trees.raw(x) + LEAN)
        page = np.cumsum(parent < 0) - 1
        found: list[list[str]] = [[] for _ in range(hi - lo)]
        for i in np.flatnonzero(keep).tolist():
            if nodes[i].parts:
                found[page[i]].append(nodes[i].parts[0])
        out[lo:hi] = ["\n\n".join(f) for f in found]
        lo = hi
    return out


# -- training pages ---------------------------------------------------------


def _sentence(r: random.Random, low: int, high: int) -> str:
    w = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for i in range(5, len(w) - 1, r.randint(5, 9)):
        w[i] += ","
    return " ".join(w).capitalize() + "."


def _paragraph(r: random.Random) -> str:
    """Prose of any length, with links or without, or text without sentences."""
    low, high = r.choice(((3, 18), (3, 18), (1, 3), (1, 1)))
    s = [_sentence(r, low, high) for _ in range(r.choice((1, 1, 1, 2, 3, 5, 8, 20)))]
    style = r.random()
    if style < 0.15:
        s = [x.replace(" ", r.choice(("&amp; ", "### ", "%%% ", "!! ", " | "))).rstrip(".") for x in s]
    elif style < 0.25:
        s = [x.replace(",", "").replace(".", "") for x in s]
    if r.random() < 0.15:
        s[0] = f'<a href="/x">{s[0][:12]}</a>' + s[0][12:]
    return " ".join(s)


#: Words that name a place in any part of a page, and so say nothing by themselves.
PLACES = "body main content text wrap wrapper inner outer area container block box section page site layout col column row grid panel zone region module holder primary left right top center full single default item list group card view".split()
#: Words of the article, and of each kind of noise. A name joins them to places, and to each other.
ARTICLE_WORDS = "article post entry story content text blog news hentry document doc prose markdown essay feature report read reading mw wiki guide chapter paper".split()
#: Noise words that articles bear too, as parts of a longer name.
SHARED_WORDS = "nav menu header footer banner sidebar widget side aside top bar notice related ad promo hero share social tags".split()


def _name(r: random.Random, words: list[str], places: float = 0.5) -> str:
    """A name as sites give them: a word or two, often with a place before or after."""
    parts = [r.choice(words)]
    if parts == [""]:
        return r.choice(PLACES) if r.random() < 0.3 else ""
    if r.random() < places:
        parts.insert(r.choice((0, 1, 1)), r.choice(PLACES))
    if r.random() < 0.15:
        parts.insert(0, r.choice(("site", "js", "x", "c", "is", "the", "my", "l", "o")))
    if r.random() < 0.1:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    return r.choice(("-", "-", "-", "_", "__", " ")).join(parts)


def _article_name(r: random.Random) -> str:
    """Of the element around the main text: its own words, places alone, nothing, a word unknown elsewhere, or noise words beside others."""
    kind = r.random()
    if kind < 0.35:
        return _name(r, ARTICLE_WORDS, 0.6)
    if kind < 0.55:
        return r.choice(PLACES) if r.random() < 0.6 else f"{r.choice(PLACES)}-{r.choice(PLACES)}"
    if kind < 0.62:
        return ""
    if kind < 0.72:
        return _sentence(r, 1, 2)[:-1].lower().replace(" ", "-")
    parts = [r.choice(SHARED_WORDS), r.choice((r.choice(ARTICLE_WORDS), r.choice(PLACES)))]
    r.shuffle(parts)
    return "-".join(parts + ([r.choice(PLACES)] if r.random() < 0.4 else []))


def _marked(r: random.Random, tag: str, names: list[str], inner: str) -> str:
    """An element of noise; its name is made of one of `names`."""
    return _element(r, tag, _name(r, names), inner)


def _element(r: random.Random, tag: str, name: str, inner: str) -> str:
    if name:
        name = f' {r.choice(("class", "class", "id"))}="{name}"'
    return f"<{tag}{name}>{inner}</{tag}>"


def _links(r: random.Random) -> str:
    items = "".join(f'<li><a href="/{i}">{_sentence(r, 1, 3)[:-1]}</a></li>' for i in range(r.randint(2, 12)))
    return f"<ul>{items}</ul>"


def _noise(r: random.Random) -> str:
    """A piece of a page that is no main text."""
    kind = r.choice("nav nav header footer footer aside ad ad ad notice form comments comments related share".split())
    short, para = _sentence(r, 2, 12), _paragraph(r)
    if kind == "nav":
        return _marked(r, r.choice(("nav", "nav", "div")), ["nav", "menu", "navbar", "breadcrumbs", "topbar"], _links(r)) if r.random() < 0.7 else f"<nav>{_links(r)}</nav>"
    if kind == "header":
        return _marked(r, "header", ["", "header", "masthead", "banner"], f"<{r.choice(('h1', 'h2', 'div'))}>{short}</div><p>{_sentence(r, 2, 8)}</p>" + (_links(r) if r.random() < 0.5 else ""))
    if kind == "footer":
        return _marked(r, r.choice(("footer", "footer", "div")), ["footer", "foot", "footer copyright"], r.choice((f"&copy; {short} &middot; {para}", f"<p>&copy; {short}</p>{_links(r)}", f"<p>{para}</p>"))) if r.random() < 0.6 else f"<footer>&copy; {short} {para}</footer>"
    if kind == "aside":
        return _marked(r, r.choice(("aside", "aside", "div")), ["sidebar", "side widget", "widget", "aside"], f"<h3>{short}</h3>" + r.choice((_links(r), f"<p>{para}</p>"))) if r.random() < 0.7 else f"<aside><p>{para}</p></aside>"
    if kind == "ad":
        return _marked(r, r.choice(("div", "div", "section", "p")), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner"], r.choice((short, f"<p>{short}</p>", f'<a href="/b">{short}</a>', para)))
    if kind == "notice":
        return _marked(r, r.choice(("div", "section")), ["cookie-notice", "consent", "notice", "alert", "popup modal", "newsletter", "banner", "overlay"], f"<p>{r.choice((short, para))}</p>" + r.choice(("", "<button>Ok</button>")))
    if kind == "form":
        return f"<form{r.choice(('', ' class=search', ' id=login', ' class=subscribe'))}><p>{short}</p><label>{_sentence(r, 1, 3)}</label><input name=q><button>{short}</button></form>"
    if kind == "comments":
        body = "".join(_marked(r, r.choice(("div", "li", "article")), ["comment", "reply", "response", "answer"], f"<p>{_paragraph(r)}</p>") for _ in range(r.randint(1, 5)))
        return _marked(r, r.choice(("div", "section", "ol", "ul")), ["comments", "comment-list", "discussion", "respond", "disqus"], f"<h3>{short}</h3>{body}")
    if kind == "related":
        return _marked(r, r.choice(("div", "section")), ["related", "recommend", "more"], f"<h4>{short}</h4>" + (_links(r) if r.random() < 0.6 else f"<p>{para}</p>"))
    return _marked(r, "div", ["share", "social", "tags", "pagination", "toolbar"], _links(r) if r.random() < 0.5 else short)


GOOD = "\x01"


def training_page(r: random.Random) -> str:
    """A generated page; blocks of main text begin with GOOD."""
    blocks = [f"<h1>{GOOD}{_sentence(r, 3, 10)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice((1, 2, 3, 5, 8, 14, 24))):
        kind = r.random()
        p = GOOD + _paragraph(r)
        if kind < 0.72:
            blocks.append(f"<p>{p}</p>" if r.random() < 0.7 else f"<p><b>{p}<br>")
        elif kind < 0.8:
            blocks.append(f"<h2>{GOOD}{_sentence(r, 2, 7)}</h2>" if r.random() < 0.6 else f"<h3>{GOOD}{_sentence(r, 2, 7)}</h3>")
        elif kind < 0.86:
            blocks.append("<ul>" + "".join(f"<li>{GOOD}{_sentence(r, 3, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.9:
            blocks.append(f"<blockquote><p>{p}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{p}</blockquote>")
        elif kind < 0.93:
            blocks.append(f"<pre>{p}</pre>")
        elif kind < 0.96:
            blocks.append("<table>" + "".join(f"<tr><td>{GOOD}{_sentence(r, 1, 4)}</td><td>{GOOD}{_sentence(r, 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        else:
            blocks.append(f"<div>{p}</div>")
    for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
        blocks.insert(r.randint(1, len(blocks)), _noise(r))
    tag = r.choice(("article", "article", "article", "div", "div", "main", "section"))
    body = "".join(blocks)
    body = f"<{tag}>{body}</{tag}>" if tag in ("article", "main") and r.random() < 0.6 else _element(r, tag, _article_name(r), body)
    for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
        body = _element(r, r.choice(("div", "div", "main", "section")), _article_name(r) if r.random() < 0.5 else r.choice(("", *PLACES)), "".join([*(_noise(r) for _ in range(r.choice((0, 0, 1)))), body, *(_noise(r) for _ in range(r.choice((0, 1, 2))))]))
    head, tail = "".join(_noise(r) for _ in range(r.randint(0, 3))), "".join(_noise(r) for _ in range(r.randint(0, 3)))
    return f"<html><head><title>{_sentence(r, 2, 5)}</title></head><body>{head}{body}{tail}</body></html>"


@functools.lru_cache(maxsize=2)
def fit(pages: int = 1400, seed: int = 5) -> Model:
    """Trees fitted on generated pages; a node is positive if any text below it is main text."""
    r = random.Random(seed)
    roots, good = [], set()
    for _ in range(pages):
        root = parse(training_page(r))
        roots.append(root)
        todo = [root]
        while todo:
            node = todo.pop()
            todo.extend(node.children)
            if node.parts and GOOD in node.parts[0]:
                node.parts = [node.parts[0].replace(GOOD, "")]
                good.update(map(id, _line(node)))
    seen = np.ones((2, WORD_PLACES))
    todo = list(roots)
    while todo:
        node = todo.pop()
        todo.extend(node.children)
        seen[int(id(node) in good), list(node.attrs)] += 1
    column = np.full(WORD_PLACES, -1)
    often = np.argsort(-seen.sum(axis=0), kind="stable")[:OWN_WORDS]
    column[often] = np.arange(len(often))
    words = Words(np.log(seen[1] / seen[0]), column)
    nodes, _, _, x = features(roots, words)
    return Model(words, trees.fit(x, np.array([id(n) in good for n in nodes], float), NUMERIC, trees=90, share_of_rows=0.25))


def text_column(page: Column, model: Model | None = None) -> Column:
    """Main text of each page."""
    model = model or fit()

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array(main_texts(pages.to_pylist(), model), pa.string())

    return extract(page)


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; further columns are not kept."""
    return pages.select("page_id", "url", text_column(F.col(html_col).cast("string"), model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
