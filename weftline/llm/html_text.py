"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements and text runs. Each node has features of its subtree
(text length, link density, punctuation), its attributes' tokens, its depth, its siblings and
the same of its ancestors; boosted trees give each node the log-odds of being main text. The
decoder first draws the odds of like siblings together, so that one paragraph of many does not
fall by its place, and then picks the best set of nodes in which no node is kept under a dropped
one: from the leaves up, a subtree is kept if its own score and its children's best sum up to more
than 0.

The trees are fitted to pages that a seeded generator lays out with known labels (menus,
headers, sidebars, notices, adverts, forms, comments, footers around and inside articles), so
no page of the corpus is needed. Articles come with and without attributes or tags that name
them, down to paragraphs right in the body. Cases: null or empty html gives an empty text; unclosed
or cut-off markup is closed where HTML says so (also a head without an end), and a cut-off tag at
the end is dropped; scripts, styles, heads and controls are never text; pages of any length are
read whole; rows that repeat an id are read each for itself; a null id or url stays null; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import prepare

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^<>]*\Z", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math"}
HEAD = {"head", "title", "base", "link", "meta", "style", "script", "noscript", "template"}
GONE = {"head", "select", "button", "option", "datalist", "object", "canvas"}
CONTAINER = {"html", "body", "div", "article", "main", "section", "header", "footer", "nav", "aside", "form", "fieldset", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "figure", "details", "center", "menu", "dialog"}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption", "address", "summary", "legend", "label"}
BLOCK = CONTAINER | LEAF | GONE
#: Start tags that end an open element of the second kind, inside the third.
_CLOSES = {t: ({"p"}, BLOCK - {"p"}) for t in BLOCK - {"td", "th", "tr", "label", "option"}}
_CLOSES |= {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead"}), "option": ({"option"}, {"select"})}
TAGS = ["#text", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "label", "dialog", "address"]
TOKENS = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "popular", "share", "social", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "form", "comment", "comments", "reply", "respond", "disqus", "discussion", "tags", "meta", "byline", "copyright", "legal", "content", "article", "articlebody", "post", "entry", "story", "main", "body", "text", "page", "wrapper", "container", "caption", "complementary", "contentinfo", "toolbar", "paywall", "gdpr", "outbrain", "taboola"]
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_TOKEN_BIT = {t: 1 << (i + len(TAGS)) for i, t in enumerate(TOKENS)}
N_BITS = len(TAGS) + len(TOKENS)


class Node:
    __slots__ = ("tag", "parent", "kids", "own", "above", "raw", "link", "size", "links", "order", "index")

    def __init__(self, tag: str, parent: Node | None, own: int):
        self.tag, self.parent, self.own = tag, parent, own
        self.above = parent.above | parent.own if parent else 0
        self.kids: list[Node] = []
        self.raw: list[str] = []
        self.link = 0
        if parent:
            parent.kids.append(self)


def parse(html: str) -> list[Node]:
    """The nodes of a page in page order; nodes that are never text are left out."""
    root = Node("html", None, 0)
    nodes, stack, at, anchor = [root], [root], 0, 0
    run: Node | None = None  # the text run that the next text joins

    def text(piece: str) -> None:
        nonlocal run
        if not piece or (run is None and not piece.strip()):
            return
        top = stack[-1]
        if run is None:
            if top.tag in GONE or any(n.tag in GONE for n in stack):
                return
            run = Node("#text", top, _TAG_BIT["#text"])
            nodes.append(run)
        run.raw.append(piece)
        if anchor:
            run.link += len(piece)

    for m in iter(lambda: _TOKEN.search(html, at), None):
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in RAW and not m[1]:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at) if not m[3].endswith("/") else None
            at = end.end() if end else (len(html) if name in ("script", "style") else at)
        elif name == "a":
            anchor = not m[1]
        elif name == "br":
            text(" ")
        elif name not in BLOCK:
            continue
        elif m[1]:
            if any(n.tag == name for n in stack[1:]):
                while stack.pop().tag != name:
                    pass
                run, anchor = None, 0
        elif name == "html":
            pass
        else:
            if name not in HEAD:  # what does not belong there ends an open head
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "head":
                        del stack[k:]
                        break
            shut, border = _CLOSES.get(name, ((), ()))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                    break
                if stack[k].tag in border:
                    break
            own = _TAG_BIT.get(name, 0)
            if "=" in m[3]:
                for a in _ATTR.finditer(m[3]):
                    for w in _WORD.findall((a[1] or a[2] or a[3] or "").lower()):
                        own |= _TOKEN_BIT.get(w, 0)
            node = Node(name, stack[-1], own)
            if name not in GONE:
                nodes.append(node)
            stack.append(node)
            run, anchor = None, 0
    if at < len(html):
        text(html[at:])
    return nodes


def block_text(node: Node) -> str:
    return _SPACE.sub(" ", htmllib.unescape("".join(node.raw))).strip()


NUMBERS = 14


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node: numbers first, then its own bits, then its ancestors' bits."""
    n = len(nodes)
    paragraphs, marks = [0] * n, [0] * n
    for i, x in enumerate(nodes):
        x.index = i
        raw = "".join(x.raw)
        x.size, x.links = len(raw), x.link
        marks[i] = raw.count(".") + raw.count(",")
        paragraphs[i] = x.tag == "p"
    for i in range(n - 1, 0, -1):
        x, up = nodes[i], nodes[i].parent.index if hasattr(nodes[i].parent, "index") else 0
        nodes[up].size += x.size
        nodes[up].links += x.links
        paragraphs[up] += paragraphs[i]
        marks[up] += marks[i]
    total, before = max(1, nodes[0].size), 0
    rows = []
    depth = [0] * n
    # places among siblings, and tags of each parent's children, counted once a parent
    place, tags = [0] * n, [Counter() for _ in range(n)]
    for x in nodes:
        for k, kid in enumerate(x.kids):
            if hasattr(kid, "index"):
                place[kid.index] = k
        tags[x.index] = Counter(kid.tag for kid in x.kids)
    for i, x in enumerate(nodes):
        up = x.parent
        if up is None:
            rows.append((0, x.size, 0, 0, 0, 1, 0, 1, 1, 1, 0, 0, 0, 0))
            continue
        p = up.index if hasattr(up, "index") else 0
        depth[i] = depth[p] + 1
        kin = len(up.kids)
        rank, same = place[i], tags[p][x.tag]
        size = max(1, x.size)
        rows.append((depth[i], x.size, x.links / size, marks[i] / size * 100, paragraphs[i], kin, rank / kin, same, x.size / max(1, up.size), x.size / total, before / total, len(x.kids), up.links / max(1, up.size), up.size))
        before += len("".join(x.raw)) if x.raw else 0
    bits = np.array([[x.own & 0xFFFFFFFFFFFFFFFF, x.own >> 64, x.above & 0xFFFFFFFFFFFFFFFF, x.above >> 64] for x in nodes], np.uint64)
    spread = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(n, 4, 8), axis=2, bitorder="little").reshape(n, 2, 128)[:, :, :N_BITS].reshape(n, 2 * N_BITS)
    return np.hstack([np.array(rows, np.float32), spread.astype(np.float32)])


class Boosted:
    """Gradient-boosted trees of one depth on binned features, logistic loss."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j in range(NUMBERS):
            out[:, j] = np.searchsorted(self.edges[j], x[:, j], "right")
        out[:, NUMBERS:] = x[:, NUMBERS:] > 0
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(NUMBERS)]
        b = self.binned(x)
        live = np.flatnonzero(b.any(0))
        b, size = b[:, live], self.bins
        flat = (np.arange(len(live)) * size + b).astype(np.int64)
        margin = np.zeros(len(y))
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            feats, cuts = [], []
            for level in range(self.depth):
                for node in range(1 << level):
                    at = np.flatnonzero(leaf == node)
                    f, c = 0, size
                    if len(at) > 20:
                        cell = flat[at].ravel()
                        gs = np.bincount(cell, np.repeat(g[at], len(live)), len(live) * size).reshape(len(live), size).cumsum(1)
                        hs = np.bincount(cell, np.repeat(h[at], len(live)), len(live) * size).reshape(len(live), size).cumsum(1)
                        gt, ht = gs[:, -1:], hs[:, -1:]
                        gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                        f, c = divmod(int(gain.argmax()), size)
                        if gain[f, c] <= 1e-6:
                            f, c = 0, size
                    feats.append(int(live[f]))
                    cuts.append(c)
                base = (1 << level) - 1
                mine = np.array(feats[base:])[leaf], np.array(cuts[base:])[leaf]
                column = np.searchsorted(live, mine[0])
                leaf = leaf * 2 + (b[np.arange(len(y)), column] > mine[1])
            gl, hl = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            value = self.rate * gl / (hl + self.ridge)
            margin += value[leaf]
            self.feature.append(np.array(feats))
            self.cut.append(np.array(cuts))
            self.value.append(value)
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        row, out = np.arange(len(b)), np.zeros(len(b))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            leaf = np.zeros(len(b), np.int64)
            for level in range(self.depth):
                at = leaf + (1 << level) - 1
                leaf = leaf * 2 + (b[row, feature[at]] > cut[at])
            out += value[leaf]
        return out


def agreed(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """Margins drawn to the mean of their like, the more the more there are: siblings of one tag and the same attribute tokens, and the text runs right inside such."""
    names: dict[tuple, int] = {}
    kin = np.empty(len(nodes), np.int64)
    for i, x in enumerate(nodes):
        up = x.parent
        if up is None:
            like: tuple = (-1,)
        elif x.raw and up.tag in LEAF and up.parent is not None:
            like = (up.parent.index if hasattr(up.parent, "index") else 0, "#", up.tag, up.own)
        else:
            like = (up.index if hasattr(up, "index") else 0, x.tag, "", x.own)
        kin[i] = names.setdefault(like, len(names))
    size = np.bincount(kin)
    weight = (size / (size + 2))[kin]
    return (1 - weight) * margin + weight * (np.bincount(kin, margin) / size)[kin]


#: Prose is a run of at least so many characters, with at most this share of links and at least so many full stops and commas a character.
PROSE_CHARS, PROSE_LINKS, PROSE_MARKS = 60, 0.2, 0.01
#: The odds under which even the likeliest prose of a page is no article.
LEAST_ODDS = -4.0


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The best choice in which every kept node has all its ancestors kept.

    Where that leaves nothing of a page that has prose, all odds are raised until its likeliest prose is kept:
    dense prose outweighs the lack of a tag or attribute that names it.
    """
    margin = agreed(nodes, margin)
    keep = _chosen(nodes, margin)
    if any(k and x.raw for k, x in zip(keep, nodes)):
        return keep
    prose = [i for i, x in enumerate(nodes) if x.raw and _is_prose(x)]
    best = max((float(margin[i]) for i in prose), default=LEAST_ODDS)
    return _chosen(nodes, margin + (0.5 - best)) if best > LEAST_ODDS else keep


def _is_prose(x: Node) -> bool:
    raw = "".join(x.raw)
    return len(raw) >= PROSE_CHARS and x.link <= PROSE_LINKS * len(raw) and raw.count(".") + raw.count(",") >= PROSE_MARKS * len(raw)


def _chosen(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    best = [float(m) * (1 + min(3.0, len(x.raw) and np.log1p(x.size) / 2)) for x, m in zip(nodes, margin)]
    best[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            up = nodes[i].parent
            best[up.index if hasattr(up, "index") else 0] += best[i]
    keep = [True] + [False] * (len(nodes) - 1)
    for i in range(1, len(nodes)):
        up = nodes[i].parent
        keep[i] = best[i] > 0 and keep[up.index if hasattr(up, "index") else 0]
    return keep


#: How an article may be wrapped; {name} is one of NAMES, {word} any word.
LAYOUTS = {
    "article": "<article>{body}</article>", "main": "<main>{body}</main>", "main article": "<main><article>{body}</article></main>", "class": '<div class="{name}">{body}</div>', "id": '<div id="{name}">{body}</div>',
    "header inside": "<article><header>{head}</header>{body}</article>", "div": "<div>{body}</div>", "section": "<section>{body}</section>", "id main": '<div id="main">{body}</div>', "role main": '<div role="main">{body}</div>',
    "class body": '<div class="body">{body}</div>', "class entry": '<div class="entry">{body}</div>', "any class": '<div class="{word}">{body}</div>', "bare": "{body}", "nested": '<div><div class="{word}"><div>{body}</div></div></div>',
    "table": "<table><tr><td>{body}</td></tr></table>", "center": "<center>{body}</center>", "row": '<div class="row"><div class="col">{body}</div>{side}</div>',
}
#: The layouts that half of the pages have; the others share the rest.
USUAL = ("article", "article", "main", "main article", "class", "id", "header inside")
NAMES = ("content", "article", "post", "entry-content", "story", "article-body", "main-content", "post-content", "text")


def synthetic_page(rng: np.random.Generator, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> tuple[str, list[str]]:
    """A page and the block texts of its article. Words are drawn from a made-up vocabulary."""
    pick = lambda *c: c[rng.integers(len(c))]
    words = lambda lo, hi: " ".join("".join(pick("ka", "the", "ri", "on", "est", "mu", "la", "der", "en", "vo", "ti", "s") for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(lo, hi)))
    sentence = lambda lo=4, hi=18: words(lo, hi).capitalize() + pick(".", ".", ",", "!")
    prose = lambda k=5: " ".join(sentence() for _ in range(rng.integers(1, k + 1)))
    attr = lambda *names: f' {pick("class", "class", "id")}="{pick("", "", "site-", "js-")}{pick(*names)}"'
    links = lambda k: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.integers(3, k)))
    menu = lambda: pick(f"<ul>{links(9)}</ul>", "".join(f'<a href="#">{words(1, 3)}</a> ' for _ in range(4)))
    kept: list[str] = []

    def main(tag: str, body: str) -> str:
        kept.append(" ".join(body.split()))
        return f"<{tag}>{body}</{tag}>" if tag != "p" or rng.random() < 0.8 else f"<p>{body}"

    def clutter() -> str:
        kind = rng.integers(12)
        t = pick("div", "div", "aside", "section")
        if kind == 0:
            return f"<div{attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-box', 'banner')}>{pick(sentence(), prose(2), f'<p>{prose(2)}</p>')}</div>"
        if kind == 1:
            return f"<div{attr('cookie', 'consent', 'notice', 'cookie-notice', 'alert', 'gdpr', 'popup', 'banner')}>{pick(sentence(), f'<p>{prose(2)}</p>')}</div>"
        if kind == 2:
            return f"<form{pick('', attr('newsletter', 'signup', 'search', 'login'))}>{pick('', f'<p>{sentence()}</p>')}<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>"
        if kind == 3:
            return f"<aside{pick('', attr('sidebar', 'widget', 'related'))}>{pick(f'<h3>{words(1, 4)}</h3>', '')}{pick(menu(), f'<p>{prose(3)}</p>')}</aside>"
        if kind == 4:
            each = "".join(pick(f"<p>{prose(3)}</p>", f'<div class="comment">{pick("", f"<b>{words(1, 3)}</b> ")}<p>{prose(3)}</p></div>', f"<li>{prose(2)}</li>") for _ in range(rng.integers(1, 5)))
            return f"<{t}{attr('comments', 'comment-list', 'discussion', 'disqus', 'respond', 'comments-area')}>{pick('', f'<h3>{words(1, 3)}</h3>')}{each}</{t}>"
        if kind == 5:
            return f"<{t}{attr('related', 'recommended', 'popular', 'sidebar', 'widget')}><h3>{words(1, 4)}</h3>{menu()}</{t}>"
        if kind == 6:
            return f"<div{attr('share', 'social', 'tags', 'meta', 'toolbar', 'breadcrumb', 'breadcrumbs')}>{pick(menu(), words(1, 6))}</div>"
        if kind == 7:
            return f"<div{attr('subscribe', 'newsletter', 'paywall', 'signup')}><p>{sentence()}</p></div>"
        if kind == 8:
            return f"<nav>{menu()}</nav>"
        if kind == 9:
            return f"<{t}{attr('sidebar', 'widget')}><p>{prose(3)}</p></{t}>"
        if kind == 10:
            return f"<script>var t='<p>{words(1, 4)}</p>';</script><style>p{{}}</style><!-- {words(1, 3)} -->"
        return f'<div role="{pick("complementary", "navigation", "search", "alert")}">{pick(menu(), f"<p>{prose(2)}</p>")}</div>'

    some = lambda p, k=3: "".join(clutter() for _ in range(rng.integers(1, k + 1))) if rng.random() < p else ""
    top = some(0.4) + pick(f"<nav>{menu()}</nav>", f"<header{pick('', attr('header', 'masthead'))}>{pick('', f'<h1>{words(1, 4)}</h1>')}{pick(menu(), f'<nav>{menu()}</nav>', sentence())}</header>", f"<div{attr('nav', 'menu', 'navigation', 'header')}>{menu()}</div>", "") + some(0.7)
    body = main("h1", words(2, 9)) if rng.random() < 0.8 else ""
    for _ in range(rng.integers(14, 60) if rng.random() < 0.1 else rng.integers(1, 14)):
        body += pick(*[lambda: main("p", prose(6))] * 7, lambda: main("p", words(1, 4) + "."), lambda: main("h2", words(1, 6)), lambda: "<ul>" + "".join(main("li", sentence()) for _ in range(3)) + "</ul>", lambda: main("blockquote", prose(2)), lambda: some(0.5, 1), lambda: f"<figure><img>{main('figcaption', sentence())}</figure>", lambda: "<table><tr>" + main("td", words(1, 4)) + main("td", words(1, 4)) + "</tr></table>")()
    body += some(0.3)
    usual = [x for x in USUAL if x in layouts]
    layout = LAYOUTS[pick(*usual) if usual and rng.random() < 0.5 else pick(*layouts)]
    head = main("h1", words(2, 7)) if "{head}" in layout else ""
    if head:
        kept.insert(0, kept.pop())
    body = layout.format(body=body, head=head, name=pick(*NAMES), word=words(1, 2).replace(" ", "-"), side=some(0.6) if "{side}" in layout else "")
    foot = some(0.6) + pick("", f"<footer>{pick(sentence(), menu(), f'<p>{sentence()}</p>')}</footer>", f"<footer>&copy; {words(1, 3)} &middot; {prose(2)}</footer>", f"<div{attr('footer', 'copyright', 'legal')}>{sentence()}</div>")
    page = top + pick(body, f'<div class="{pick("wrapper", "container", "page")}">{body}{some(0.4)}</div>') + foot
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>", kept


@functools.cache
def trained(pages: int = 700, seed: int = 7, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> Boosted:
    """The trees, fitted to generated pages of these layouts. A node's label: whether an article's text is in it."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, kept = synthetic_page(rng, layouts)
        nodes = parse(page)
        xs.append(features(nodes))
        wanted = set(kept)
        y = [False] * len(nodes)
        for i, x in enumerate(nodes):
            if x.raw and block_text(x) in wanted:
                while x is not None:
                    if hasattr(x, "index"):
                        y[x.index] = True
                    x = x.parent
        ys.append(np.array(y, float))
    return Boosted().fit(np.vstack(xs), np.concatenate(ys))


def extract(pages: list[str | None], trees: Boosted) -> list[list[str]]:
    """The kept block texts of each page."""
    parsed = [parse(p) if p else [] for p in pages]
    rows = [features(n) for n in parsed if n]
    margin = trees.margins(np.vstack(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        keep = decode(nodes, margin[at : at + len(nodes)]) if nodes else []
        at += len(nodes)
        texts = [block_text(x) for x, k in zip(nodes, keep) if k and x.raw]
        out.append([t for t in texts if t])
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, blocks (the kept block texts), text (joined by line ends)."""
    prepare(pages.sparkSession)
    trees = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                blocks = extract(part.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(blocks, pa.list_(pa.string())), pa.array(["\n".join(b) for b in blocks], pa.string())], names=["page_id", "url", "blocks", "text"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id bigint, url string, blocks array<string>, text string")
