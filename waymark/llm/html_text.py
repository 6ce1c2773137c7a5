"""Main text of raw web pages, from boosted trees over page nodes and a decoding of the whole tree.

A page becomes a tree of elements and text runs. Every node gets features: what its tag and attribute tokens and those of its ancestors are,
depth, place among its siblings and on the page, how much text, linked text and markup its subtree has and how dense they are. Gradient-boosted
trees give each node a probability of belonging to the main text. The decoding then picks the likeliest labels for the whole tree under the rule
that what lies inside a dropped node is dropped, so no ancestor contradicts a descendant.

No page says what its main text is, so the trees learn from pages whose tags and attributes tell (an ``article``, a ``nav``, a class "footer"),
and from the same texts laid out anew in other ways.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noframes select object canvas button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var del nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table html body".split())
# Tag and attribute tokens that tell what a part of a page is.
MAIN = frozenset("article main content post entry story text".split())
OTHER = frozenset("nav menu navbar navigation header masthead footer copyright aside sidebar widget notice cookie alert banner ad ads advert advertisement adsbygoogle sponsored promo comment comments commentlist reply respond form search newsletter subscribe login related share social breadcrumb pagination popup modal tags".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")
TOKENS = 48
FEATURES = 18


class Page:
    """A page's nodes in page order; a text run is a node whose ``text`` is not None."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.text, self.breaks, self.linked, self.marks = [-1], ["#root"], [()], [None], [True], [0], [0]
        self._read(source)

    def _add(self, parent: int, tag: str, tokens: tuple, text: str | None, breaks: bool, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.breaks.append(breaks)
        self.linked.append(linked)
        self.marks.append(0)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack = [0]
        run: list[str] = []
        state = {"break": True, "link": 0, "linked": 0}
        pos, end = 0, len(source)

        def flush() -> None:
            if run:
                text = "".join(run)
                run.clear()
                if text.strip():
                    self._add(stack[-1], "#text", (), text, state["break"], state["linked"])
                    state["break"] = False
                elif text and not state["break"]:
                    self._add(stack[-1], "#text", (), " ", False)
                state["linked"] = 0

        def close(names, fence) -> None:
            for i in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[i]]
                if t in names:
                    flush()
                    del stack[i:]
                    return
                if t in fence:
                    return

        while pos < end:
            m = TAG.search(source, pos)
            if m is None:
                run.append(source[pos:])
                break
            if m.start() > pos:
                piece = source[pos : m.start()]
                run.append(piece)
                if state["link"]:
                    state["linked"] += len(piece)
            pos = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            closing = bool(m[1] or m[4])
            self.marks[stack[-1]] += 1
            if name in RAW:
                if not closing:
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, pos)
                    pos = stop.end() if stop else end
                continue
            if name == "a":
                state["link"] = 0 if closing else 1
            if name in VOID:
                if name in ("br", "hr"):
                    run.append(" ")
                continue
            attributes = m[3] or m[6] or ""
            inline = name in INLINE
            if closing:
                if any(self.tag[n] == name for n in stack[1:]):
                    if not inline:
                        close({name}, ())
                        state["break"] = True
                    else:
                        close({name}, FENCE)
                continue
            tokens = tuple(dict.fromkeys(t for a in ATTRIBUTE.findall(attributes) for t in PART.findall(" ".join(a[1:]).lower()))) if attributes else ()
            if inline and not tokens:
                continue
            if not inline:
                flush()
                if name in CLOSES_P:
                    close({"p"}, FENCE | {"td", "th", "li", "div", "section", "article"})
                if name in ALIKE:
                    close(ALIKE[name], {"ul", "ol", "dl", "table", "select"} if name != "tr" else {"table"})
                state["break"] = True
            else:
                flush()
            stack.append(self._add(stack[-1], name, tokens, None, not inline))
        flush()


def tokens_of(tag: str, tokens: tuple) -> tuple:
    return (f"<{tag}>", *tokens)


@dataclass
class PageModel:
    """Token slots, the bins of each feature, and the trees as arrays (feature, bin, leaf value)."""

    slots: dict[str, int]
    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float


def features(page: Page, slots: dict[str, int]) -> np.ndarray:
    n = len(page.parent)
    parent = np.array(page.parent)
    own = np.array([len(t) if t else 0 for t in page.text], float)
    linked = np.array(page.linked, float)
    marks = np.array(page.marks, float)
    stops = np.array([t.count(".") + t.count(",") if t else 0 for t in page.text], float)
    is_text = np.array([t is not None for t in page.text], float)
    x = np.zeros((n, FEATURES + 2 * TOKENS), np.float32)
    bits = x[:, FEATURES : FEATURES + TOKENS]
    above = x[:, FEATURES + TOKENS :]
    depth, index, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
    sub, sub_link, sub_marks, sub_text, sub_stops = own.copy(), linked.copy(), marks.copy(), is_text.copy(), stops.copy()
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        index[i] = siblings[p]
        siblings[p] += 1
        for t in tokens_of(page.tag[i], page.tokens[i]):
            s = slots.get(t)
            if s is not None:
                bits[i, s] = 1
        above[i] = np.maximum(above[p], bits[p])
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        sub[p] += sub[i]
        sub_link[p] += sub_link[i]
        sub_marks[p] += sub_marks[i]
        sub_text[p] += sub_text[i]
        sub_stops[p] += sub_stops[i]
    up = np.maximum(parent, 0)
    total = max(sub[0], 1.0)
    before = np.cumsum(own) - own
    cols = [
        depth, index, siblings[up], siblings, np.log1p(own), np.log1p(sub), sub / total, sub_link / np.maximum(sub, 1), sub / (sub_marks + 1), np.log1p(sub_text), sub_stops / np.maximum(sub, 1),
        before / total, is_text, sub / np.maximum(sub[up], 1), sub_link[up] / np.maximum(sub[up], 1), sub[up] / (sub_marks[up] + 1), np.log1p(sub[up]), sub / np.maximum(sub_text, 1),
    ]
    x[:, :FEATURES] = np.stack(cols, axis=1)
    return x


def told(page: Page) -> np.ndarray:
    """1 for text in a part that tags or attributes call main and for what holds such text; 0 elsewhere."""
    n = len(page.parent)
    state = np.zeros(n, int)  # 0 unknown, 1 main, -1 other
    for i in range(1, n):
        p = page.parent[i]
        names = {page.tag[i], *page.tokens[i]}
        if names & OTHER and not (page.tag[i] == "header" and state[p] == 1):
            state[i] = -1
        elif state[p] != -1 and names & MAIN:
            state[i] = 1
        else:
            state[i] = state[p]
    y = np.array([float(t is not None and s == 1) for t, s in zip(page.text, state, strict=True)])
    for i in range(n - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return y


def laid_out_anew(page: Page, y: np.ndarray, other: list[str], rng: random.Random) -> str:
    """The page's main text inside other markup, with parts around it made from its own remaining text and another page's paragraphs."""
    main = [(page.tag[page.parent[i]], page.text[i]) for i in range(len(y)) if page.text[i] is not None and y[i] and page.text[i].strip()]
    rest = [page.text[i] for i in range(len(y)) if page.text[i] is not None and not y[i] and page.text[i].strip()] or ["More"]
    some = lambda k: [rng.choice(rest) for _ in range(k)]
    links = lambda k: "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(some(k)))
    paragraphs = lambda k: "".join(f"<p>{rng.choice(other)}</p>" for _ in range(k)) if other else ""
    pick = rng.choice
    body = "".join(f"<{t}>{x}</{t}>" if t in ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "td") else f"<p>{x}</p>" for t, x in main)
    parts = []
    if rng.random() < 0.7:
        parts.append(pick(["<header><h2>{}</h2></header>", '<div id="header"><a href="/">{}</a></div>', '<div class="masthead"><span>{}</span></div>']).format(*some(1)))
    parts.append(pick(['<div class="menu"><ul>{}</ul></div>', '<div id="navbar"><ul>{}</ul></div>', '<ul class="navigation">{}</ul>', "<nav><ul>{}</ul></nav>", '<div class="c1"><ul>{}</ul></div>']).format(links(rng.randint(3, 9))))
    if rng.random() < 0.4:
        parts.append(pick(['<div class="cookie-notice"><p>{}</p></div>', '<div role="alert">{}</div>', '<div class="banner"><p>{}</p></div>']).format(*some(1)))
    extra = []
    if rng.random() < 0.5:
        extra.append(pick(["<aside><h3>{}</h3><ul>{}</ul></aside>", '<div class="sidebar"><h3>{}</h3><ul>{}</ul></div>', '<div id="right"><div class="widget"><h3>{}</h3><ul>{}</ul></div></div>']).format(some(1)[0], links(4)))
    if rng.random() < 0.6:
        extra.append(pick(['<div class="ad">{}</div>', '<div class="advert sponsored"><p>{}</p></div>', '<div class="promo"><a href="/x">{}</a></div>']).format(*some(1)))
    if rng.random() < 0.4:
        extra.append(pick(['<form class="search"><label>{}</label><input name="q"></form>', '<form id="subscribe"><p>{}</p><input type="email"></form>']).format(*some(1)))
    holder = pick(["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="post-content">{}</div>', '<section class="entry">{}</section>', '<div class="article-body">{}</div>', '<div class="story"><div>{}</div></div>', '<div class="text">{}</div>'])
    inner = body
    if extra and rng.random() < 0.3:
        half = body.find("</p>") + 4
        inner = body[:half] + extra.pop() + body[half:]
    middle = [*extra, holder.format(inner.replace("{", "&#123;").replace("}", "&#125;"))] if rng.random() < 0.5 else [holder.format(inner.replace("{", "&#123;").replace("}", "&#125;")), *extra]
    parts.append("".join(middle) if rng.random() < 0.5 else f'<div class="wrapper">{"".join(middle)}</div>')
    if rng.random() < 0.5:
        parts.append(pick(['<section id="comments"><h3>{}</h3><div class="comment">{}</div></section>', '<ol class="commentlist"><li class="reply"><b>{}</b>{}</li></ol>', '<div class="comments"><div class="comment"><span>{}</span>{}</div></div>']).format(some(1)[0], paragraphs(rng.randint(1, 3))))
    if rng.random() < 0.3:
        parts.append('<div class="related"><ul>{}</ul></div>'.format(links(4)))
    parts.append(pick(["<footer>{}</footer>", '<div id="footer"><p>{}</p></div>', '<div class="copyright">{}</div>']).format(*some(1)))
    return f"<html><head><title>x</title></head><body>{''.join(parts)}</body></html>"


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> tuple:
    """Gradient-boosted trees on the logistic loss with second-order leaf values; full trees of fixed depth over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    wide = bins + 1
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    z = np.full(len(y), start)
    feature, cut, value = np.zeros((trees, (1 << depth) - 1), np.int32), np.full((trees, (1 << depth) - 1), wide, np.int32), np.zeros((trees, 1 << depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            many = 1 << level
            best, where, place = np.full(many, 1e-9), np.zeros(many, np.int32), np.full(many, wide, np.int32)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key = at * wide + binned[:, j]
                gs = np.bincount(key, g, many * wide).reshape(many, wide).cumsum(1)
                hs = np.bincount(key, h, many * wide).reshape(many, wide).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[(hs < 1e-3) | (ha - hs < 1e-3)] = 0
                c = gain.argmax(1)
                v = gain[np.arange(many), c]
                up = v > best
                best[up], where[up], place[up] = v[up], j, c[up]
            base = many - 1
            feature[t, base : base + many], cut[t, base : base + many] = where, place
            at = at * 2 + (binned[np.arange(len(y)), where[at]] > place[at])
        gs, hs = np.bincount(at, g, 1 << depth), np.bincount(at, h, 1 << depth)
        value[t] = rate * gs / (hs + ridge)
        z += value[t][at]
    return edges, feature, cut, value, start


def train(sources: list[str], seed: int = 11, anew: int = 2, most_nodes: int = 30000) -> PageModel:
    rng = random.Random(seed)
    pages = [Page(s) for s in sources]
    labels = [told(p) for p in pages]
    paragraphs = [p.text[i] for p, y in zip(pages, labels, strict=True) for i in range(len(y)) if p.text[i] and y[i] and len(p.text[i]) > 40]
    for p, y in list(zip(pages, labels, strict=True)):
        if y.any():
            for _ in range(anew):
                new = Page(laid_out_anew(p, y, paragraphs, rng))
                pages.append(new)
                labels.append(told(new))
    often = Counter(t for p in pages for i in range(1, len(p.parent)) for t in set(tokens_of(p.tag[i], p.tokens[i])))
    slots = {t: i for i, (t, _) in enumerate(sorted(often.items(), key=lambda kv: (-kv[1], kv[0]))[:TOKENS])}
    x = np.concatenate([features(p, slots)[1:] for p in pages]) if pages else np.zeros((0, FEATURES + 2 * TOKENS), np.float32)
    y = np.concatenate([v[1:] for v in labels]) if pages else np.zeros(0)
    if not len(y):
        x, y = np.zeros((2, FEATURES + 2 * TOKENS), np.float32), np.array([0.0, 1.0])
    keep = np.random.default_rng(seed).permutation(len(y))[:most_nodes]
    edges, feature, cut, value, start = boost(x[keep], y[keep])
    return PageModel(slots, edges, feature, cut, value, start)


def log_odds(model: PageModel, x: np.ndarray) -> np.ndarray:
    used = np.unique(model.feature)
    binned = np.zeros(x.shape, np.int32)
    for j in used:
        binned[:, j] = np.searchsorted(model.edges[j], x[:, j], side="left")
    z = np.full(len(x), model.start)
    row = np.arange(len(x))
    depth = int(np.log2(model.value.shape[1]))
    for t in range(len(model.value)):
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            node = at + (1 << level) - 1
            at = at * 2 + (binned[row, model.feature[t][node]] > model.cut[t][node])
        z += model.value[t][at]
    return z


def decode(page: Page, z: np.ndarray) -> np.ndarray:
    """The likeliest consistent labels: a kept node has kept ancestors. The root is kept."""
    n = len(page.parent)
    keep = (-np.logaddexp(0, -z)).tolist()
    drop = (-np.logaddexp(0, z)).tolist()
    stay = [0.0] * n  # what the children of a kept node add
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        stay[p] += max(keep[i] + stay[i], drop[i])
        drop[p] += drop[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[page.parent[i]] and keep[i] + stay[i] > drop[i]
    return out


def main_text(page: Page, kept: np.ndarray) -> str:
    parts = []
    for i in range(1, len(page.parent)):
        if page.text[i] is not None:
            if page.breaks[i]:
                parts.append(" ")
            if kept[i]:
                t = page.text[i]
                parts.append(entities.unescape(t) if "&" in t else t)
    return " ".join("".join(parts).split())


def extract(model: PageModel, sources: list[str | None]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    x = [features(p, model.slots) for p in pages]
    z = log_odds(model, np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        out.append(main_text(p, decode(p, z[at : at + n])))
        at += n
    return out


def page_texts(pages: DataFrame, page_id: str = "page_id", source: str = "html", sample: int = 200) -> DataFrame:
    """Extract the main text of every raw web page.

    This library has no records of web pages, so the operator is general: ``pages`` has an id and the page's source. About ``sample`` pages, chosen
    by a hash of their ids, are gathered to fit the trees; every page is read whole. Returns ``page_id`` (as it comes), ``text`` and ``n_chars`` (code
    points).

    The text is the page's article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader
    comments: character references decoded, white space inside a block made one space, blocks in page order joined by one space. Broken markup
    is read on as browsers do for open paragraphs, list items and cells. A null or empty page, or one without main text, gives an empty text;
    text without any markup is one run like any other. Repeated rows are read each for itself. Other columns are not read.
    """
    src = pages.select(F.col(page_id).alias("page_id"), F.col(source).cast("string").alias("html"))
    n = src.count()
    draw = F.pmod(F.xxhash64("page_id", F.lit(13)), F.lit(1 << 30))
    share = 1 << 30 if n <= sample else int((1 << 30) * sample / n)
    rows = sorted((str(r[0]), r[1]) for r in src.filter((draw < share) & F.col("html").isNotNull()).collect())  # about ``sample`` pages
    model = train([r[1] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            texts = extract(model, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {dict(src.dtypes)['page_id']}, text string, n_chars long")
