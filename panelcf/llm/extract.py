"""Main text of web pages: gradient-boosted trees over DOM-node features with hierarchical decoding.

Each block element and each text block of a page is a node. Boosted trees give the odds that a node is, or contains, main text.
Decoding takes the best consistent choice for the page: a node may be kept only if its parent is, so the kept
nodes form a tree from the root, and the one with the greatest total log-likelihood wins (one pass up, one down).

There are no labelled pages. Training takes a bounded sample of pages whose own semantic elements tell content from the rest, and lays
the text of these pages out anew in many ways (semantic, generic and misleading element and class names, comments, notices,
adverts, forms, sidebars, related links), where the place of the main text is known.

Defined results: a null, empty or text-less page gives the empty text; broken markup is read as browsers would in the common
cases; equal pages give equal texts.
"""

from __future__ import annotations

import random
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.llm.dom import Node, attributes, parse

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pages whose text the training layouts use: those with the least hash of page_id.
SAMPLE_PAGES = 200
LAYOUTS = 600
TREES, DEPTH, BINS, RATE = 70, 4, 32, 0.25

# Attribute tokens that hint at content or at the rest.
GOOD = ("article", "content", "post", "entry", "main", "body", "story", "text", "page", "blog", "prose")
BAD = (
    "nav", "menu", "header", "head", "footer", "foot", "sidebar", "side", "aside", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner",
    "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "comment", "comments", "reply", "replies", "discussion", "disqus", "share",
    "social", "related", "recommended", "more", "form", "login", "signup", "subscribe", "newsletter", "search", "breadcrumb", "breadcrumbs", "pagination",
    "pager", "tags", "meta", "widget", "copyright", "toolbar", "skip", "hidden", "gdpr", "masthead", "topbar", "feedback", "message", "warning", "disclaimer",
    "responses", "reader", "readers", "user", "thread", "legal", "trending", "popular", "byline", "author",
)
ROLES_BAD = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "note")
TAGS = {t: i for i, t in enumerate(
    "#text html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre "
    "figure figcaption nav header footer aside form fieldset details summary address dialog head".split())}
_BAD_TAGS = frozenset("nav header footer aside form dialog fieldset head".split())
_GOOD_TAGS = frozenset(("article", "main"))
_UPPER = re.compile(r"[A-Z]")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_good, _bad = frozenset(GOOD), frozenset(BAD)

FEATURES = (
    "tag", "parent tag", "depth", "good tokens", "bad tokens", "good above", "bad above", "bad tag above", "good tag above", "good tokens or tag below",
    "characters", "words a block", "link share", "punctuation a word", "elements below", "text a element", "place", "end place",
    "sibling number", "siblings", "siblings of the tag", "share of the parent's text", "share of the page's text",
    "word length", "upper case share", "symbol", "children", "next sibling's characters", "previous sibling's characters", "bad tokens below", "heading below", "parent's link share",
)


def _tokens(node: Node) -> tuple[int, int]:
    if not node.attributes:
        return 0, 0
    a = attributes(node.attributes)
    names = set(_SPLIT.split(_CAMEL.sub(" ", f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}").lower()))
    bad = len(names & _bad) + (a.get("role", "").lower() in ROLES_BAD) + ("hidden" in a or a.get("aria-hidden") == "true")
    style = a.get("style", "").replace(" ", "").lower()
    return len(names & _good) + (a.get("role", "").lower() in ("main", "article")), bad + 2 * ("display:none" in style)


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each node."""
    n = len(nodes)
    chars, linked, blocks, words, marks, below, upper = ([0] * n for _ in range(7))
    last, good, bad, good_in, bad_in, heading, symbol = ([0] * n for _ in range(7))
    for i, x in enumerate(nodes):
        last[i] = x.at
        if x.tag == "#text":
            t = x.text
            chars[i], linked[i], blocks[i] = len(t), x.linked, 1
            words[i], marks[i] = t.count(" ") + 1, sum(map(t.count, ".,;:!?"))
            upper[i] = len(_UPPER.findall(t))
            symbol[i] = "©" in t or "®" in t
        else:
            good[i], bad[i] = _tokens(x)
            heading[i] = x.tag in ("h1", "h2")
        good_in[i], bad_in[i] = good[i] + (x.tag in _GOOD_TAGS), bad[i] + (x.tag in _BAD_TAGS)
    own_good, own_bad = good_in[:], bad_in[:]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for a in (chars, linked, blocks, words, marks, upper, good_in, bad_in):
            a[p] += a[i]
        heading[p] |= heading[i]
        symbol[p] |= symbol[i]
        below[p] += below[i] + 1
        last[p] = max(last[p], last[i])
    total, end = max(1, chars[0]), max(1, last[0])
    up_good, up_bad, up_bad_tag, up_good_tag = ([0] * n for _ in range(4))
    rows = []
    for i, x in enumerate(nodes):
        p = x.parent
        if p >= 0:
            up_good[i], up_bad[i] = up_good[p] + good[p], up_bad[p] + bad[p]
            up_bad_tag[i] = up_bad_tag[p] + (nodes[p].tag in _BAD_TAGS)
            up_good_tag[i] = up_good_tag[p] + (nodes[p].tag in _GOOD_TAGS)
    number, same, before, after = [0] * n, [1] * n, [0] * n, [0] * n
    for x in nodes:
        counts: dict[str, int] = {}
        for c in x.children:
            counts[nodes[c].tag] = counts.get(nodes[c].tag, 0) + 1
        for k, c in enumerate(x.children):
            number[c], same[c] = k, counts[nodes[c].tag]
            before[c] = chars[x.children[k - 1]] if k else 0
            after[c] = chars[x.children[k + 1]] if k + 1 < len(x.children) else 0
    for i, x in enumerate(nodes):
        p, c, w = max(0, x.parent), chars[i], max(1, words[i])
        rows.append((
            TAGS.get(x.tag, len(TAGS)), TAGS.get(nodes[p].tag, len(TAGS)), x.depth, good[i], bad[i], up_good[i], up_bad[i], up_bad_tag[i], up_good_tag[i],
            good_in[i] - own_good[i], c, words[i] / max(1, blocks[i]), linked[i] / max(1, c), marks[i] / w, below[i], c / (1 + below[i]),
            x.at / end, last[i] / end, number[i], len(nodes[p].children), same[i], c / max(1, chars[p]), c / total,
            c / w, upper[i] / max(1, c), symbol[i], len(x.children), after[i], before[i],
            bad_in[i] - own_bad[i], heading[i], linked[p] / max(1, chars[p]),
        ))
    return np.array(rows, np.float32)


@dataclass
class Boosted:
    """Depth-wise trees on quantile bins: per tree the features and cuts of its inner nodes in heap order, and its leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, at = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            k = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                k = 2 * k + 1 + (x[at, f[k]] > c[k])
            out += leaf[k - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss on histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score, inner, out = np.full(len(y), base), 2**DEPTH - 1, []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        node, feature, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            local, best = node - first, np.full(width, 1e-6)
            gt, ht = np.bincount(local, g, width), np.bincount(local, h, width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                at, size = local * (BINS + 1) + binned[:, j], width * (BINS + 1)
                gl = np.bincount(at, g, size).reshape(width, -1).cumsum(1)[:, : len(c)]
                hl = np.bincount(at, h, size).reshape(width, -1).cumsum(1)[:, : len(c)]
                gain = gl**2 / (hl + 1) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + 1) - (gt**2 / (ht + 1))[:, None]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[better, top[better]]
                feature[first:first + width][better], cut[first:first + width][better] = j, c[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        local = node - inner
        leaf = RATE * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + 1)
        score += leaf[local]
        out.append((feature, cut, leaf))
    return Boosted(base, *(np.stack(a) for a in zip(*out)))


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which every kept node has a kept parent."""
    keep, drop = (-np.logaddexp(0, -log_odds)).tolist(), (-np.logaddexp(0, log_odds)).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = [keep[0] > drop[0]]
    for i in range(1, len(nodes)):
        kept.append(kept[nodes[i].parent] and keep[i] > drop[i])
    return kept


def main_text(nodes: list[Node], log_odds: np.ndarray) -> str:
    return "\n".join(x.text for x, kept in zip(nodes, decode(nodes, log_odds)) if kept and x.tag == "#text")


# ---- training pages -------------------------------------------------------------------------------------------------

_TEXT = "text of the page"


def _material(sources: list[str]) -> list[list[str]]:
    """Paragraphs of the sampled pages: the text blocks in article or main elements, or else all longer blocks."""
    out = []
    for source in sources:
        nodes = parse(source)
        inside = [x.tag in _GOOD_TAGS for x in nodes]
        for i, x in enumerate(nodes[1:], 1):
            inside[i] = inside[i] or inside[x.parent]
        texts = [x.text for i, x in enumerate(nodes) if x.tag == "#text" and (inside[i] or not any(inside) and len(x.text) > 80)]
        if texts:
            out.append(texts)
    return out or [[" ".join([_TEXT] * k) + "." for k in (2, 8, 20, 5, 12)]]


def _layout(rng: random.Random, material: list[list[str]]) -> str:
    """A page whose main text stands in elements marked with the attribute main-text."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    article = rng.choice(material)
    if rng.random() < 0.3:
        article = article[: rng.randint(1, 3)]
    if rng.random() < 0.12:  # hardly any text
        article = [" ".join(t.split()[: rng.randint(1, 4)]) for t in article[:2]]
    pool = " ".join(rng.choice(material)).split() or [_TEXT]

    def some(lo: int, hi: int) -> str:
        k, at = rng.randint(lo, hi), rng.randrange(len(pool))
        return esc(" ".join((pool + pool)[at:at + k]) if len(pool) > 1 else pool[0])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{some(1, 4)}</a></li>' for i in range(k)) + "</ul>"

    def box(tag: str, names: tuple[str, ...], body: str) -> str:
        name = rng.choice(names)
        if tag != "div" and rng.random() < 0.35:
            return f"<{tag}>{body}</{tag}>"
        shown = "div" if rng.random() < 0.4 else tag
        return f'<{shown} {rng.choice(("class", "id"))}="{name}">{body}</{shown}>'

    def paragraphs(texts: list[str]) -> str:
        out, soup = [], rng.random() < 0.3
        for k, t in enumerate(texts):
            t = esc(t)
            if k and rng.random() < 0.12:
                size = rng.randint(2, 4)
                out.append(f"<h{size} main-text>{some(2, 7)}</h{size}>")
            kind = rng.random()
            if kind < 0.05:
                out.append("<ul main-text>" + "".join(f"<li>{some(3, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.09:
                out.append(f"<blockquote main-text><p>{t}</p></blockquote>")
            elif kind < 0.12:
                out.append(f"<table main-text><tr><td>{some(1, 3)}</td><td>{some(1, 5)}</td></tr><tr><td>{some(1, 3)}</td><td>{some(1, 5)}</td></tr></table>")
            elif kind < 0.16 and rng.random() < 0.5:
                out.append(box("div", ("ad", "advert", "ad-slot", "promo", "sponsored", "banner-ad"), some(4, 20)))
            if soup and kind > 0.85:
                out.append(f"<p main-text><b>{t}<br>")
            elif kind > 0.8 and rng.random() < 0.2:
                out.append(f"<div main-text>{t}</div>")
            else:
                w = t.split()
                if len(w) > 8 and rng.random() < 0.25:
                    w[3] = f'<a href="/x">{w[3]}</a>'
                out.append(f"<p main-text>{' '.join(w)}</p>")
        return "".join(out)

    title = article[0] if len(article[0]) < 160 else article[0][:60]
    head = f"<h1 main-text>{esc(title)}</h1>" + (f'<div class="{rng.choice(("meta", "byline", "post-meta", "author"))}">{some(2, 6)}</div>' if rng.random() < 0.2 else "")
    tail = "".join(part for part, odds in (
        (box("section", ("comments", "comment-list", "responses", "reader-comments", "discussion"),
             "<h3>" + some(1, 2) + "</h3>" + "".join(f'<div class="{rng.choice(("comment", "reply", "c-item", "user-post"))}"><p>{some(5, 60)}</p></div>' for _ in range(rng.randint(1, 6)))), 0.35),
        (box("aside", ("related", "related-posts", "recommended", "more-stories", "share", "social"), links(rng.randint(2, 6))), 0.3),
        (f'<form{rng.choice(("", " class=newsletter", " id=login"))}><label>{some(1, 3)}</label><input name="q"><p>{some(4, 16)}</p></form>', 0.25),
    ) if rng.random() < odds)
    inside = rng.random() < 0.4
    body = head + paragraphs(article[len(article) > 1 and rng.random() < 0.5:]) + (tail if inside else "")
    core = rng.choice(("article", "article", "main", "div", "div", "section"))
    name = rng.choice(("", ' class="post-content"', ' id="content"', ' class="entry"', ' class="article-body"', ' id="main"', ' class="c1"', ' class="text"', ' class="wrap"'))
    middle = f"<{core}{name}>{body}</{core}>" + ("" if inside else tail)
    if rng.random() < 0.3:
        middle = f'<{rng.choice(("main", "div"))}{rng.choice(("", " id=page", " class=container"))}>' + middle + box("aside", ("sidebar", "side", "widget-area", "right-col"), links(rng.randint(2, 5)) + f"<p>{some(3, 25)}</p>" * (rng.random() < 0.5))
    top = "".join(part for part, odds in (
        (box("div", ("cookie-notice", "consent", "alert", "notice", "gdpr-banner", "warning"), f"<p>{some(5, 30)}</p>"), 0.35),
        (box("header", ("header", "masthead", "site-head", "topbar"), f"<div>{some(1, 5)}</div>"), 0.4),
        (box("nav", ("nav", "menu", "main-menu", "navbar", "breadcrumb"), links(rng.randint(2, 9))), 0.85),
        (box("div", ("ad", "ads", "advert", "promo", "sponsor", "banner"), some(3, 25)), 0.45),
    ) if rng.random() < odds)
    foot = "".join(part for part, odds in (
        (box("div", ("ad", "promo", "cookie", "popup", "newsletter"), f"<p>{some(4, 25)}</p>"), 0.25),
        (box("footer", ("footer", "foot", "site-info", "copyright", "legal"), rng.choice(("&copy; ", "", "&copy; 2024 &middot; ")) + some(2, 20) + links(3) * (rng.random() < 0.3)), 0.85),
    ) if rng.random() < odds)
    return f"<html><head><title>{esc(title)}</title></head><body>{top}{middle}{foot}</body></html>"


def _targets(nodes: list[Node], marked: list[bool]) -> list[bool]:
    """What is below a mark is main text, and what is above it holds some."""
    y = list(marked)
    for i, x in enumerate(nodes[1:], 1):
        y[i] |= y[x.parent]
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] |= y[i]
    return y


def _semantic_marks(nodes: list[Node]) -> list[bool]:
    """Text blocks in article or main elements and in none that by its tag or names is something else."""
    inside, outside = [False] * len(nodes), [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        inside[i] = inside[x.parent] or x.tag in _GOOD_TAGS
        outside[i] = outside[x.parent] or x.tag in _BAD_TAGS or _tokens(x)[1] > 0
    return [x.tag == "#text" and a and not b for x, a, b in zip(nodes, inside, outside)]


def fit(sources: list[str], seed: int = 11) -> Boosted:
    """Train on LAYOUTS pages laid out anew from the texts of ``sources``, and on those of ``sources`` with semantic elements."""
    rng, material = random.Random(seed), _material(sources)
    x, y = [], []
    pages = [(t := parse(_layout(rng, material)), ["main-text" in n.attributes for n in t]) for _ in range(LAYOUTS)]
    own = [(t, m) for t in map(parse, sources) if any(m := _semantic_marks(t))]
    for nodes, marked in pages + own:
        x.append(features(nodes))
        y.append(_targets(nodes, marked))
    return boost(np.concatenate(x), np.concatenate(y).astype(np.float64))


def fit_from(pages: DataFrame) -> Boosted:
    """Fit on the texts of at most SAMPLE_PAGES pages."""
    ids = pages.where("html IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").orderBy("page_id", "html").limit(SAMPLE_PAGES).collect()
    return fit([r["html"] for r in rows])


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    shared = pages.sparkSession.sparkContext.broadcast((model.base, model.feature, model.cut, model.leaf))

    def run(batches):
        model = Boosted(*shared.value)
        for batch in batches:
            trees = [parse(source.as_py()) for source in batch.column(2)]
            odds = model.log_odds(np.concatenate([features(t) for t in trees])) if trees else []
            texts, done = [], 0
            for t in trees:
                texts.append(main_text(t, odds[done:done + len(t)]))
                done += len(t)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
