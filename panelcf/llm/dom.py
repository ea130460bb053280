"""A small element tree from raw HTML, and the text blocks in it."""

from __future__ import annotations

import html
import re
import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())  # their content is no markup
SILENT = frozenset("template svg math object audio video canvas select button datalist".split())  # elements whose text is dropped
FOREIGN = frozenset("svg math".split())  # of these and what is in them, "/>" is the end
HTML_IN_FOREIGN = frozenset("foreignobject desc title annotation-xml".split())
BREAKOUT = frozenset("blockquote body br center dd div dl dt h1 h2 h3 h4 h5 h6 head hr img li nav ol p pre table ul".split())  # end svg and math
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike "
    "strong sub sup time tt u var ruby rb rt rp output".split()
)
CLOSES = {  # an opening tag on the left closes the open elements on the right
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPE = frozenset("ul ol dl table td th body html article section main div nav aside header footer form blockquote".split())

_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


@dataclass(slots=True)
class Node:
    tag: str  # "#text" for a block of text
    attributes: str
    parent: int
    depth: int
    at: int
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)


def _decoded(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(source)} if source else {}


def parse(source: str | None) -> list[Node]:
    """Block elements and text blocks in page order; inline elements dissolve into the blocks. Node 0 is the root.

    A text block ends where a block element begins or ends. Line breaks and images count as white space.
    Scripts, styles and controls have no text. Unclosed and misnested elements are closed the way browsers do in the common cases.
    """
    source = source or ""
    nodes = [Node("html", "", -1, 0, 0)]
    open_: list[tuple[str, int]] = [("html", 0)]  # inline elements have the number of the block they are in
    parts: list[str] = []
    linked = links = 0
    silent: list[str] = []  # an element whose text is dropped and the open ones in it

    def flush(at: int) -> None:
        nonlocal linked
        if parts:
            text = _decoded(parts)
            if text:
                up = open_[-1][1]
                nodes.append(Node("#text", "", up, nodes[up].depth + 1, at, text, min(linked, len(text))))
                nodes[up].children.append(len(nodes) - 1)
            parts.clear()
        linked = 0

    def close_to(k: int, at: int) -> None:
        nonlocal links
        for tag, _ in open_[k:]:
            links -= tag == "a"
        if any(tag not in INLINE for tag, _ in open_[k:]):
            flush(at)
        del open_[k:]

    def close_last(tags, at: int) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][0] in tags:
                return close_to(k, at)
            if open_[k][0] in SCOPE and open_[k][0] not in tags:
                return None
        return None

    done, find = 0, _TOKEN.search
    while True:
        m = find(source, done)
        if m is None:
            break
        if m.start() > done and not silent:
            part = source[done:m.start()]
            parts.append(part)
            if links:
                linked += len(part)
        done = m.end()
        shut, tag, attrs = m.group(1), m.group(2) or m.group(4), m.group(3) or m.group(5) or ""
        if silent and tag:
            name = tag.lower()
            foreign = max((k for k, t in enumerate(silent) if t in FOREIGN), default=-1)
            if foreign >= 0 and name in BREAKOUT and not HTML_IN_FOREIGN.intersection(silent[foreign:]):
                del silent[foreign:]
            elif name == "button" and name in silent:
                del silent[silent.index(name):]
            elif name in RAW and foreign < 0:
                end = _RAW_END[name].search(source, done)
                done = end.end() if end else len(source)
                continue
            if silent:
                if name not in VOID and not ((foreign >= 0 or name in FOREIGN) and attrs.rstrip().endswith("/")):
                    silent.append(name)
                continue
        elif silent and shut:
            name = shut.lower()
            if name in silent:
                del silent[len(silent) - 1 - silent[::-1].index(name):]
                continue
            if all(t != name for t, _ in open_):
                continue
            silent.clear()  # the end of an element around it
        if tag:
            tag = tag.lower()
            if tag in INLINE:
                open_.append((tag, open_[-1][1]))
                links += tag == "a"
            elif tag == "br" or tag == "img" or tag == "wbr":
                if tag != "wbr":
                    parts.append(" ")
            elif tag in SILENT:
                if tag not in FOREIGN or not attrs.rstrip().endswith("/"):
                    silent.append(tag)
                parts.append(" ")
            elif tag in RAW:
                end = _RAW_END[tag].search(source, done)
                done = end.end() if end else len(source)
                parts.append(" ")
            else:
                flush(m.start())
                if tag in VOID:
                    continue
                if tag in CLOSES:
                    close_last(CLOSES[tag], m.start())
                else:
                    close_last(("p",), m.start())
                if tag in ("html", "body") and any(t == tag for t, _ in open_):
                    continue
                flush(m.start())
                up = open_[-1][1]
                nodes.append(Node(tag, attrs, up, nodes[up].depth + 1, m.start()))
                nodes[up].children.append(len(nodes) - 1)
                if not attrs.rstrip().endswith("/") or tag in SCOPE or tag == "p":
                    open_.append((tag, len(nodes) - 1))
        elif shut:
            shut = shut.lower()
            if shut in INLINE:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] == shut:
                        links -= shut == "a"
                        del open_[k]
                        break
                    if open_[k][0] not in INLINE:
                        break
            elif shut == "br":
                parts.append(" ")
            elif shut not in VOID and shut not in RAW:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] == shut:
                        flush(m.start())
                        close_to(k, m.start())
                        break
    if not silent:
        parts.append(source[done:])
    if links and not silent:
        linked += len(source) - done
    flush(done)
    return nodes
