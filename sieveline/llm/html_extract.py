"""Main-text extraction by tree scoring.

The page becomes a tree of block elements; inline elements are transparent.  Every paragraph passes points for its length
and commas to its ancestors, the parent in full, the next half, further ones less.  A container's points are discounted by
its link density and weighed by what its tag and class say; the best container is kept.  If it lies in an article, a main
element or a container named like one, all of that is kept but its mostly linked parts; else siblings that score near it or
read like its paragraphs, and bare text beside it.  Navigation, headers, footers, asides, forms, scripts, adverts, notices and reader comments
are pruned before.

Defined results: a null or empty page, and one without text outside of pruned parts, gives an empty string; unclosed and
stray tags are closed as browsers do for paragraphs and list items; white space inside a block is one space; blocks are
joined by one newline; repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden|aria-modal)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PRUNED = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "head", "fieldset", "option", "datalist", "audio", "video", "math"} | RAW
BLOCKS = {"html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "center", "hgroup"}
#: A start tag of the key closes an open element of the value, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NO_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "address", "hr", "details", "center"} | {"nav", "header", "footer", "aside", "form", "menu", "fieldset"}
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|promo|promoted|sponsor|sponsored|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|comments?|respond|replies|discussion|disqus|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|tags|copyright|legal|disclaimer|skip|hidden|search|rating)(?=$|[\s_-])", re.I)
#: Names that tell what a container's surroundings have, not what it is.
LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+", re.I)
GOOD = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
WEIGHT = {"article": 30, "main": 20, "div": 5, "section": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5}


class Node:
    __slots__ = ("bonus", "kids", "linked", "points", "prune", "size", "tag", "up")

    def __init__(self, tag: str, up: Node | None, prune: bool, bonus: float) -> None:
        self.tag, self.up, self.prune, self.bonus = tag, up, prune, bonus
        self.kids: list[Node | tuple[str, bool]] = []
        self.points, self.size, self.linked = 0.0, 0, 0


def _judge(tag: str, attrs: str) -> tuple[bool, float]:
    """Whether the element is pruned, and what its tag and names add to its points."""
    bonus, prune = float(WEIGHT.get(tag, 0)), tag in PRUNED
    if attrs and not prune:
        for name, value in NAMES.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                prune = True
            elif name == "role" and value.lower() in BAD_ROLE:
                prune = True
            elif name in ("class", "id"):
                value = LAYOUT.sub("", value)
                if BAD.search(value) and tag not in ("html", "body", "article", "main"):
                    prune = True
                elif GOOD.search(value):
                    bonus += 15
    return prune, bonus


def parse(page: str) -> Node:
    root = here = Node("html", None, False, 0)
    inline: list[tuple[str, Node]] = []  # open pruned inline elements
    links, last = 0, 0
    match = TOKEN.search
    while True:
        m = match(page, last)
        text = page[last : m.start() if m else len(page)]
        if text and not inline:
            here.kids.append((text, links > 0))
        if not m:
            return root
        last = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:  # end tag
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS or tag in PRUNED:
                x = here
                while x is not root and x.tag != tag:
                    x = x.up
                if x is not root:
                    here = x.up
                    links, inline = 0, []
            elif inline and inline[-1][0] == tag:
                inline.pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, last)
            if tag == "noscript" or not m[0].endswith("/>"):
                last = len(page) if not end else (page.find(">", end.end()) + 1 or len(page))
            here.kids.append((" ", False))
            continue
        if tag == "a":
            links = 1
        elif tag == "br" or tag == "hr":
            here.kids.append((" ", False))
        if tag in NO_P:
            x = here
            while x is not root and x.tag != "p" and x.tag not in ("td", "th", "table"):
                x = x.up
            if x.tag == "p":
                here, links, inline = x.up, 0, []
        if tag in CLOSES:
            x = here
            while x is not root and x.tag not in CLOSES[tag] and x.tag not in ("ul", "ol", "dl", "table"):
                x = x.up
            if x.tag in CLOSES[tag]:
                here, links = x.up, 0
        if tag in VOID:
            continue
        prune, bonus = _judge(tag, m[3])
        if tag in BLOCKS or tag in PRUNED:
            if tag in ("html", "body") and (tag == "html" or any(isinstance(k, Node) and k.tag == "body" for k in root.kids)):
                continue
            if tag != "head" and here.tag == "head":
                here = here.up if tag == "body" or tag in BLOCKS else here
            if m[0].endswith("/>") and tag in ("svg", "canvas"):
                continue
            child = Node(tag, here, prune, bonus)
            here.kids.append(child)
            here = child
        elif prune and not m[0].endswith("/>"):
            inline.append((tag, here))


def _runs(node: Node) -> Iterator[tuple[str, int] | Node]:
    """The node's own text, runs between child blocks as one block each, and its children, in page order."""
    run: list[str] = []
    linked = 0
    for k in [*node.kids, None]:
        if isinstance(k, tuple):
            run.append(k[0])
            linked += len(k[0].strip()) if k[1] else 0
            continue
        if run:
            if text := SPACE.sub(" ", html.unescape("".join(run))).strip():
                yield text, linked
            run, linked = [], 0
        if k is not None:
            yield k


def _score(root: Node) -> list[Node]:
    """Gives every kept node its size and points; the nodes that got points."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(k for k in n.kids if isinstance(k, Node) and not k.prune)
    for n in reversed(order):
        for r in _runs(n):
            if isinstance(r, Node):
                if not r.prune:
                    n.size += r.size
                    n.linked += r.linked
                continue
            n.size += len(r[0])
            n.linked += min(r[1], len(r[0]))
            points = (1 + min(len(r[0]) / 100, 30) + r[0].count(",")) * (1 - min(r[1], len(r[0])) / len(r[0]))
            x, level = (n.up or n, 0) if n.tag in ("p", "pre", "td", "li", "dd", "dt", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") else (n, 0)
            while x is not None:
                x.points += points / (1, 2, 6, 9)[level] if level < 4 else points / (3 * level)
                x, level = x.up, level + 1
    return [n for n in order if n.points > 0]


def _text(node: Node, out: list[str], most: float = 2.0) -> None:
    """The text below ``node``, without parts of a link density of ``most`` or more."""
    stack: list[Iterator[tuple[str, int] | Node]] = [_runs(node)]
    while stack:
        for r in stack[-1]:
            if isinstance(r, tuple):
                out.append(r[0])
            elif not r.prune and r.linked < most * max(1, r.size):
                stack.append(_runs(r))
                break
        else:
            stack.pop()


def extract(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    root = parse(page or "")
    scored = _score(root)
    if not scored:
        return ""
    density = lambda n: n.linked / n.size if n.size else 0.0
    value = lambda n: (n.points + (n.bonus if n.size else 0)) * (1 - density(n))
    best = max(scored, key=value)
    out: list[str] = []
    if best.up is None:
        _text(best, out)
        return "\n".join(out)
    whole = best.up
    while whole is not None and not (whole.tag in ("article", "main") or whole.bonus - WEIGHT.get(whole.tag, 0) >= 15 and whole.tag not in ("html", "body")):
        whole = whole.up
    if whole is not None:
        _text(whole, out, 0.5)
        return "\n".join(out)
    for k in _runs(best.up):
        if k is best:
            _text(best, out)
        elif isinstance(k, tuple) and k[1] < 0.25 * len(k[0]):
            out.append(k[0])
        elif isinstance(k, Node) and not k.prune and k.size:
            near = k.points > 0 and value(k) >= max(1.0, 0.2 * value(best)) and density(k) < 0.5
            reads = k.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") and density(k) < 0.25
            if near or reads:
                _text(k, out)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
