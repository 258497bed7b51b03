"""Main text of HTML pages by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf tag path
(block-level tags and their classes) and the share of its text that is in links. For
every path the text length, punctuation and linked text are added up over all its
blocks; length and punctuation for each block are the path's ratios. In page order they
are smoothed with a Gaussian and fused: length times punctuation, times the share of
text that is no link. A path is selected if its own fused ratios pass their standard
deviation over all paths, and their mean in page order, smoothed, half of that. The
content node is the lowest container that holds nearly all selected text, or the one
article in it.

Of the blocks of the content node, those of selected paths stay, and what stands
between them unless it is links: short paragraphs, list items, cells, headings. Before
the first of them only headings stay, and after the last one what is no part of the page
of its own; text before the only main heading goes. In an article or main element what
stands before the first and after the last selected block stays as well, but for links.
So a menu, a credit line or a list of links needs no name to go.

Elements that by tag or role are menus, headers, footers, side bars, dialogs or forms
never count, nor do those with a class or id that names nothing else (``CERTAIN_WORDS``).
Other names (``DOUBTFUL_WORDS``) are a hint: within an article or main element, what
carries one stays if the tag paths of at least half its text reach a share of the other
content's ratio, and else goes; beside one it goes.

Character references are decoded, white space within a block becomes one space,
blocks are joined by a blank line. Pages are handled one by one in a stream.

Defined results: null or empty html gives an empty text; broken markup is read
as browsers do where it matters (unclosed paragraphs and list items, unclosed
formatting, a tag cut off at the end); if no path passes, all blocks outside
boilerplate count; repeated pages get a row each.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+)|<(?=/?[a-zA-Z])[^>]*\Z|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "video", "audio", "canvas",
}
#: A start of one of these closes an open element of the other, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
CONTAINERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "select", "menu", "td"}
DROPPED_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "search", "fieldset", "video", "audio", "canvas", "legend", "optgroup", "option"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
CERTAIN_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "paywall", "popup", "replies", "respond", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar", "topbar",
}
#: Words that name a part of an article as often as something beside it; inside one, its tag paths decide.
DOUBTFUL_WORDS = {
    "alert", "banner", "discussion", "notice", "notices", "overlay", "pager", "promo", "promotion", "recommended", "related", "share", "sharing", "skip", "social", "subscription", "teaser", "widget",
    "widgets",
}
HEADER_WORDS = {"header", "masthead"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Marks that end something, not those within names and numbers.
PUNCTUATION = re.compile(r"[.,;:!?](?!\S)|[。，、；：！？…]")
#: Elements that are parts of a page and not of a text.
PARTS = {"div", "section", "article", "center", "details", "table", "td", "address"}
NOT_CLASS_TESTED = {"html", "body", "main", "article", *HEADINGS}
SMOOTHING, SHARE, HOLDS, DOUBT = 1.0, 0.5, 0.85, 0.25
#: Share of a path's text in links from which it is a list of links; share of the selected text that makes an only article the content.
LINKS, ARTICLE = 0.6, 0.3
#: A text, its innermost block-level element, and how many of its characters are in links.
Block = tuple[str, "Node", int]


class Node:
    __slots__ = ("tag", "path", "parent", "dropped", "header", "doubt", "within")

    def __init__(self, tag: str, label: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.path = f"{parent.path}/{label}" if parent else label
        self.dropped = parent.dropped if parent else False
        self.header = parent.header if parent else False
        self.doubt = parent.doubt if parent else None
        self.within = tag in ("article", "main") or (parent.within if parent else False)


def _open(tag: str, attributes: str, parent: Node | None) -> Node:
    label, drop, header, doubt = tag, tag in DROPPED_TAGS, tag == "header", False
    if attributes and tag not in ("html",):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                value = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value)  # adBox
            value = value.lower()
            if name in ("class", "id"):
                if name == "class" and value:
                    label = f"{tag}.{value.split()[0]}" if value.split() else tag
                if tag not in NOT_CLASS_TESTED:
                    words = set(re.split(r"[\s_-]+", value))
                    drop |= bool(words & CERTAIN_WORDS)
                    doubt |= bool(words & DOUBTFUL_WORDS)
                    header |= bool(words & HEADER_WORDS)
            elif name == "role":
                drop |= value in DROPPED_ROLES
            elif name == "hidden":
                drop = True
            elif name == "aria-hidden":
                drop |= value == "true"
            else:
                drop |= bool(re.search(r"display\s*:\s*none", value))
    node = Node(tag, label, parent)
    node.dropped |= drop or (doubt and not node.within)
    node.header |= header
    if doubt and node.doubt is None:
        node.doubt = node
    return node


def blocks(page: str) -> list[Block]:
    """Text blocks of the page in order."""
    node = Node("html", "html", None)
    out: list[Block] = []
    held: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, node, min(len(" ".join(entities.unescape("".join(linked)).split())), len(text))))
            held.clear()
            linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            held.append(m[4])
            if in_link:
                linked.append(m[4])
            continue
        if m[2] is None:
            if m[0] == "<":
                held.append("<")
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in ("br", "hr", "img"):
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            in_link = not closing
            linked.append(" ")
        if tag in VOID or tag not in BLOCK:
            continue
        flush()
        if closing:
            up = node
            while up is not None and up.tag != tag:
                if up.tag in ("body", "html"):
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None and tag not in ("html", "body"):
                node = up.parent
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while node.parent is not None:
                    node = node.parent
                node = _open("body", m[3], node)
            continue
        if tag == "head":
            node = _open(tag, "", node)
            continue
        if node.tag == "head":  # content before a body tag
            node = node.parent
        if tag in CLOSES:
            up = node
            while up is not None and up.tag not in CLOSES[tag] and (up.tag not in CONTAINERS or up.tag in ("td",)):
                up = up.parent
            while up is not None and up.tag in CLOSES[tag]:
                node = up.parent
                up = node
        else:  # a block ends an open paragraph
            up = node
            while up is not None and up.tag not in ("p", "button") and up.tag not in CONTAINERS:
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        node = _open(tag, m[3], node)
    flush()
    return out


def ratios(found: list[Block]) -> dict[str, tuple[float, float, float]]:
    """Text length and punctuation per block of each path, and the share of its text in links."""
    sums: dict[str, list[int]] = {}
    for text, node, linked in found:
        s = sums.setdefault(node.path, [0, 0, 0, 0])
        for i, x in enumerate((len(text), len(PUNCTUATION.findall(text)), linked, 1)):
            s[i] += x
    return {p: (a / n, b / n, c / a) for p, (a, b, c, n) in sums.items()}


def fused(length, marks, links):
    return length * (1 + marks) * (1 - links)


def selected(found: list[Block], smoothing: float = SMOOTHING, share: float = SHARE) -> list[bool]:
    """Which blocks lie on paths whose fused ratios pass the deviation over all paths, and smoothed ones a share of it."""
    if not found:
        return []
    by_path = ratios(found)
    values = np.array([by_path[node.path] for _, node, _ in found])
    radius = int(math.ceil(2 * smoothing))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / smoothing) ** 2)
    kernel /= kernel.sum()
    smooth = [np.convolve(np.pad(values[:, i], radius, mode="edge"), kernel, mode="valid") for i in range(3)]
    value = fused(*smooth)
    total: dict[str, list[float]] = {}
    for (_, node, _), f in zip(found, value, strict=True):
        total.setdefault(node.path, []).append(f)
    mean = {p: sum(v) / len(v) for p, v in total.items()}
    # each path counts once: many paragraphs are one path
    cut = float(np.std([fused(*r) for r in by_path.values()])) if len(by_path) > 1 else 0.0
    return [mean[node.path] > share * cut and fused(*by_path[node.path]) > cut for _, node, _ in found]


def settled(found: list[Block], share: float = DOUBT) -> list[Block]:
    """The blocks without those of doubtful elements whose paths read like links and not like the content."""
    sure = [fused(len(t), len(PUNCTUATION.findall(t)), 0) for t, node, _ in found if node.doubt is None]
    if len(sure) == len(found):
        return found
    cut = share * sum(sure) / max(len(sure), 1)
    by_path = ratios([b for b in found if b[1].doubt is not None])
    text: dict[int, list[int]] = {}
    for t, node, _ in found:
        if node.doubt is not None:
            held = text.setdefault(id(node.doubt), [0, 0])
            held[fused(*by_path[node.path]) >= cut] += len(t)
    return [b for b in found if b[1].doubt is None or text[id(b[1].doubt)][1] >= text[id(b[1].doubt)][0]]


def content_node(found: list[Block], chosen: list[bool], holds: float = HOLDS) -> Node | None:
    """The lowest container that holds nearly all selected text; the one article in it, if there is one."""
    children: dict[int, dict[int, Node]] = {}
    weight: dict[int, int] = {}
    articles: dict[int, Node] = {}
    total, root = 0, None
    for (text, node, _), on in zip(found, chosen, strict=True):
        if not on:
            continue
        total += len(text)
        up = node
        outer = None
        while up is not None:
            weight[id(up)] = weight.get(id(up), 0) + len(text)
            if up.tag == "article":
                outer = up
            if up.parent is not None:
                children.setdefault(id(up.parent), {})[id(up)] = up
            else:
                root = up
            up = up.parent
        if outer is not None:
            articles[id(outer)] = outer
    if len(articles) == 1:
        only = next(iter(articles.values()))
        if weight[id(only)] >= ARTICLE * total:
            return only
    at = whole = root
    while at is not None and at.tag not in ("article", "main"):
        best = max(children.get(id(at), {}).values(), key=lambda c: weight[id(c)], default=None)
        if best is None or best.tag not in ("div", "section", "article", "main", "body", "table", "tbody", "tr", "td", "center") or weight[id(best)] < holds * total:
            return whole
        at = best
        if weight[id(at)] == total:
            whole = at
    return at


def kept(found: list[Block], chosen: list[bool], root: Node | None) -> list[str]:
    """The texts of the content node that stay."""

    def within(node: Node | None) -> bool:
        while node is not None and node is not root:
            node = node.parent
        return node is not None

    inside = [within(node) for _, node, _ in found]
    by_path = ratios([b for b, within_root in zip(found, inside, strict=True) if within_root])
    links = [inside[i] and by_path[node.path][2] >= LINKS or linked >= LINKS * len(text) for i, (text, node, linked) in enumerate(found)]
    core = [i for i, on in enumerate(chosen) if on and inside[i]] or [i for i, on in enumerate(inside) if on]
    if not core:
        return []
    named = root is not None and root.tag in ("article", "main")
    titles = [i for i, (_, node, _) in enumerate(found) if node.tag == "h1" and inside[i]]
    if len(titles) == 1 and not named:  # the title comes before the text, unless most text comes before it
        after = [i for i in core if i >= titles[0]]
        if sum(len(found[i][0]) for i in after) * 2 > sum(len(found[i][0]) for i in core):
            core = after
    first, last = core[0], core[-1]
    heading = first
    while heading and found[heading - 1][1].tag in HEADINGS:
        heading -= 1
    holders = set()
    for i in core:
        up = found[i][1]
        while up is not None and id(up) not in holders:
            holders.add(id(up))
            up = up.parent

    def beside(node: Node) -> bool:
        """Whether the block stands in a part of the content node that has no selected text."""
        while node is not root:
            if node.tag in PARTS and id(node) not in holders:
                return True
            node = node.parent
        return False

    out = []
    for i, (text, node, _) in enumerate(found):
        if inside[i] and first <= i <= last:
            stays = chosen[i] or not links[i]
        elif heading <= i < first:
            stays = True
        elif named and inside[i]:
            stays = not links[i] or node.tag in HEADINGS and i < first
        elif inside[i] and i > last:
            stays = not links[i] and not beside(node)
        else:
            stays = i < first and node.tag == "h1"
        if stays:
            out.append(text)
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = []
    for text, node, linked in blocks(page or ""):
        if node.dropped:
            continue
        if node.header:
            inside, up = False, node.parent
            while up is not None:
                inside |= up.tag in ("article", "main")
                up = up.parent
            if not inside or node.tag not in HEADINGS:
                continue
        found.append((text, node, linked))
    found = settled(found)
    if not found:
        return ""
    chosen = selected(found)
    if not any(chosen):
        chosen = [True] * len(found)
    return "\n\n".join(kept(found, chosen, content_node(found, chosen)))


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RESULT)


def op6_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
