"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: an element's place is the chain of its ancestors' styles
(tag, classes, id, noise role; digits dropped), so elements that look alike in many pages are one node. The tree decides
what goes; a page by itself decides nothing but what is never text (scripts, styles, controls, hidden elements).

A node's importance is the product of three numbers:

* entropy: for a node found in m pages, presentation importance is the entropy (to base m) of its child sequences over the
  pages; content importance is the mean, over the text blocks of its branch, of 1 - log_m(pages that have the same block
  there). Their mean is weighted by PRESENTATION (content alone for a node without element children). Menus, notices and
  adverts look the same and say the same few things on many pages; articles differ;
* prose: 1 - the share of its branch's text, over all pages, that is links;
* mark: MARKED if the node, or one that holds it, is marked as a menu, header, footer, sidebar, notice, advert, form or
  comments by its element name, role, or one of its class names or id; else 1.

Entropy and prose count from MIN_PAGES pages of the node on, else they are 1: in few pages any text is new.
A class name marks if one of its parts (cut at hyphens, underscores and capitals) is a noise word, the first doesn't deny
it (``no-comments``, ``has-sidebar``) and the last doesn't name another thing (``ad-free``, ``header-article``). A mark doesn't count on a branch that
holds MASS or more of the text of the pages it is in, if it is in MIN_PAGES pages or the host has no article or main
element outside marked branches: that branch is the page itself, whatever it is called.

A branch goes if it and all nodes below it in the host's tree have an importance below THRESHOLD and none of them is an
article or main element without a mark; inside such an element, only marked branches go. So a wrapper of menus and
articles stays, and its menus go by themselves. What is left is the text: one line for each block, in page order.

The statistics are counts by host, node and feature, combined before each shuffle, so that a host may hold any share of
the pages; pages are never grouped by host. What a branch holds, to any depth, is gathered in rounds that double the
levels covered. The hosts' low nodes are joined to the pages; the planner broadcasts them
only if their written size allows it, and else splits a large host's partition.

Edge cases: null html or html without text gives an empty text; a page cut anywhere gives what came before the cut, an
unfinished tag dropped; a null url has the empty host; repeated rows get equal texts; an empty table gives an empty
result; only id, url and html are read. Character references are decoded within one piece of text, not across tags.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import pieces, written

PRESENTATION, THRESHOLD, MIN_PAGES, MARKED, MASS = 0.3, 0.6, 10, 0.4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)

#: HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option select tbody td tfoot th thead tr".split())
#: An element of the first kind ends an open one of the second, up to a container of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
#: Elements that are never text.
CONTROLS = frozenset("audio button canvas datalist head input object select video".split())
NOISE_TAGS = frozenset("aside dialog footer form label legend menu nav search".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form navigation search".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice popup modal overlay comment comments disqus respond replies reply social share sharing related recommended newsletter subscribe subscription signup login search toolbar widget pagination pager skip".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
#: First parts of a class name that deny its noise word, and last parts that name something else.
DENYING = frozenset("has is no non not with without".split())
OTHERWISE = frozenset("article body content entry free main page post story text".split())
CONTENT_TAGS = frozenset(("article", "main"))
KEPT_TAGS = frozenset(("html", "body", "article", "main"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|\Z)", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element of a page that may be cut: a block, or an inline element that is marked; ``mark`` is its own, ``marked`` counts those that hold it."""

    __slots__ = ("tag", "style", "key", "up", "hard", "mark", "marked", "children", "inside")

    def __init__(self, tag: str, style: str, up: Node | None, hard: bool, mark: bool) -> None:
        self.tag, self.style, self.up, self.children = tag, style, up, []
        self.key = xxhash.xxh64_intdigest(style, up.key if up else 0) - (1 << 63)
        self.hard, self.mark, self.marked = hard or bool(up and up.hard), mark, mark or bool(up and up.marked)
        self.inside = bool(up and (up.inside or up.tag in CONTENT_TAGS))
        if up:
            up.children.append(style)


def _is_noise(name: str, words: frozenset[str]) -> bool:
    parts = _PART.findall(_CAMEL.sub("-", name).lower())
    return bool(parts) and not words.isdisjoint(parts) and parts[0] not in DENYING and parts[-1] not in OTHERWISE


def _marks(tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """An element's style, whether it is never text, and whether it is marked as noise."""
    style, hard, mark = tag, tag in CONTROLS, tag in NOISE_TAGS or (tag == "header" and not inside)
    if attributes and not attributes.isspace():
        names: list[str] = []
        for name, *values in _ATTR.findall(attributes):
            value = "".join(values)
            if name.lower() == "hidden":
                hard = hard or tag not in KEPT_TAGS
            elif name.lower() == "role":
                if tag not in KEPT_TAGS and (role := value.strip().lower()) in NOISE_ROLES:
                    mark, style = True, f"{style}:{role}"
            else:
                names += value.split()
        if names:
            names = sorted(_DIGITS.sub("", n) for n in names)
            style += "." + ".".join(n.lower() for n in names)
            if tag not in KEPT_TAGS and not mark:
                words = NOISE_WORDS if inside else NOISE_WORDS | HEADER_WORDS
                mark = any(_is_noise(n, words) for n in names)
    return style, hard, mark


#: A piece of a block: the node that holds it, its text with references decoded, and how many of its characters are links.
Piece = tuple[Node, str, int]


def parse(html: str) -> tuple[list[list[Piece]], list[Node]]:
    """A page's text blocks in order, each as its pieces, and all its nodes, those that hold others first."""
    root = Node("#root", "", None, False, False)
    own, nodes, blocks, run = root, [root], [], []
    stack: list[tuple[str, Node]] = [("#root", root)]
    link = 0  # place of the open link in the stack

    def close_block() -> None:
        if run:
            merged: list[Piece] = []
            for owner, text, links in run:
                if merged and merged[-1][0] is owner:
                    merged[-1] = owner, merged[-1][1] + text, merged[-1][2] + links
                else:
                    merged.append((owner, text, links))
            blocks.append(merged)
            run.clear()

    def add(raw: str) -> None:
        text = unescape(raw)
        run.append((own, text, len(text.strip()) if link else 0))

    place, end = 0, len(html)
    while place < end:
        m = _TAG.search(html, place)
        if m is None:
            add(html[place:])
            break
        if m.start() > place:
            add(html[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[4] != ">":  # the page ends inside a tag
            break
        if m[1]:
            opened = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if opened:
                if any(t in BLOCK for t, _ in stack[opened:]):
                    close_block()
                del stack[opened:]
                own = stack[-1][1]
                link = link if link < len(stack) else 0
            continue
        if tag in RAW:
            after = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, place) if not m[3].rstrip().endswith("/") or tag not in ("svg", "math") else None
            if after:
                place = after.end()
            elif not m[3].rstrip().endswith("/"):
                place = end
            continue
        if tag == "br":
            run.append((own, " ", 0))
            continue
        if tag == "body" and any(t == "body" for t, _ in stack):
            continue
        if tag in BLOCK:
            close_block()
            if tag in CLOSES_P and (opened := next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "td", "th", "button", "table")), 0)) and stack[opened][0] == "p":
                del stack[opened:]
            if tag in IMPLIED:
                ends, within = IMPLIED[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in ends:
                        del stack[i:]
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
            own = stack[-1][1]
            link = link if link < len(stack) else 0
        if tag in VOID:
            continue
        if tag == "a" and not link:
            link = len(stack)
        style, hard, mark = _marks(tag, m[3], own.inside or own.tag in CONTENT_TAGS)
        if tag in BLOCK or hard or mark:
            own = Node(tag, style, own, hard, mark)
            nodes.append(own)
        stack.append((tag, own))
    close_block()
    return blocks, nodes


def host_of(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].translate(_TO_LOWER)


def _signed(x: int) -> int:
    return x - (1 << 63)


#: Of a style node in a page: key, ancestors' keys 1, 2, 4, 8 ... levels up, flags, characters of its own text and of its
#: links, the page's characters, its child sequences, its blocks. Flags: 1 never cut, 2 inside an article or main
#: element, 4 is one itself, 8 marked, 16 it or a node that holds it marked.
Features = list[tuple[int, list[int], int, int, int, int, int, list[int]]]


def features(html: str | None) -> Features:
    blocks, nodes = parse(html or "")
    found: dict[int, tuple[Node, list[str], set[int], list[int]]] = {}
    for n in nodes:
        if not n.hard:
            found.setdefault(n.key, (n, [], set(), [0, 0]))[1].append("|".join(n.children))
    whole = 0
    for pieces_ in blocks:
        for n, text, links in pieces_:
            if not n.hard and (text := " ".join(text.split())):
                _, _, texts, size = found[n.key]
                texts.add(_signed(xxhash.xxh64_intdigest(text)))
                size[0] += len(text)
                size[1] += min(links, len(text))
                whole += len(text)
    above: dict[int, list[int]] = {}
    out = []
    for key, (n, sequences, texts, size) in found.items():  # ancestors come first
        a, above[key] = n.up and n.up.key, []
        while a is not None:
            k = len(above[key])
            above[key].append(a)
            a = above[a][k] if k < len(above[a]) else None
        flags = (n.tag in KEPT_TAGS or n.tag == "#root") | n.inside << 1 | (n.tag in CONTENT_TAGS) << 2 | n.mark << 3 | n.marked << 4
        shape = _signed(xxhash.xxh64_intdigest("/".join(sequences))) if any(sequences) else 0
        out.append((key, above[key], flags, size[0], size[1], whole, shape, sorted(texts)))
    return out


def _over_branches(nodes: DataFrame, rounds: int, values: dict[str, Callable], together: Callable) -> DataFrame:
    """``values`` of each node, summed up by their aggregates, taken ``together`` with those of all nodes below it, whatever the depth.

    Round k adds to each node what the nodes 2^k levels below it have gathered, so a tree takes the logarithm of its
    depth in rounds and each node is in one row throughout.
    """
    for k in range(rounds):
        below = nodes.where(F.size("up") > k).groupBy("host", F.col("up")[k].alias("node")).agg(*(total(v).alias(f"below_{v}") for v, total in values.items()))
        joined = nodes.join(below, ["host", "node"], "left")
        nodes = written(joined.select(*(together(F.col(c), F.col(f"below_{c}")).alias(c) if c in values else c for c in nodes.columns)), "style-branches")
    return nodes


def _under_marks(nodes: DataFrame, rounds: int) -> DataFrame:
    """``marked`` of each node taken together with those of all nodes that hold it: the same rounds, downwards."""
    for k in range(rounds):
        over = nodes.where("marked").select("host", F.col("node").alias("over"), F.lit(True).alias("held"))
        joined = nodes.withColumn("over", F.get("up", F.lit(k))).join(over, ["host", "over"], "left")
        nodes = written(joined.withColumn("marked", F.col("marked") | F.coalesce("held", F.lit(False))).drop("over", "held"), "style-marks")
    return nodes


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, node, pages, importance, marked, free, top) of each style node of each host; ``top`` is the greatest importance of the node and all nodes below it, infinite with an article or main element."""
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = ["host", "node", "up", "flags", "chars", "links", "whole", "kind", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_html", 4 << 20):
            rows: list[list] = [[] for _ in names]
            for url, html in zip(batch.column("_url").to_pylist(), batch.column("_html")):
                host = host_of(url)
                for key, up, flags, chars, links, whole, shape, texts in features(html.as_py()):
                    for column, x in zip(rows, (host, key, up, flags, chars, links, whole, 0, shape)):
                        column.append(x)
                    for t in texts:
                        for column, x in zip(rows, (host, key, up, flags, 0, 0, 0, 1, t)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    source = pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    seen = source.mapInArrow(run, "host string, node long, up array<long>, flags int, chars long, links long, whole long, kind int, feature long")
    sums = ("chars", "links", "whole")
    counts = seen.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("c"), F.first("up").alias("up"), F.first("flags").alias("flags"), *(F.sum(s).alias(s) for s in sums))
    shape, text = F.col("kind") == 0, F.col("kind") == 1
    nodes = counts.groupBy("host", "node").agg(
        F.first("up").alias("up"), F.first("flags").alias("flags"), *(F.sum(s).alias(s) for s in sums),
        F.sum(F.when(shape, F.col("c"))).alias("pages"), F.sum(F.when(shape, F.col("c") * F.log("c"))).alias("shape_log"), F.max(F.when(shape, F.col("feature") != 0)).alias("parent"),
        F.sum(F.when(text, F.col("c")).otherwise(0)).alias("texts"), F.sum(F.when(text, F.col("c") * F.log("c")).otherwise(0.0)).alias("text_log"),
    )
    base = F.log("pages")
    nodes = written(nodes.withColumn("differs", F.when(F.col("pages") > 1, F.col("texts") - F.col("text_log") / base).otherwise(F.col("texts").cast("double"))), "style-nodes")
    rounds = nodes.agg(F.max(F.size("up"))).first()[0] or 0
    # each node's blocks and characters count for it and all branches that hold it
    branch = nodes.select("host", "node", "up", *(F.col(c).alias(f"branch_{c}") for c in ("texts", "differs", "chars", "links")))
    branch = _over_branches(branch, rounds, {f"branch_{c}": F.sum for c in ("texts", "differs", "chars", "links")}, lambda own, below: own + F.coalesce(below, F.lit(0)))
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    mains = nodes.groupBy("host").agg(F.max(flag(4) & ~flag(16)).alias("has_main"))
    known, many = nodes.join(branch.drop("up"), ["host", "node"]).join(mains, "host"), F.col("pages") >= min_pages
    itself = (F.col("branch_chars") > 0) & (F.col("branch_chars") >= MASS * F.col("whole")) & (many | ~F.col("has_main"))
    known = written(known.withColumn("denied", flag(8) & itself).withColumn("marked", F.when(flag(8), ~itself).otherwise(False)), "style-mass")
    if known.where("denied").limit(1).count():
        known = _under_marks(known, rounds)
    else:  # no mark is denied anywhere: the pages' own chains hold
        known = known.withColumn("marked", flag(16))
    look = 1 - F.col("shape_log") / (F.col("pages") * base)
    content = F.when(F.col("branch_texts") > 0, F.col("branch_differs") / F.col("branch_texts")).otherwise(0.0)
    entropy = F.when(F.col("parent"), PRESENTATION * look + (1 - PRESENTATION) * content).otherwise(content)
    prose = F.when(F.col("branch_chars") > 0, 1 - F.col("branch_links") / F.col("branch_chars")).otherwise(1.0)
    importance = F.when(many & (F.col("pages") > 1), entropy * prose).otherwise(1.0) * F.when(F.col("marked"), MARKED).otherwise(1.0)
    free = ~flag(1) & (~flag(2) | F.col("marked"))
    tree = known.select("host", "node", "up", "pages", importance.alias("importance"), "marked", free.alias("free"), (flag(4) & ~F.col("marked")).alias("main"))
    # a branch is low only as a whole
    tree = written(tree.withColumn("top", F.when(F.col("main"), float("inf")).otherwise(F.col("importance"))), "style-tree")
    return _over_branches(tree, rounds, {"top": F.max}, F.greatest).drop("up", "main")


def alone(html: str | None, threshold: float = THRESHOLD) -> set[int]:
    """The low nodes of a page that is its host's only one: no entropy, marks alone."""
    tree = features(html)
    up = {key: above[0] if above else None for key, above, *_ in tree}
    held, flags = {key: 0 for key in up}, {key: f for key, _, f, *_ in tree}
    for key, _, _, chars, *_ in reversed(tree):  # those below come first
        held[key] += chars
        if up[key] is not None:
            held[up[key]] += held[key]
    has_main = any(f & 4 and not f & 16 for f in flags.values())
    marked: dict[int, bool] = {}
    for key, _, f, _, _, whole, _, _ in tree:
        own = f & 8 and (has_main or not held[key] or held[key] < MASS * whole)
        marked[key] = bool(own) or marked.get(up[key], False)
    top = {key: math.inf if flags[key] & 4 and not marked[key] else MARKED if marked[key] else 1.0 for key in up}
    for key, *_ in reversed(tree):
        if up[key] is not None:
            top[up[key]] = max(top[up[key]], top[key])
    return {key for key in up if top[key] < threshold and not flags[key] & 1 and (not flags[key] & 2 or marked[key])}


def extract(html: str | None, low: frozenset[int] | set[int] | None = None) -> str:
    """A page's text without the branches of the style nodes in ``low``; None: the page stands alone."""
    low = alone(html) if low is None else low
    cut: dict[int, bool] = {}

    def gone(n: Node) -> bool:
        chain = []
        while n is not None and id(n) not in cut:
            chain.append(n)
            n = n.up
        out = cut[id(n)] if n is not None else False
        for a in reversed(chain):
            out = cut[id(a)] = out or a.hard or a.key in low
        return out

    blocks, nodes = parse(html or "")
    texts = (" ".join("".join(text for n, text, _ in block if not gone(n)).split()) for block in blocks)
    return "\n".join(t for t in texts if t)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """id, url, text and n_chars (code points) of each page; a ``threshold`` of 0 cuts nothing."""
    low = style_tree(pages, url_col, html_col, min_pages).where(F.col("free") & (F.col("top") < threshold))
    low = written(low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low")), "low-nodes")
    host = F.translate(F.regexp_extract(F.col(url_col), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)
    kind = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_html", 4 << 20):
            sets: dict[tuple, frozenset] = {}
            texts = []
            for html, own in zip(batch.column("_html"), batch.column("low").to_pylist()):
                own = tuple(own or ())
                texts.append(extract(html.as_py(), sets.setdefault(own, frozenset(own))))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], [id_col, url_col, "text", "n_chars"])

    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), F.coalesce(host, F.lit("")).alias("host"))
    return source.join(low, "host", "left").select("_id", "_url", "_html", "low").mapInArrow(run, f"{id_col} {kind[id_col]}, {url_col} string, text string, n_chars long")
