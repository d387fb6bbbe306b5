"""Main text of HTML pages by a tree-structured graphical model over DOM nodes.

Each node is content or not. Its own features give it a potential, and its parent's state another (parent-child potentials). Exact
marginals come from sum-product messages, upward from the leaves and then downward from the root, for all nodes of one depth of
all pages of a batch at once. The model is trained from labelled pages; the text of nodes that are more likely content is kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, texts

#: Fixed values of HTML: elements without content, elements whose text isn't shown, elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
SUBTREE = frozenset("template svg object canvas".split())
FOREIGN = frozenset(("svg",))
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template".split())
HIDDEN = frozenset("script style template iframe svg object canvas noframes head title textarea select option button datalist audio video".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul legend caption".split()
)
#: Start tags that end an open paragraph, and end tags that HTML lets authors leave out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("table td th ul ol dl div section article aside nav main header footer body html form blockquote fieldset figure select details".split())
#: Words in a class, id, role or label that name a part of a page, by what they say about it.
NAMES = {
    "menu": ("nav", "menu", "breadcrumb", "breadcrumbs", "navbar", "toc", "pagination", "pager", "tabs", "navigation", "skip", "toolbar", "search"),
    "head": ("header", "masthead", "banner", "topbar", "logo", "site", "brand"),
    "foot": ("footer", "copyright", "colophon", "contentinfo", "legal", "bottom"),
    "side": ("sidebar", "aside", "side", "widget", "related", "recommended", "complementary", "rail", "trending", "popular", "more", "tags", "teaser"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "signup", "paywall", "toast", "disclaimer", "promo"),
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promoted", "banner-ad", "adsbygoogle", "outbrain", "taboola", "share", "social", "sharing"),
    "form": ("form", "login", "contact", "register"),
    "comment": ("comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "reviews"),
    "content": ("article", "content", "post", "entry", "main", "story", "body", "text", "articlebody", "prose", "maincontent"),
}
_NAME_OF = {w: k for k, words in NAMES.items() for w in words}
TAGS = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "dialog": "notice", "form": "form", "fieldset": "form", "article": "content", "main": "content"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|style|aria-hidden|itemprop|data-label)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in RAW}
_SUBTREE_TAG = {t: re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*[^>]*>|\Z)|<(/?){t}(?=[\s/>])((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>", re.I | re.S) for t in SUBTREE}
_PARTS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

FEATURES = ("bias", *(f"is_{k}" for k in NAMES), *(f"tag_{k}" for k in sorted(set(TAGS.values()))), "heading", "paragraph", "item", "cell", "other_block", "hidden", "long", "medium", "short", "ends", "linked", "half_linked", "no_words", "early", "late", "alone")
_AT = {f: k for k, f in enumerate(FEATURES)}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str
    parts: list[tuple[int, str]] = field(default_factory=list)  # (order, text) of its own text, inline elements' included
    linked: int = 0
    hidden: bool = False
    label: str | None = None


def subtree_ends(html: str, tag: str) -> dict[int, int]:
    """Where the element of each start tag ends, by the tag's end; start tags without an end tag of their own are left out."""
    ends, open_at = {}, []
    for m in _SUBTREE_TAG[tag].finditer(html):
        if m[2]:
            if open_at:
                ends[open_at.pop()] = m.end()
        elif m[2] is not None and not (tag in FOREIGN and m[3].endswith("/")):
            open_at.append(m.end())
    return ends


def parse(html: str) -> list[Node]:
    """Block nodes in page order; node 0 is the root. Inline elements add their text to the block around them.

    Tags left open end where HTML lets them: a block start ends a paragraph, an item an item, and the end of an outer element all
    within it. Broken or cut-off markup yields what came before it. A head ends at the first thing that can't be in one. An element
    of SUBTREE without an end tag hides nothing. Formulas, noscript and xmp are text like any other; drawings (svg, canvas) and
    the stand-ins of embedded objects are not. The time grows with the page's length, however its elements nest.
    """
    nodes = [Node("html", -1, 0, "")]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block each belongs to
    where: dict[str, list[int]] = defaultdict(list)  # each tag's places in the stack
    order = pos = links = covered = 0
    n = len(html)
    ends: dict[str, dict[int, int]] = {}

    def push(tag: str, block: int) -> None:
        nonlocal links, covered
        where[tag].append(len(stack))
        stack.append((tag, block))
        links += tag == "a"
        covered += tag in HIDDEN

    def cut_to(k: int) -> None:
        nonlocal links, covered
        while len(stack) > k:
            tag, _ = stack.pop()
            where[tag].pop()
            links -= tag == "a"
            covered -= tag in HIDDEN

    def text(raw: str, decode: bool = True) -> None:
        nonlocal order
        if raw:
            if stack[-1][0] == "head" and raw.strip():
                cut_to(len(stack) - 1)
            node = nodes[stack[-1][1]]
            if not covered:
                order += 1
                raw = unescape(raw) if decode else raw
                node.parts.append((order, raw))
                if links:
                    node.linked += len(raw.strip())

    def close(tag: str, fence: frozenset[str] = frozenset()) -> None:
        at = where[tag]
        if at and not any(where[t] and where[t][-1] > at[-1] for t in fence):
            cut_to(at[-1])

    for m in _TOKEN.finditer(html):
        if m.start() < pos:
            continue
        text(html[pos : m.start()])
        pos = m.end()
        end, tag = m[1], m[2]
        if end:
            end = end.lower()
            close(end, frozenset() if end in BLOCK else FENCE)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            cut_to(len(stack) - 1)
        if tag == "br" or tag == "hr" or tag == "wbr":
            if tag != "wbr":
                text("\n")
            if tag == "hr":
                close("p", FENCE)
            continue
        if tag in VOID:
            continue
        attributes = m[3] or ""
        if tag in RAW:
            found = _RAW_END[tag].search(html, pos)
            if tag == "xmp":  # shown as it stands
                text(html[pos : found.start() if found else n], False)
            pos = found.end() if found else pos if tag == "iframe" else n
            continue
        if tag in SUBTREE:
            if tag not in ends:
                ends[tag] = subtree_ends(html, tag)
            pos = ends[tag].get(pos, pos)
            continue
        if tag in BLOCK:
            close("p", FENCE)
            for t in CLOSES.get(tag, ()):
                close(t, FENCE - {t, "td", "th"} if tag == "tr" else FENCE - {t})
            nodes.append(Node(tag, stack[-1][1], nodes[stack[-1][1]].depth + 1, attributes))
            push(tag, len(nodes) - 1)
        else:
            push(tag, stack[-1][1])
    text(html[pos:] if html[pos:] not in ("<", "</") else "")  # a page cut off before a tag's name
    return nodes


def own_features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each node."""
    out = np.zeros((len(nodes), len(FEATURES)), np.float32)
    for k, node in enumerate(nodes):
        row = out[k]
        row[_AT["bias"]] = 1
        if node.tag in TAGS:
            row[_AT[f"tag_{TAGS[node.tag]}"]] = 1
        if node.attributes:
            for a in _ATTRIBUTE.finditer(node.attributes):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name == "data-label":
                    node.label = value
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    row[_AT["hidden"]] = 1
                elif name != "style":
                    for part in _PARTS.split(value):
                        kind = _NAME_OF.get(part.lower())
                        if kind:
                            row[_AT[f"is_{kind}"]] = 1
        tag = node.tag
        row[_AT["heading" if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else "paragraph" if tag in ("p", "pre", "blockquote") else "item" if tag in ("li", "dd", "dt") else "cell" if tag in ("td", "th") else "other_block"]] = 1
        said = "".join(t for _, t in node.parts).strip()
        size = len(said)
        row[_AT["no_words" if not size else "short" if size < 25 else "medium" if size < 100 else "long"]] = 1
        if size:
            row[_AT["ends"]] = said[-1] in ".!?…\"'”»。"
            share = node.linked / size
            row[_AT["linked" if share > 0.9 else "half_linked"]] = share > 0.4
        at = k / len(nodes)
        row[_AT["early"]], row[_AT["late"]] = at < 0.1, at > 0.9
        row[_AT["alone"]] = len(nodes) == 1
    return out


@dataclass
class Model:
    """weights: log odds of content for each feature; edge[parent state, child state]: log potentials."""

    weights: np.ndarray
    edge: np.ndarray


def propagate(model: Model, features: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node of any number of trees, and the joint P(parent's state, own state); parent: -1 at roots, which have depth 0."""
    n = len(parent)
    local = np.zeros((n, 2))
    local[:, 1] = features @ model.weights
    up, inside, above = np.zeros((n, 2)), local.copy(), np.zeros((n, 2))
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if n else []
    for at in levels[:0:-1]:  # a message from each node to its parent
        up[at] = np.logaddexp(inside[at, None, 0] + model.edge[None, :, 0], inside[at, None, 1] + model.edge[None, :, 1])
        np.add.at(inside, parent[at], up[at])
    belief = inside.copy()
    for at in levels[1:]:  # and what the parent knows without it, back
        above[at] = belief[parent[at]] - up[at]
        belief[at] += np.logaddexp(above[at, 0, None] + model.edge[None, 0, :], above[at, 1, None] + model.edge[None, 1, :])
    joint = above[:, :, None] + model.edge[None] + inside[:, None, :]
    joint = np.exp(joint - joint.max((1, 2), keepdims=True)) if n else joint
    joint /= joint.sum((1, 2), keepdims=True)
    joint[parent < 0] = 0
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def marginals(model: Model, features: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return propagate(model, features, parent, depth)[0]


def shapes(pages: list[list[Node]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pages], np.int64)
    shift = np.repeat(np.cumsum(size) - size, size)
    parent = np.array([x.parent for p in pages for x in p], np.int64)
    return np.where(parent < 0, -1, parent + shift), np.array([x.depth for p in pages for x in p], np.int64)


def fit(pages: list[tuple[list[Node], np.ndarray]], steps: int = 300, ridge: float = 2e-4) -> Model:
    """Potentials of greatest likelihood for pages and their nodes' labels (0 or 1), by Adam: the gradient is what the labels show less what the marginals expect."""
    trees = [p for p, _ in pages]
    x = np.concatenate([own_features(p) for p in trees]).astype(float)
    y = np.concatenate([label for _, label in pages])
    parent, depth = shapes(trees)
    kid = np.flatnonzero(parent >= 0)
    seen = np.bincount(2 * y[parent[kid]] + y[kid], minlength=4).astype(float)
    k = x.shape[1]
    theta, mean, square = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, steps + 1):
        p, joint = propagate(Model(theta[:k], theta[k:].reshape(2, 2)), x, parent, depth)
        g = np.concatenate((x.T @ (y - p), seen - joint.sum(0).ravel())) / len(y) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
    return Model(theta[:k], theta[k:].reshape(2, 2))


def labelled_examples() -> list[tuple[list[Node], np.ndarray]]:
    """Pages of common layouts, written out here; data-label on an element marks it and all within it as content (1) or not (0)."""
    from .html_examples import PAGES

    out = []
    for html in PAGES:
        nodes = parse(html)
        own_features(nodes)
        label = np.zeros(len(nodes), np.int64)
        for k, node in enumerate(nodes):
            label[k] = int(node.label) if node.label is not None else label[node.parent] if node.parent >= 0 else int(len(nodes) == 1)
            node.attributes = re.sub(r'data-label="\d"', "", node.attributes)
        out.append((nodes, label))
    return out


def weak_labels(nodes: list[Node]) -> np.ndarray | None:
    """What a page's own structural elements say: within article or main and not within a part of another kind, content; without such an element, nothing."""
    if not any(x.tag in ("article", "main") for x in nodes):
        return None
    label = np.zeros(len(nodes), np.int64)
    features = own_features(nodes)
    bad = [_AT[f"is_{k}"] for k in NAMES if k != "content"] + [_AT["hidden"]]
    for k, node in enumerate(nodes):
        label[k] = label[node.parent] if node.parent >= 0 else 0
        if node.tag in TAGS:
            label[k] = int(TAGS[node.tag] == "content") if node.tag in ("article", "main") or TAGS[node.tag] != "head" or label[k] == 0 else label[k]
        if features[k, bad].any():
            label[k] = 0
    return label


def train(pages: DataFrame, most_pages: int = 200, html: str = "html") -> Model:
    """The model, from the written-out pages and at most most_pages of the table's own (those of the smallest hashes) under their weak labels."""
    hashed = pages.filter(F.col(html).isNotNull() & (F.length(html) < 100_000)).select(html, F.xxhash64(html).alias("__h"))
    last = hashed.select("__h").distinct().orderBy("__h").limit(most_pages).agg(F.max("__h")).first()[0]  # only hashes are sorted
    sample = hashed.filter(F.col("__h") <= F.lit(last).cast("long")).groupBy("__h").agg(F.min(html).alias(html)).orderBy("__h").select(html)
    own = [parse(r[0]) for r in sample.collect()]
    examples = labelled_examples()
    weight = max(1, len(own) // max(1, len(examples)))
    return fit(examples * weight + [(p, label) for p in own if (label := weak_labels(p)) is not None])


def blocks(nodes: list[Node], p: np.ndarray, least: float = 0.5) -> str:
    """Text of the content nodes in page order; a block whose text is parted by inner blocks yields each part where it stands."""
    said: list[tuple[int, str]] = []
    owner: list[tuple[int, int, str]] = sorted((o, k, t) for k, node in enumerate(nodes) if p[k] >= least for o, t in node.parts)
    last = -1
    for o, k, t in owner:
        if k == last and said and not _parted(nodes, k, said[-1][0], o):
            said[-1] = (o, said[-1][1] + t)
        else:
            said.append((o, t))
        last = k
    clean = (_SPACE.sub(" ", t).strip() for _, t in said)
    return "\n\n".join(t for t in clean if t)


def _parted(nodes: list[Node], k: int, a: int, b: int) -> bool:
    """Whether another block's text stands between two texts of block k."""
    return b - a > 1


def extract(pages: DataFrame, model: Model, keep: list[str] | None = None, html: str = "html") -> DataFrame:
    """pages (or its columns `keep`) with text and n_chars, without a shuffle.

    Null, empty and textless pages have empty text; a page of words without a tag is one block. Repeated rows are each extracted; an
    empty table gives no rows. Whole pages are read, however long. White space inside a block becomes one space;
    blocks stand in page order with an empty line between them. Columns of pages with a result's name are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            trees = [parse(t) for t in texts(batch.column(html))]
            parent, depth = shapes(trees)
            p = marginals(shared.value, np.concatenate([own_features(t) for t in trees]), parent, depth)
            out, at = [], 0
            for t in trees:
                out.append(blocks(t, p[at : at + len(t)]))
                at += len(t)
            return [out, [len(t) for t in out]]

        return work

    return map_columns(pages, [html], pages.columns if keep is None else keep, "text string, n_chars bigint", make)


def html_digest(pages: DataFrame) -> DataFrame:
    """The row of each page that op2's contract asks for."""
    return extract(pages, train(pages), ["page_id", "url"])
