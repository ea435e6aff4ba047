"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# --- Fixed values: element kinds, words of class names and weights of the block classifier ---
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("script style noscript template textarea title head svg math object iframe select option button".split())
HEAD_TAGS = frozenset("head base link meta title script style noscript template".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
BOILERPLATE_TAGS = {"nav": 8.0, "footer": 8.0, "aside": 8.0, "form": 8.0, "menu": 8.0, "dialog": 8.0, "header": 5.0, "fieldset": 4.0}
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices alert promo promos promotion promoted sponsor "
    "sponsored sponsors share sharing social sidebar sidebars comment comments commentlist disqus reply replies respond related recommend recommended "
    "recommendations newsletter subscribe subscription popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead "
    "pager pagination widget widgets login signup copyright disclaimer legal toolbar search tag tags skip".split()
)
OWN_BOILERPLATE = frozenset("ad ads advert advertisement sponsor sponsored promo comment comments reply replies respond related recommended teaser".split())
STATE_WORDS = frozenset("has no with without is hide show hidden open closed enabled disabled on off none wrapper wrap layout container page".split())
NAMING_WORDS = frozenset("tag category cat author format type status lang hentry".split())
CONTENT_TOKEN = re.compile(r"(?:main-?)?(?:article|content|post|entry|story|main|prose)(?:[-_]{1,2}(?:content|body|text|main|article))?|article-?body")
BOILERPLATE_ROLES = frozenset("navigation complementary contentinfo banner search".split())
LANDMARK_SHARE = 0.4  # of the page's text that an article holds where elements around it lose the weight of their class
BIAS, CONTENT_ANCESTOR, HEADING, PER_LOG_WORD, SENTENCE_END, LINKED, MARK = -1.2, 3.0, 0.8, 0.5, 0.6, -4.0, -2.0
NEXT_BLOCK, SAME_PARENT, IN_PARENT, NESTED = 0.3, 0.4, 0.5, 0.25
# ------------------------------------------------------------------------------
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?<=\s)(hidden)(?=[\s/]|$)")


def class_kind(token: str) -> str:
    """What one class or id says of its element: ``content``, ``boilerplate`` or nothing.

    The first or the last word of a compound names it (``sidebar-left``,
    ``post-comments``). Words that tell a state or a layout (``has-sidebar``,
    ``comments-open``) and names of a tag or category (``tag-news``) say nothing.
    """
    if CONTENT_TOKEN.fullmatch(token):
        return "content"
    words = [w for w in re.split(r"[-_]+", token) if w]
    if not words or STATE_WORDS.intersection(words) or (len(words) > 1 and words[0] in NAMING_WORDS):
        return ""
    return "boilerplate" if token == "side" or words[0] in BOILERPLATE_WORDS or words[-1] in BOILERPLATE_WORDS else ""


class Node:
    """An element that holds blocks: its parent, and what the classifier takes from it.

    ``tagged`` is the weight of its tag and role, ``classed`` that of its class; ``weight`` adds up
    what counts of them from the page down, once the whole page is read.
    """

    __slots__ = ("tag", "parent", "tagged", "classed", "weight", "content", "landmark", "unseen", "index", "chars")

    def __init__(self, tag: str, parent: "Node | None", attributes: str, index: int):
        self.tag, self.parent, self.index, self.chars = tag, parent, index, 0
        self.landmark = tag in ("article", "main")
        inside = parent.content if parent else False
        self.unseen = (parent.unseen if parent else False) or tag in UNSEEN_TAGS
        self.tagged = 0.0 if tag == "header" and inside else BOILERPLATE_TAGS.get(tag, 0.0)
        self.classed = self.weight = 0.0
        if attributes and tag not in ("html", "body"):
            said = {}
            for name, value, bare in _ATTRIBUTE.findall(attributes):
                said[(name or bare).lower()] = value.strip("\"'").lower()
            tokens = " ".join(said.get(k, "") for k in ("class", "id")).split()
            kinds = {class_kind(t) for t in tokens}
            if self.landmark:
                if any(OWN_BOILERPLATE.intersection(re.split(r"[-_]+", t)[:1]) and class_kind(t) for t in tokens):
                    self.classed, self.landmark = 8.0, False
            elif "content" in kinds:
                self.landmark = True
            elif "boilerplate" in kinds:
                self.classed = 8.0
            if said.get("role") in BOILERPLATE_ROLES:
                self.tagged += 8.0
            elif said.get("role") in ("main", "article"):
                self.landmark = True
            style = said.get("style", "").replace(" ", "")
            if "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
                self.unseen = True
        self.content = inside or self.landmark


def weigh(nodes: list[Node], blocks: list[tuple[str, float, Node]]) -> None:
    """The weight of every element, from those around it down.

    A class of an element around an article that holds much of the page's text
    describes the page's layout, and does not count.
    """
    for text, _, node in blocks:
        node.chars += len(text)
    for node in reversed(nodes):  # a parent stands before its children
        if node.parent is not None:
            node.parent.chars += node.chars
    around: set[int] = set()
    for node in nodes:
        if node.landmark and node.chars >= LANDMARK_SHARE * max(nodes[0].chars, 1):
            above = node.parent
            while above is not None and above.index not in around:
                around.add(above.index)
                above = above.parent
    for node in nodes:
        node.weight = (node.parent.weight if node.parent else 0.0) + node.tagged + (0.0 if node.index in around else node.classed)


def blocks(page: str) -> tuple[list[tuple[str, float, Node]], list[Node]]:
    """``([(text, share of it in links, holding element)], elements)`` in page order."""
    root = Node("html", None, "", 0)
    nodes, out, stack, depth = [root], [], root, 0
    text: list[tuple[str, bool]] = []

    def flush() -> None:
        whole, holder = " ".join("".join(t for t, _ in text).split()), stack
        while _inline(holder.tag):
            holder = holder.parent
        if whole and not holder.unseen:
            linked = sum(len("".join(t.split())) for t, in_link in text if in_link)
            out.append((whole, linked / max(sum(len("".join(t.split())) for t, _ in text), 1), holder))
        text.clear()

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        nonlocal stack
        node = stack
        while node.parent is not None and node.tag != tag and node.tag not in within:
            node = node.parent
        if node.tag == tag and node.parent is not None:
            stack = node.parent

    def inline_open(tag: str) -> Node | None:
        """The innermost of the inline elements around this place, up to their block, that has the tag."""
        node = stack
        while _inline(node.tag) and node.tag != tag:
            node = node.parent
        return node if node.tag == tag else None

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            piece = page[at : m.start() if m else end]
            if stack.tag == "head" and piece.strip():
                stack = stack.parent
            if not stack.unseen:
                text.append((html.unescape(piece), depth > 0))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if stack.tag == "head" and not closing and tag not in HEAD_TAGS:
            stack = stack.parent  # the end tag of a head may be left out
        if not closing and tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "a":
            depth = max(depth - 1, 0) if closing else 1
        if _inline(tag):
            around = inline_open(tag)
            if closing:
                stack = around.parent if around else stack
                continue
            if around is None and not _hides(attributes):
                continue
        else:
            flush()
            depth = 0 if tag in BLOCK_TAGS and tag != "br" else depth
        if closing:
            close(tag)
        elif tag not in VOID_TAGS:
            if tag in BLOCK_TAGS:
                close("p", tuple(BLOCK_TAGS - {"p"}))
            if tag in CLOSED_BY_SAME:
                for same in {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}:
                    close(same, CLOSED_BY_SAME[tag])
            if not (attributes.endswith("/") and tag not in BLOCK_TAGS):
                stack = Node(tag, stack, attributes, len(nodes))
                nodes.append(stack)
    flush()
    weigh(nodes, out)
    return out, nodes


def _inline(tag: str) -> bool:
    return tag not in BLOCK_TAGS and tag not in UNSEEN_TAGS


def _hides(attributes: str) -> bool:
    """Whether an inline element is kept from view, so that it counts as an element of its own."""
    return "hidden" in attributes or ("display" in attributes and "none" in attributes)


def evidence(text: str, linked: float, node: Node) -> float:
    """Log-odds of a block being content, from itself and the elements that hold it."""
    words = text.count(" ") + 1
    total = BIAS + PER_LOG_WORD * min(words, 80).bit_length() + LINKED * linked - node.weight
    total += CONTENT_ANCESTOR * node.content
    total += HEADING * (node.tag in ("h1", "h2", "h3") and node.content)
    total += SENTENCE_END * (text[-1] in ".!?…:\"'”»")
    total += MARK * ("©" in text or "all rights reserved" in text.lower())
    return total


def max_flow_source_side(n: int, edges: list[tuple[int, int, float, float]], source: int, sink: int) -> list[bool]:
    """Dinic's maximum flow; whether each vertex stays on the source's side of the least cut.

    ``edges`` are ``(u, v, capacity, capacity back)``.
    """
    to: list[int] = []
    room: list[float] = []
    adjacent: list[list[int]] = [[] for _ in range(n)]
    for u, v, forth, back in edges:
        adjacent[u].append(len(to))
        to.append(v)
        room.append(forth)
        adjacent[v].append(len(to))
        to.append(u)
        room.append(back)
    tiny = 1e-9
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in adjacent[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        nxt, path, u = [0] * n, [], source
        while True:
            if u == sink:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                while path and room[path[-1]] <= tiny or path and any(room[e] <= tiny for e in path):
                    u = to[path.pop() ^ 1]
                if not path:
                    u = source
                continue
            while nxt[u] < len(adjacent[u]):
                e = adjacent[u][nxt[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if not path:
                    break
                u = to[path.pop() ^ 1]
                nxt[u] += 1
                continue
            path.append(e)
            u = to[e]


def content_blocks(page: str) -> list[str]:
    """The texts of the blocks that the least cut leaves with the content.

    Each block's log-odds are its capacity to the source (content) or the sink
    (boilerplate). Smoothness edges join a block to the next one, stronger where
    both have one parent, and to its element; elements are joined to theirs, so
    that blocks near each other in the document tree tend to be labelled alike.
    """
    found, nodes = blocks(page)
    if not found:
        return []
    n = len(found)
    used: dict[int, int] = {}
    edges: list[tuple[int, int, float, float]] = []
    for i, (text, linked, node) in enumerate(found):
        score = evidence(text, linked, node)
        edges.append((n, i, score, 0.0) if score > 0 else (i, n + 1, -score, 0.0))
        if i:
            w = NEXT_BLOCK + SAME_PARENT * (found[i - 1][2].parent is node.parent)
            edges.append((i - 1, i, w, w))
        below, weight = i, IN_PARENT
        while node is not None:
            known = node.index in used
            here = used.setdefault(node.index, n + 2 + len(used))
            edges.append((below, here, weight, weight))
            if known:
                break
            below, weight, node = here, NESTED, node.parent
    side = max_flow_source_side(n + 2 + len(used), edges, n, n + 1)
    return [text for i, (text, _, _) in enumerate(found) if side[i]]


def main_text(page: str | None) -> str:
    return " ".join(content_blocks(page)) if page else ""


def extract_main_text(pages: DataFrame, html_col: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col``; an input column named ``output`` is replaced.

    Character references are decoded; white space inside a block becomes one
    space; blocks are trimmed and joined by one space in page order. A null or empty page, or one
    without content, gives an empty text. Markup that is cut off or not closed
    is read as far as it goes.
    """

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text)

    return pages.withColumn(output, extracted(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))))
