"""Main text of web pages by wrapper induction.

Pages of one host come from one template. Every page's tree is aligned with the tree of the
host's pivot page by simple tree matching (the largest number of pairs of equal nodes that keeps order
and parents; neighbouring siblings of the same kind are one repeated node, so that trees stay small).
The texts of each pivot node, and of each path of elements that the pivot lacks, are counted over all
pages of the host: a text that stands on nearly all pages that have the node is template, also where the node repeats
and its other texts vary; for a path that the pivot lacks, the pages must be half of the host's as well, as copies of one odd page
are no template. A page's text is all other text
within the page's article where it marks one, without parts whose element or name says menu, header,
footer, sidebar, notice, advert, form or comment. Within an article names count less (_named), and articles beside
which more text stands than in them are teasers.

Defined cases: a null or empty page has the empty text; a host of fewer than LEAST_PAGES pages, and a
null url, has no template nodes, so elements and names alone decide; where all of an article
is template (pages that are copies of each other) it stays; broken markup is read as browsers do in
the common cases: block elements close an open paragraph, an end tag closes what is open inside.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import by_text, checkpoint, table

#: A text is template if it stands in a node on this share of at least so many pages that have the node.
CONSTANT, LEAST_PAGES = 0.9, 5
#: Nodes that the pivot lacks must be on this share of the host's pages. Their numbers begin at PATHS.
COMMON, PATHS = 0.5, 1 << 30
#: Hosts whose wrappers may be sent to every task; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 20_000

#: Elements, by what they mean for text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video".split())
#: math holds its formula's characters in elements that are all inline.
MATH = "mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mfenced mover munder munderover mtable mtr mtd mspace mstyle semantics annotation"
INLINE = frozenset((MATH + " a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr").split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
DROPPED = RAW | frozenset("head nav footer aside form button select dialog menu fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
#: Of these the names of readers' comments: an article within such a part is one of them, and no article of the page.
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
#: Elements of running text: within an article no name makes them anything else.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr blockquote pre figure figcaption".split())
#: Attributes of a tag: quotes count after "=" only, and what is not ended reaches to the page's end, so that no place is read twice.
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({"|".join(sorted(RAW))})(?![\w-]){_ATTRIBUTES}(?:>|\Z).*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)""",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Words that may stand beside such a name in a class; any other word there makes it a name of something else (article-header).
BESIDE = frozenset(
    "area bar block bottom box button buttons container content fixed form global group horizontal icon icons inner item items layer left link links list main middle mobile page panel "
    "placeholder post posts primary right row secondary section site slot sticky strip text thread title top unit vertical wrap wrapper zone".split()
)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "name", "dropped", "comment", "parts", "template", "total", "linked", "shown", "holds")

    def __init__(self, tag: str, name: str = "", dropped: bool = False, comment: bool = False):
        self.tag, self.name, self.dropped, self.comment, self.template = tag, name, dropped, comment, False
        self.parts: list = []  # Nodes and strings in order

    @property
    def kind(self) -> tuple[str, str]:
        return self.tag, self.name


@lru_cache(10_000)
def _no_content(token: str) -> tuple[bool, bool]:
    """Whether a class or id names a menu, an advert and the like, by all its words; and whether it names comments."""
    pieces = [p.lower() for p in PIECE.findall(token)]
    named = any(p in DROPPED_NAMES for p in pieces) and all(p in DROPPED_NAMES or p in BESIDE for p in pieces)
    return named, named and any(p in COMMENT_NAMES for p in pieces)


def _named(attributes: str, tag: str, inside: bool) -> tuple[str, bool, bool]:
    """The element's class, for alignment, whether it is no content, and whether its names say comments. inside: it lies in an article.

    Within an article an id may be a link's target, so only classes count there, and ids for comments alone.
    """
    name, dropped, by_class, by_id, comment = "", False, False, False, False
    for m in NAMES.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            dropped = True
        elif key == "style":
            dropped |= "display:none" in value.replace(" ", "").lower()
        elif key == "role":
            dropped |= value.strip().lower() in DROPPED_ROLES
        else:
            found = [_no_content(token) for token in value.split()]
            comment |= any(c for _, c in found)
            if key == "class":
                name = value
                by_class |= any(f for f, _ in found)
            else:
                by_id |= any(f for f, _ in found)
    if inside:
        if tag in TEXTUAL:
            return name, dropped, False
        return name, dropped or by_class or comment, comment
    return name, dropped or by_class or by_id, comment


class _Open:
    """The open elements of a page: where the last one of a tag, and the last block, stands, without a search."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else 0

    def add(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, at: int) -> None:
        """Ends the element at a place and all that is open within it."""
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        while self.blocks[-1] >= at:
            self.blocks.pop()
        del self.nodes[at:]


def parse(page: str) -> Node:
    """The tree of a page, without comments, scripts and the like."""
    root = Node("#")
    open_ = _Open(root)
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            open_.nodes[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            place = open_.last(tag)
            # An inline element's end does not close a block that was opened in it.
            if place and not (tag in INLINE and open_.blocks[-1] > place):
                open_.close(place)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                open_.nodes[-1].parts.append(" " if tag == "br" else Node(tag))
            continue
        if tag in CLOSES_P:
            if (place := open_.last("p")) and open_.blocks[-1] == place:
                open_.close(place)
        elif tag in CLOSES:
            ended, within = CLOSES[tag]
            place = max(map(open_.last, ended.split()))
            if place > max(map(open_.last, within)):
                open_.close(place)
        inside = bool(open_.last("article") or open_.last("main"))
        name, dropped, comment = _named(m[4], tag, inside) if m[4] and not m[4].isspace() else ("", False, False)
        node = Node(tag, name, dropped or tag in DROPPED, comment)
        open_.nodes[-1].parts.append(node)
        if not m[4].endswith("/") or tag not in ("path", "use"):
            open_.add(node)
    if at < len(page):
        open_.nodes[-1].parts.append(page[at:])
    return root


def inner(node: Node) -> str:
    out: list[str] = []
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo.extend(reversed(n.parts))
    return "".join(out)


class Group:
    """Neighbouring siblings of one kind, aligned as one node. texts: a digest of the text of each, 0 if it has none or has parts that are judged alone."""

    __slots__ = ("kind", "nodes", "children", "texts")

    def __init__(self, nodes: list[Node]):
        self.kind, self.nodes = nodes[0].kind, nodes
        self.children: list[Group] = []
        self.texts: list[int] = []


def grouped(node: Node) -> Group:
    """The tree of groups below a node. Inline elements are text; children of a group are those of its nodes in turn."""
    top = Group([node])
    todo = [top]
    while todo:
        g = todo.pop()
        runs: list[list[Node]] = []
        for n in g.nodes:
            own, leaf = 0, True
            for part in n.parts:
                if isinstance(part, str):
                    if not part.isspace():
                        own = crc32(" ".join(part.split()).encode("utf-8", "replace"), own)
                elif part.tag in INLINE:
                    own = crc32(" ".join(inner(part).split()).encode("utf-8", "replace"), own)
                else:
                    leaf = False
                    if runs and runs[-1][0].kind == part.kind:
                        runs[-1].append(part)
                    else:
                        runs.append([part])
            g.texts.append(own if leaf else 0)
        g.children = [Group(r) for r in runs]
        todo.extend(g.children)
    return top


#: Deepest level that is aligned; groups below it have no wrapper node and are judged by their path.
DEPTH = 60
#: Pairs of children that are compared by their subtrees; longer lists of children are aligned by kind alone.
CELLS = 1 << 20


class Alignment:
    """Simple tree matching of a wrapper node [kind, children, number] and a group.

    Subtrees of equal structure share a number, and the size of a match is computed once for two numbers, so repeated
    parts cost nothing. Children that begin or end both lists with equal structure match each other, which loses no size.
    """

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.kinds: list[tuple[str, str]] = []
        self.children: list[tuple[int, ...]] = []
        self.totals: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.own: dict[int, int] = {}

    def number(self, node: Group | list, depth: int = 0) -> int:
        kind, below = ((node[0][0], node[0][1]), node[1]) if isinstance(node, list) else (node.kind, node.children)
        kids = tuple([self.number(c, depth + 1) for c in below]) if depth < DEPTH else ()
        key = (kind, kids)
        if key not in self.numbers:
            self.numbers[key] = len(self.kinds)
            self.kinds.append(kind)
            self.children.append(kids)
            self.totals.append(1 + sum(self.totals[k] for k in kids))
        self.own[id(node)] = self.numbers[key]
        return self.numbers[key]

    def size(self, p: int, q: int) -> int:
        """Nodes that a matching of two subtrees pairs at most."""
        if self.kinds[p] != self.kinds[q]:
            return 0
        if p == q:
            return self.totals[p]
        if (p, q) not in self.sizes:
            x, y = self.children[p], self.children[q]
            self.sizes[p, q] = 1 + sum(self.size(x[i], y[j]) for i, j in self.pairs(x, y))
        return self.sizes[p, q]

    def pairs(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of children that a largest matching pairs."""
        m, n = len(x), len(y)
        start = 0
        while start < min(m, n) and x[start] == y[start]:
            start += 1
        end = 0
        while end < min(m, n) - start and x[m - 1 - end] == y[n - 1 - end]:
            end += 1
        out = [(i, i) for i in range(start)] + [(m - 1 - i, n - 1 - i) for i in range(end)]
        x, y = x[start : m - end], y[start : n - end]
        if not x or not y:
            return out
        if len(x) * len(y) > CELLS:
            return out + [(i + start, j + start) for i, j in self.by_kind(x, y)]
        best, weight = self.table(x, y)
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i + start, j + start))
        return out

    def table(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        of_x, of_y = sorted(set(x)), sorted(set(y))
        sizes = np.array([[self.size(p, q) for q in of_y] for p in of_x], np.int64)
        weight = sizes[np.searchsorted(of_x, x)][:, np.searchsorted(of_y, y)]
        best = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        for i in range(len(x)):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + weight[i]), out=best[i + 1, 1:])
        return best, weight

    def by_kind(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Each child with the next one of its kind, in order."""
        out, j = [], 0
        places: dict[tuple[str, str], list[int]] = {}
        for k, q in enumerate(y):
            places.setdefault(self.kinds[q], []).append(k)
        for i, p in enumerate(x):
            of = places.get(self.kinds[p], [])
            at = bisect_left(of, j)
            if at < len(of):
                out.append((i, of[at]))
                j = of[at] + 1
        return out


def matched(a: list, b: Group) -> tuple[int, list]:
    """Size and pairs of a matching of a wrapper node and a group."""
    found = Alignment()
    size = found.size(found.number(a), found.number(b))
    pairs, todo = [], [(a, b, 0)] if size else []
    while todo:
        p, q, depth = todo.pop()
        pairs.append((p, q))
        if depth < DEPTH:
            x, y = (tuple([found.own[id(c)] for c in below]) for below in (p[1], q.children))
            todo.extend((p[1][i], q.children[j], depth + 1) for i, j in found.pairs(x, y) if found.size(x[i], y[j]))
    return size, pairs


def numbered(wrapper: list, root: Node) -> list[tuple[int, Group]]:
    """All groups of a page with the number of their wrapper node, or a number made from their path if they have none."""
    top = grouped(root)
    number = {id(g): p[2] for p, g in matched(wrapper, top)[1]}
    out, todo = [], [(top, 0)]
    while todo:
        g, above = todo.pop()
        path = crc32("\n".join(g.kind).encode("utf-8", "replace"), above)
        out.append((number.get(id(g), PATHS | path >> 2), g))
        todo.extend((c, path) for c in g.children)
    return out


def _key(number: int, text: int) -> int:
    return number << 32 | text


def skeleton(page: str) -> str:
    """A pivot page's groups as JSON: [kind, children, number]."""
    count = [0]

    def dump(g: Group, depth: int) -> list:
        number = count[0]
        count[0] += 1
        return [list(g.kind), [dump(c, depth + 1) for c in g.children] if depth < DEPTH else [], number]

    return json.dumps(dump(grouped(parse(page)), 0), separators=(",", ":"))


def blocks(root: Node) -> list[str]:
    """Texts of blocks below a node in order, without dropped and template parts."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(current)).split())
        if text:
            out.append(text)
        current.clear()

    todo: list = [root]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            current.append(n)
        elif not n.dropped and not n.template:
            block = n.tag not in INLINE
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(n.parts))
    flush()
    return out


def _within(root: Node, tag: str) -> list[Node]:
    """Outermost elements of this tag that are not in dropped parts."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == tag:
            out.append(n)
        else:
            todo.extend(p for p in reversed(n.parts) if not isinstance(p, str) and not p.dropped)
    return out


def _measure(root: Node) -> None:
    """Sets of each node: characters of its text that is not dropped (total), in links (linked), neither in links nor template (shown), and whether it holds an article."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(p for p in n.parts if not isinstance(p, str))
    for n in reversed(order):
        n.total = n.linked = n.shown = 0
        n.holds = False
        for p in n.parts:
            if isinstance(p, str):
                size = len("".join(p.split()))
                n.total += size
                n.shown += size
            else:
                n.holds |= p.holds or (p.tag in ("article", "main") and not p.dropped)
                if not p.dropped:
                    n.total += p.total
                    n.linked += p.linked
                    n.shown += p.shown
        if n.tag == "a":
            n.linked, n.shown = n.total, 0
        if n.template:
            n.shown = 0


#: Share of links from which a part is a list of them.
LINKED = 0.6


def main_text(root: Node) -> str:
    """Text of a page whose template nodes are marked."""
    _measure(root)
    todo = [root]
    while todo:  # a wrapper around the article is no header or sidebar, whatever its name, but comments are comments
        n = todo.pop()
        for p in n.parts:
            if not isinstance(p, str) and p.tag not in DROPPED:
                if p.dropped and not p.comment and p.tag not in ("article", "main") and p.holds:
                    p.dropped = False
                if not p.dropped:
                    todo.append(p)
    _measure(root)
    tops = _within(root, "main") or [root]
    articles = [a for t in tops for a in _within(t, "article")]
    own = sum(a.total - a.linked for a in articles)
    if articles and sum(t.shown for t in tops) - sum(a.shown for a in articles) > own:
        # More text lies beside the articles than in them: they are teasers, and the body has no mark.
        for a in articles:
            a.dropped = True
        articles = []
        _measure(root)
    # Of several articles, those of links are teasers of other pages.
    articles = [a for a in articles if a.linked <= LINKED * a.total] or articles
    marked = bool(articles) or tops[0] is not root
    out = [b for top in articles or tops for b in blocks(top)]
    if not out and marked:
        for top in articles or tops:
            _unmark(top)
        out = [b for top in articles or tops for b in blocks(top)]
    if not marked:
        # No part is marked as content: headers and blocks of links go.
        _drop_links(root)
        out = blocks(root)
    return "\n".join(out)


def _unmark(node: Node) -> None:
    todo = [node]
    while todo:
        n = todo.pop()
        n.template = False
        todo.extend(p for p in n.parts if not isinstance(p, str))


def _drop_links(root: Node) -> None:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "header":
            n.dropped = True
        for p in n.parts:
            if not isinstance(p, str) and p.tag not in INLINE:
                todo.append(p)
        if n.tag in ("ul", "ol", "table", "div", "p") and not any(not isinstance(p, str) and p.tag in ("div", "p", "article", "section", "h1") for p in n.parts):
            if n.linked > LINKED * n.total:
                n.dropped = True


def extract(page: str, wrapper: list | None, constant: frozenset[int]) -> str:
    root = parse(page)
    if wrapper is not None and constant:
        for number, g in numbered(wrapper, root):
            for n, text in zip(g.nodes, g.texts, strict=True):
                n.template = text != 0 and _key(number, text) in constant
    return main_text(root)


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _loaded(memory: dict, text: str | None) -> list | None:
    if text is None:
        return None
    if text not in memory:
        if len(memory) > 2000:
            memory.clear()
        memory[text] = json.loads(text)
    return memory[text]


def _joined(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages with their host's wrapper: by a broadcast of a checked number of rows, else by a shuffle, which AQE splits where a host is large."""
    return pages.join(F.broadcast(wrappers) if wrappers.count() <= BROADCAST_ROWS else wrappers, "host", "left")


def induce(pages: DataFrame) -> DataFrame:
    """host, skeleton and constant (keys of template texts) of every host with enough pages. pages: page_id, host, html."""
    # The pivot is a page of median length.
    sized = pages.select("host", "page_id", F.length("html").alias("size"), F.xxhash64("html").alias("h")).filter("host != '' AND size > 0")
    middle = sized.groupBy("host").agg(F.percentile_approx("size", 0.5).alias("middle"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    pivots = _joined(sized, checkpoint(middle)).filter("middle IS NOT NULL").groupBy("host").agg(F.min(F.struct(F.abs(F.col("size") - F.col("middle")).alias("off"), "page_id", "h")).alias("pivot"), F.first("n").alias("n"))
    pivots = checkpoint(pivots.select("host", "n", "pivot.page_id", "pivot.h"))
    few = pivots.count() <= BROADCAST_ROWS
    chosen = pages.withColumn("h", F.xxhash64("html")).join(F.broadcast(pivots.drop("n")) if few else pivots.drop("n"), ["host", "page_id", "h"]).select("host", "html").dropDuplicates(["host"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([skeleton(p) for p in batch.column(1).to_pylist()], pa.string())], names=["host", "skeleton"])

    drawn = checkpoint(chosen.mapInArrow(draw, "host string, skeleton string"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(found)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[c] for k in keys], pa.int64()) for c in (1, 2)), pa.array([found[k] for k in keys], pa.int64())],
                names=["host", "number", "text", "n"],
            )
            found.clear()
            return out

        for batch in batches:
            for name, page, skeleton_ in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "skeleton")), strict=True):
                if page and skeleton_ is not None:
                    # Each node counts once a page as text 0, and each of its texts.
                    found.update({(name, number, text) for number, g in numbered(_loaded(memory, skeleton_), parse(page)) for text in (0, *g.texts)})
                if len(found) > 50_000:
                    yield rows()
        yield rows()

    counts = _joined(pages.select("host", "html"), drawn).select("host", "html", "skeleton").mapInArrow(align, "host string, number long, text long, n long")
    counts = checkpoint(counts.groupBy("host", "number", "text").agg(F.sum("n").alias("n")).filter(F.col("n") >= CONSTANT * LEAST_PAGES))
    seen = counts.filter("text = 0").select("host", "number", F.col("n").alias("seen"))
    common = _joined(seen, pivots.select("host", F.col("n").alias("pages"))).filter((F.col("seen") >= LEAST_PAGES) & ((F.col("number") < PATHS) | (F.col("seen") >= COMMON * F.col("pages"))))
    constant = counts.filter("text != 0").join(common, ["host", "number"]).filter(F.col("n") >= CONSTANT * F.col("seen"))
    keys = constant.select("host", F.shiftleft("number", 32).bitwiseOR(F.col("text")).alias("key")).groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("constant"))
    return checkpoint(drawn.join(keys, "host"))


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    placed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "skeleton", "constant")), strict=True)
            found = [extract(p, _loaded(memory, s), frozenset(c or ())) if p else "" for p, s, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    wrapped = _joined(placed, induce(placed)).select("page_id", "url", "html", "skeleton", "constant")
    return by_text(wrapped).mapInArrow(run, f"page_id {kind}, url string, text string")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op5_page_text": op5_page_text}
ORACLES: dict[str, str] = {}
