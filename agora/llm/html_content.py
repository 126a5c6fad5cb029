"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the variables of a tree, each content or not.
Unary potentials say how likely an element's features are under either
label, parent-child potentials how labels follow each other from a parent to
a child of a certain kind. Sum-product messages, once up and once down the
tree, give every element's exact marginal; the text of an element whose
marginal reaches the threshold is content.

Potentials are smoothed counts over labelled pages. Pages that mark their
article with an ``article`` or ``main`` element label themselves: what is
inside and not under a boilerplate element is content. In every second
labelled page those elements are counted as plain ones, so that the model
also learns to find the text of pages without them. Training uses a bounded
sample of pages; extraction is one pass without a shuffle.

Forms and elements whose class, id or role names something beside the article
are suspects: a strong prior, which labels can correct, says that they are
not content. What is in them reads much like an article and goes with them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agora.llm.common import bounded_slices, map_arrow

#: Elements by what they do, and words in class, id and role
#: attributes that mark what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style noscript template svg canvas iframe object audio video map select option textarea "
    "button datalist annotation annotation-xml".split()
)
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes script style template".split())
FOREIGN = ("svg", "math")
REGIONS = frozenset(["article", "main"])
BOILERPLATE = frozenset(["nav", "footer", "aside", "header", "menu", "dialog"])
SUSPECTS = ("form", "named")
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
NAMES = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay sidebar side rail aside menu nav navbar navigation breadcrumb "
    "breadcrumbs masthead topbar footer comment comments commentlist disqus respond reply replies discussion share "
    "sharing social related recommended recommendations newsletter subscribe subscription signup login search "
    "widget widgets toolbar pagination pager copyright legal contentinfo complementary".split()
)
#: Of these, words that are also ids of an article's own sections.
SECTIONS = frozenset(
    "related legal search social notice notices side discussion alert copyright promotion rail share sharing".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    """A block element: its parent's number, the words that mark it, text
    sizes, and whether it holds a region and the page's title."""

    tag: str
    parent: int
    unseen: bool = False
    names: frozenset[str] = frozenset()
    ids: frozenset[str] = frozenset()
    suspect: str | None = None
    own: int = 0
    total: int = 0
    linked: int = 0
    in_region: bool = False
    titled: bool = False
    heads: bool = False
    holds: bool = False


class Page(HTMLParser):
    """Parses a page into block elements in document order (``nodes``; the
    first is the root) and text runs (node number, raw text)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1)]
        self.runs: list[tuple[int, list[str]]] = []
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.open: Counter = Counter()
        self.hidden, self.links, self.fresh = 0, 0, True
        self.feed(html)
        self.close()
        for node in reversed(self.nodes[1:]):
            up = self.nodes[node.parent]
            up.total += node.total
            up.linked += node.linked
            up.titled |= node.titled or node.tag == "h1"
        self._find_suspects()

    def _find_suspects(self) -> None:
        first = next((k for k, x in enumerate(self.nodes) if x.tag in HEADINGS and x.total), 0)
        while first:
            self.nodes[first].heads = True
            first = self.nodes[first].parent
        most = lambda x: 2 * x.total > self.nodes[0].total
        clear = any(x.tag in REGIONS and not (x.names | x.ids) for x in self.nodes)
        for node in reversed(self.nodes[1:]):
            node.holds |= node.tag in REGIONS and (not (node.names | node.ids) or (not clear and most(node)))
            self.nodes[node.parent].holds |= node.holds
        root = self.nodes[0]
        headless = not any(x.heads for x in self.nodes)
        for node in self.nodes[1:]:
            if node.holds or node.tag in HEADINGS:
                continue
            up = self.nodes[node.parent]
            if node.tag in REGIONS and not up.in_region:
                continue
            # What holds most of the text and its first heading is the layout,
            # unless the page says elsewhere what its article is.
            if most(node) and (node.heads or headless) and not root.holds and (node.titled or not root.titled):
                continue
            names = node.names | node.ids
            if up.in_region and 2 * node.linked < node.total:
                names = node.names | (node.ids - SECTIONS)
            if node.tag == "form":
                node.suspect = "form"
            elif names and not node.titled:
                node.suspect = "named"

    def _push(self, tag: str, number: int) -> None:
        self.stack.append((tag, number))
        self.open[tag] += 1
        self.hidden += tag in UNSEEN
        self.links += tag == "a"

    def _pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.hidden -= tag in UNSEEN
        self.links -= tag == "a"
        if tag in BLOCKS:
            self.fresh = True
        return tag

    def _close_until(self, tags: set[str], scope: set[str]) -> None:
        """Closes the innermost open element of ``tags``, unless an element
        of ``scope`` lies between."""
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close_until({"p"}, {"table", "td", "th", "button", "article", "section", "div"} - {tag} if tag != "p" else {"table", "td", "th", "button"})
        if self.stack[-1][0] == "head" and tag not in HEAD:
            self._pop()
        if tag == "body":
            self._close_until({"head"}, set())
        if tag in CLOSES:
            self._close_until(*CLOSES[tag])
        if tag in BLOCKS:
            self.fresh = True
            names, ids = (
                NAMES.intersection(t for k, v in attrs if k in which and v for t in TOKEN.findall(v.lower())) for which in (("class", "role"), ("id",))
            )
            unseen = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
            if tag not in VOID:
                parent = self.stack[-1][1]
                node = Node(tag, parent, unseen, names, ids)
                node.in_region = tag in REGIONS or self.nodes[parent].in_region
                self.nodes.append(node)
                self._push(tag, len(self.nodes) - 1)
        elif tag == "br":
            self.handle_data(" ")
        elif tag not in VOID:
            self._push(tag, self.stack[-1][1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """HTML ignores the slash of a self-closed tag, except for svg and
        math elements and what is in them."""
        self.handle_starttag(tag, attrs)
        if (tag in FOREIGN or any(self.open[t] for t in FOREIGN)) and self.stack[-1][0] == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self._pop()
        if self.hidden:
            return
        number = self.stack[-1][1]
        if self.fresh or not self.runs or self.runs[-1][0] != number:
            self.runs.append((number, []))
            self.fresh = False
        self.runs[-1][1].append(data)
        size = len(data.strip())
        node = self.nodes[number]
        node.own += size
        node.total += size
        if self.links:
            node.linked += size


def kind(node: Node, plain_regions: bool = False) -> str:
    """What an element is for, as the parent-child potentials see it."""
    if node.tag in ("#root", "html", "body"):
        return "root"
    if node.unseen or (node.tag in BOILERPLATE and not (node.tag == "header" and node.in_region)):
        return "boilerplate"
    if node.suspect:
        return node.suspect
    if node.tag in REGIONS:
        return "block" if plain_regions else "region"
    return "text" if node.tag in TEXTS else "block"


def kinds(page: Page, plain_regions: bool = False) -> list[str]:
    """The kind of each element; what boilerplate holds is boilerplate, and
    all else that a suspect holds is of the suspect's kind."""
    out: list[str] = []
    for node in page.nodes:
        own, above = kind(node, plain_regions), out[node.parent] if node.parent >= 0 else "root"
        out.append(above if above == "boilerplate" or (above in SUSPECTS and own != "boilerplate") else own)
    return out


def _bucket(size: int) -> int:
    return min(5, int(math.log2(size + 1) / 2))


def features(node: Node, plain_regions: bool = False) -> tuple[str, ...]:
    """Categorical features of an element (its kind is the edge's matter)."""
    if node.suspect:
        return ("any", *(f"name:{t}" for t in sorted(node.names | node.ids)), *(["name:form"] if node.tag == "form" else []))
    share = 4 * node.linked // max(1, node.total)
    tag = "div" if plain_regions and node.tag in REGIONS else node.tag
    return ("any", f"tag:{tag}", f"links:{share}:{_bucket(node.total)}", f"own:{_bucket(node.own)}")


def labels(page: Page) -> list[int] | None:
    """Labels of a page that marks its article, else None: 1 inside an
    article or main element, unless under a boilerplate element or under a
    suspect that holds no more than half of that element's text."""
    of = kinds(page)
    out, region, found = [0], [0], False
    for node, what in zip(page.nodes[1:], of[1:], strict=True):
        found |= what == "region"
        region.append(len(out) if what == "region" else region[node.parent])
        inside = out[node.parent] == 1 and what != "boilerplate"
        if what in SUSPECTS and of[node.parent] != what:
            inside = inside and 2 * node.total > page.nodes[region[-1]].total
        out.append(int(what == "region" or inside))
    return out if found else None


KINDS = ("boilerplate", "form", "named", "region", "text", "block", "root")

#: Weight of a label that is ruled out: no number of children outvotes it.
NEVER = 1e-200


@dataclass(frozen=True)
class Model:
    """Counts over labelled elements: ``unary[(feature, label)]`` and
    ``edge[(parent's kind, child's kind, parent's label, child's label)]``.
    ``smooth`` is added to each count. Boilerplate elements and what is in
    them are never content; elsewhere a region is likely to be, and a suspect
    is not, unless labels outweigh ``strong`` counts. The unary log-odds of an
    element, whose features say much the same, are held within ``most``."""

    unary: dict[tuple[str, int], int] = field(default_factory=dict)
    edge: dict[tuple[str, str, int, int], int] = field(default_factory=dict)
    smooth: float = 1.0
    prior: float = 50.0
    most: float = 2.0
    strong: float = 2000.0

    def __post_init__(self) -> None:
        n = [self.unary.get(("any", y), 0) + 20 * self.smooth for y in (0, 1)]
        odds = {
            f: math.log((self.unary.get((f, 1), 0) + self.smooth) / n[1]) - math.log((self.unary.get((f, 0), 0) + self.smooth) / n[0])
            for f, _ in self.unary
            if f != "any"
        }
        edges = {}
        for above in KINDS:
            for what in KINDS:
                for up in (0, 1):
                    if "boilerplate" in (above, what):
                        edges[above, what, up] = (1.0, NEVER)
                        continue
                    if above in SUSPECTS:
                        # What is in a suspect goes with it.
                        p = 1 / self.strong
                        edges[above, what, up] = (p, 1 - p) if up else (1 - p, p)
                        continue
                    if what in SUSPECTS:
                        a, b = (self.edge.get((above, what, up, y), 0) + self.smooth for y in (0, 1))
                        edges[above, what, up] = ((a + self.strong) / (a + b + self.strong), b / (a + b + self.strong))
                        continue
                    extra = self.prior if what == "region" or up else 0.0
                    a, b = (self.edge.get((above, what, up, y), 0) + self.smooth for y in (0, 1))
                    edges[above, what, up] = (a / (a + b + extra), (b + extra) / (a + b + extra))
        object.__setattr__(self, "odds", odds)
        object.__setattr__(self, "edges", edges)

    def unaries(self, page: Page) -> list[tuple[float, float]]:
        out, of = [], kinds(page)
        for node, what in zip(page.nodes, of, strict=True):
            # Only a suspect's name has a say, not the texts that it holds.
            inner = what in SUSPECTS and of[node.parent] == what
            x = 0.0 if inner else sum(self.odds.get(f, 0.0) for f in features(node)[1:])
            p = 1 / (1 + math.exp(-max(-self.most, min(self.most, x))))
            out.append((1 - p, p))
        return out

    def transitions(self, page: Page) -> list[tuple[tuple[float, float], tuple[float, float]]]:
        """P(child's label | parent's label) of each element's edge upward."""
        of = kinds(page)
        return [(self.edges[of[x.parent], k, 0], self.edges[of[x.parent], k, 1]) for k, x in zip(of, page.nodes, strict=True)]


def marginals(parents: list[int], unary: list[tuple[float, float]], edge: list) -> list[float]:
    """P(label 1) of each node of a tree by sum-product. Nodes come after
    their parents; node 0 is the root. ``edge[c][yp][yc]``: potential of c's
    edge to its parent."""
    n = len(parents)
    below = [list(u) for u in unary]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for c in range(n - 1, 0, -1):
        (a, b), e = below[c], edge[c]
        x, y = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
        up[c] = (x / (x + y), y / (x + y))
        p = below[parents[c]]
        p[0], p[1] = p[0] * up[c][0], p[1] * up[c][1]
        s = p[0] + p[1]
        if s > 0:
            p[0], p[1] = p[0] / s, p[1] / s
        else:
            p[0] = p[1] = 0.5
    out = [below[0][1] / (below[0][0] + below[0][1])]
    full = [tuple(b) for b in below]
    for c in range(1, n):
        p, e = full[parents[c]], edge[c]
        # The parent's belief without what came from c.
        x, y = p[0] / max(up[c][0], 1e-300), p[1] / max(up[c][1], 1e-300)
        a, b = below[c][0] * (e[0][0] * x + e[1][0] * y), below[c][1] * (e[0][1] * x + e[1][1] * y)
        full[c] = (a / (a + b), b / (a + b)) if a + b > 0 else (0.5, 0.5)
        out.append(full[c][1])
    return out


def main_text(html: str, model: Model, threshold: float = 0.5) -> str:
    """Content blocks of a page in page order, white space within a block
    turned into one space, joined by empty lines."""
    page = Page(html)
    found = marginals([x.parent for x in page.nodes], model.unaries(page), model.transitions(page))
    blocks = (SPACE.sub(" ", "".join(run)).strip() for number, run in page.runs if found[number] >= threshold)
    return "\n\n".join(b for b in blocks if b)


def fit(pages: DataFrame, max_pages: int = 2000) -> Model:
    """Potentials from at most ``max_pages`` pages (page_id, html), those
    with the smallest hash of their id; without labelled pages only the
    priors remain."""
    rows = pages.select(pages["html"].cast("string").alias("html"), F.xxhash64(pages["page_id"]).alias("h")).where("html is not null")
    # The ids' hashes are ranked alone; pages are read for the chosen ones.
    chosen = rows.select("h").orderBy("h").limit(max_pages)
    sample = rows.join(F.broadcast(chosen), "h", "left_semi").orderBy("h", F.xxhash64("html")).limit(max_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in bounded_slices(batches, "html"):
            for text, turn in zip(part.column("html").to_pylist(), part.column("h").to_pylist(), strict=True):
                page = Page(text)
                plain, known = turn % 2 == 1, labels(page) or []
                of = kinds(page, plain)
                for node, what, y in zip(page.nodes, of, known, strict=False):
                    # Boilerplate is ruled out, not decided by features, and
                    # what is in a suspect goes with it.
                    if what == "boilerplate" or (what in SUSPECTS and of[node.parent] == what):
                        continue
                    counts.update((f, -1, y) for f in features(node, plain))
                    if node.parent >= 0:
                        counts[f"{of[node.parent]}>{what}", known[node.parent], y] += 1
        names, ups, ys = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(ups, pa.int32()), pa.array(ys, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["name", "up", "y", "n"],
        )

    # A row per tag, bucket or kind: bounded by HTML's vocabulary.
    rows = map_arrow(sample, run, "name string, up int, y int, n long").groupBy("name", "up", "y").agg(F.sum("n").alias("n")).collect()
    return Model(
        {(r.name, r.y): r.n for r in rows if r.up < 0},
        {(*r.name.split(">"), r.up, r.y): r.n for r in rows if r.up >= 0},
    )


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``
    (page_id, url, html).

    Null or empty html gives an empty text; null ids and urls stay null;
    repeated rows each give a row; other columns are ignored; empty in,
    empty out.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "html"):
            texts = [main_text(h, model) for h in part.column("html").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out
            )

    slim = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string"))
    return map_arrow(slim, run, "page_id long, url string, text string, n_chars long")
