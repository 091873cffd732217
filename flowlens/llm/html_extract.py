"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree; each has a hidden label, content or not. An element's tag, the words in its class,
id and role, the length, links and punctuation of its text are evidence for its label, and a child's label depends on
its parent's. Sum-product message passing, once upward and once downward, gives every element's exact chance of being
content; text of elements beyond one half is kept. The potentials are counts over labelled pages, made by Spark.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import small_batches

# HTML's void, inline, raw-text and self-closing elements, and words in class, id and role that tell.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
UNSEEN = set("script style template noscript title svg iframe object canvas audio video select textarea button option head".split())
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
PARTS = set("address article aside body blockquote footer form h1 h2 h3 h4 h5 h6 header main nav ol p section table ul".split())
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
TAGS = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th pre blockquote figure figcaption nav header footer aside form fieldset dialog menu address".split())
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "advert": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored dfp teaser".split(),
    "comments": "comment comments reply replies disqus discussion respond reviews".split(),
    "side": "sidebar aside side related widget recommended recommendations trending popular more share social tags complementary".split(),
    "foot": "footer foot copyright legal colophon contentinfo".split(),
    "head": "header head masthead topbar logo branding".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe paywall toast dialog warning".split(),
    "form": "form login signin signup search register contact".split(),
    "main": "article content post entry story main body text prose maincontent".split(),
}
_CUE = {w: cue for cue, ws in CUES.items() for w in ws}
_SPACE = re.compile(r"\s+")
#: Kinds of elements that decide how a label passes from parent to child.
FRAMES = set("article main section div td".split())
APART = set("nav header footer aside form fieldset dialog menu".split()) | UNSEEN
FREE = ((0.0, 0.0), (0.0, 0.0))
EDGES = [f"{a}-{b}" for a in ("apart", "frame", "text") for b in ("apart", "frame", "text")]
MARK = "data-content"


@dataclass
class Node:
    """A block element: its own runs of text, its child blocks, and both in page order."""

    tag: str
    parent: Node | None
    cues: frozenset[str] = frozenset()
    mark: str | None = None
    runs: list[list[str]] = field(default_factory=list)
    order: list[Node | list[str]] = field(default_factory=list)
    kids: list[Node] = field(default_factory=list)
    size: int = 0
    own: int = 0
    linked: int = 0
    stops: int = 0


#: Unseen elements that a part of a page can't be in, and others that an end tag somewhere further on closes.
NARROW = ("button", "option", "select", "textarea", "title")
NESTED = ("object", "svg", "template")


class Tree(HTMLParser):
    """The block elements of a page, with ends of elements supplied where authors leave them out.

    Unseen elements leave no gap in the block around them. One whose end tag is missing ends at the next block element
    or with the block it is in; head ends at body or at anything that head can't hold. All in math is part of its line.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.open: list[tuple[str, Node]] = [("html", self.root)]
        self.at: dict[str, list[int]] = {}  # places in open of each tag
        self.loose: list[int] = []  # places in open of unseen elements without an end
        self.nodes = [self.root]
        self.unseen = 0
        # a comment without an end is none: its mark goes, and what follows stays
        after = html.rfind("-->") + 3 if "-->" in html else 0
        html = html[:after] + html[after:].replace("<!--", "")
        # nor is a tag one that the page breaks off in
        last = html.rfind(">") + 1
        html = html[:last] + re.split(r"<[!?/a-zA-Z]", html[last:], maxsplit=1)[0]
        self.html, self.tags, self.lines = html, {}, None
        self.feed(html)
        self.close()
        for node in reversed(self.nodes[1:]):  # children come after their parents
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.stops += node.stops

    def _ends(self, tag: str) -> bool:
        """Whether the unseen element that starts here has an end tag of its own."""
        if self.lines is None:
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.html))]
        if tag not in self.tags:
            self.tags[tag] = tuple([m.start() for m in re.finditer(rf"<{mark}{tag}(?![\w-])", self.html, re.I)] for mark in ("", "/"))
        line, column = self.getpos()
        here = self.lines[line - 1] + column
        starts, ends = self.tags[tag]
        end, other = bisect_left(ends, here), bisect_left(starts, here + 1)
        return end < len(ends) and (tag in NESTED or other == len(starts) or ends[end] < starts[other])

    def _make_room(self, tag: str) -> None:
        """Closes what the element that starts can't be in."""
        if self.at.get("head") and (tag == "body" or tag not in IN_HEAD and self.open[-1][0] in ("head", "title")):
            self._cut(self.at["head"][-1])
        if tag in PARTS:
            self._end(NARROW, ())
        if self.loose and tag not in INLINE and tag not in VOID and tag not in UNSEEN:
            self._cut(self.loose[0])
        if tag in ENDS_P:
            self._end(("p",), ("button", "table", "td", "th"))
        if tag in ENDS:
            self._end(ENDS[tag], SCOPE[tag])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._make_room(tag)
        if tag == "html":
            self.root.mark = dict(attrs).get(MARK, self.root.mark)
        if tag == "html" or tag == "body" and self.at.get("body"):
            return
        node = self.open[-1][1]
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            elif tag == "hr" and not self.unseen:
                node.order.append([])
            return
        if tag not in INLINE and tag != "math" and not self.at.get("math"):
            values = dict(attrs)
            names = " ".join(values.get(k) or "" for k in ("class", "id", "role")).lower()
            cues = frozenset(_CUE[w] for w in re.split(r"[^a-z]+", names) if w in _CUE)
            made = Node(tag, node, cues, values.get(MARK))
            if tag not in UNSEEN:
                node.order.append(made)
            node.kids.append(made)
            self.nodes.append(made)
            node = made
        if tag in UNSEEN:
            self.unseen += 1
            if tag != "head" and not self._ends(tag):
                self.loose.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data("\n")
        elif tag not in ("html", "body"):
            self._end((tag,), () if tag in INLINE else {"td", "th", "table"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {tag})

    def _end(self, tags: Iterable[str], scope: Iterable[str]) -> None:
        """Closes the innermost open element of tags, and all inside it, unless one of scope stands between."""
        last = lambda names: max((self.at[t][-1] for t in names if self.at.get(t)), default=0)
        if (k := last(tags)) > last(scope):
            self._cut(k)

    def _cut(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for gone, _ in self.open[k:]:
            self.at[gone].pop()
            self.unseen -= gone in UNSEEN
        del self.open[k:]
        while self.loose and self.loose[-1] >= k:
            self.loose.pop()

    def handle_data(self, data: str) -> None:
        if self.unseen and self.open[-1][0] == "head" and data.strip():
            self._cut(self.at["head"][-1])
        if self.unseen:
            return
        node = self.open[-1][1]
        if not node.order or isinstance(node.order[-1], Node):
            node.order.append([])
        node.order[-1].append(data)
        bare = len(data) - data.count(" ")
        node.size += bare
        node.own += bare
        node.linked += bare if self.at.get("a") else 0
        node.stops += data.count(". ") + data.count(", ") + data.count(".\n") + (data.rstrip()[-1:] in (".", "!", "?", "…"))


def evidence(node: Node) -> list[str]:
    """The observed values of an element, one of each kind, and one for each cue."""
    seen = [f"tag={node.tag if node.tag in TAGS else 'other' if node.tag not in UNSEEN else 'unseen'}"]
    seen += [f"cue={c}" for c in sorted(node.cues)] or ["cue=none"]
    seen.append(f"size={min(6, int(math.log2(1 + node.size) / 2))}")
    seen.append("links=" + ("none" if not node.size else str(min(3, int(4 * node.linked / node.size)))))
    seen.append("stops=" + ("none" if not node.size else str(min(3, int(math.log2(1 + 200 * node.stops / node.size))))))
    seen.append(f"leaf={not node.kids}")
    return seen


@dataclass
class Potentials:
    """Log potentials: evidence -> (not content, content); for each kind of edge, child label given the parent's; the
    root's."""

    evidence: dict[str, tuple[float, float]]
    steps: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    root: tuple[float, float]

    @classmethod
    def counted(cls, counts: dict[tuple[str, int], float], prior: float = 2.0) -> Potentials:
        """From (name, label) -> count, with prior added to each."""
        total = [counts.get(("node", y), 0) for y in (0, 1)]
        row = lambda name: tuple(math.log((counts.get((name, y), 0) + prior) / (sum(counts.get((name, z), 0) for z in (0, 1)) + 2 * prior)) for y in (0, 1))
        seen = {n: tuple(math.log((counts.get((n, y), 0) + prior) / (total[y] + 10 * prior)) for y in (0, 1)) for n in {n for n, _ in counts} if "=" in n}
        return cls(seen, {edge: (row(f"{edge}>0"), row(f"{edge}>1")) for edge in EDGES}, row("root"))


def edge(node: Node) -> str:
    """The kind of a node's edge to its parent: what the parent is, and whether the child may frame others."""
    above = node.parent
    kind = "apart" if above.tag in APART or above.cues - {"main"} else "frame" if above.tag in FRAMES or above.tag in ("html", "body") else "text"
    return f"{kind}-{'frame' if node.tag in FRAMES else 'apart' if node.tag in APART else 'text'}"


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(tree: Tree, pots: Potentials) -> dict[int, float]:
    """id(node) -> the chance that it is content, by messages from the leaves up and from the root down."""
    own, up, chance = {}, {}, {}
    for node in tree.nodes:
        found = [pots.evidence[e] for e in evidence(node) if e in pots.evidence]
        own[id(node)] = [sum(f[0] for f in found), sum(f[1] for f in found)]
    for node in reversed(tree.nodes):
        b0, b1 = own[id(node)]
        for kid in node.kids:
            m0, m1 = up[id(kid)]
            b0, b1 = b0 + m0, b1 + m1
        own[id(node)] = [b0, b1]
        (s00, s01), (s10, s11) = pots.steps[edge(node)] if node.parent else FREE
        up[id(node)] = (_log_sum(s00 + b0, s01 + b1), _log_sum(s10 + b0, s11 + b1))
    down = {id(tree.root): pots.root}
    for node in tree.nodes:
        d0, d1 = down[id(node)]
        b0, b1 = own[id(node)]
        t0, t1 = d0 + b0, d1 + b1
        chance[id(node)] = math.exp(t1 - _log_sum(t0, t1))
        for kid in node.kids:
            m0, m1 = up[id(kid)]
            r0, r1 = t0 - m0, t1 - m1
            (s00, s01), (s10, s11) = pots.steps[edge(kid)]
            down[id(kid)] = (_log_sum(s00 + r0, s10 + r1), _log_sum(s01 + r0, s11 + r1))
    return chance


def _likeliest(tree: Tree, chance: dict[int, float]) -> float:
    """Just below the best chance of an element with text that isn't in a menu, form or the like, where none has one half."""
    outside = {id(tree.root): True}
    for node in tree.nodes[1:]:
        outside[id(node)] = outside[id(node.parent)] and node.tag not in APART and not node.cues - {"main"}
    best = max((chance[id(n)] for n in tree.nodes if n.own and outside[id(n)]), default=1.0)
    return best * (1 - 1e-6)


def main_text(html: str | None, pots: Potentials) -> str:
    """Blocks of content, one a line, white space in each as one space."""
    if not html:
        return ""
    tree = Tree(html)
    chance = marginals(tree, pots)
    least = 0.5 if any(chance[id(n)] > 0.5 and n.own for n in tree.nodes) else _likeliest(tree, chance)
    blocks, waiting = [], [iter(tree.root.order)]
    owners = [tree.root]
    while waiting:
        item = next(waiting[-1], None)
        if item is None:
            waiting.pop()
            owners.pop()
        elif isinstance(item, Node):
            waiting.append(iter(item.order))
            owners.append(item)
        elif chance[id(owners[-1])] > least and (text := _SPACE.sub(" ", "".join(item)).strip()):
            blocks.append(text)
    return "\n".join(blocks)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for batch in batches:
        for html in batch["html"]:
            label: dict[int, int] = {}
            for node in Tree(html or "").nodes:
                above = label[id(node.parent)] if node.parent else 0
                y = label[id(node)] = above if node.mark is None else int(node.mark == "1")
                counts.update((e, y) for e in evidence(node))
                counts["node", y] += 1
                counts[f"{edge(node)}>{above}" if node.parent else "root", y] += 1
    yield pd.DataFrame([(n, y, k) for (n, y), k in counts.items()], columns=["name", "label", "n"])


def train(labelled: DataFrame, html_col: str = "html") -> Potentials:
    """Potentials from labelled pages: data-content="1" or "0" labels an element, and what is in it up to the next one.

    What is collected has a row for each kind of evidence, whatever the number of pages.
    """
    rows = labelled.select(F.col(html_col).alias("html")).mapInPandas(_counts, "name string, label int, n long")
    return Potentials.counted({(r["name"], r["label"]): r["n"] for r in rows.groupBy("name", "label").agg(F.sum("n").alias("n")).collect()})


_READY: dict[str, Potentials] = {}


def extracted(pots: Potentials, html: Column) -> Column:
    small_batches(SparkSession.active())
    key, sent = uuid.uuid4().hex, SparkSession.active().sparkContext.broadcast(pots)

    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = sent.value
        for batch in pages:
            yield pd.Series([main_text(h, _READY[key]) for h in batch], dtype=object)

    return F.pandas_udf(extract, T.StringType())(html)


def extract(pages: DataFrame, pots: Potentials, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Defined cases: null, empty and text-free pages have an empty text; text outside any element belongs to the root; where
    no element has a chance of one half, the likeliest ones outside menus, forms and the like are kept; an open style
    swallows the page, as it does in browsers;
    ends that are missing are supplied (see Tree), so an article after an open head, button or the like is kept; a
    page of any depth or length takes time in proportion to it; a page that breaks off keeps what came before;
    repeated rows repeat; an empty table gives no rows; other columns of pages are not read.
    """
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(pots, F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
