"""Main text of web pages by wrapper induction.

The pages of a host are aligned with a wrapper, a DOM tree of the blocks that its pages have in common: simple tree
matching pairs nodes with equal labels so that as many as possible are paired in order.  Statistics over all pages of the host then decide
what each node of the wrapper is:

- template: a text that stands at a node on most pages that have the node; inside the content only where more of its text varies than is shared, as
  pages that share most of their article are copies of it, however many they are;
- beside the text: nodes marked so by tag or role; nodes whose class or id says so, where they hold a small share of the host's text (inside an
  article only words for comments, adverts, sharing and consent say so alone; others, such as notice or discussion, where the block is mostly linked or a list
  of records as well); and, outside the content, nodes whose text is mostly linked, lists of records (comments, teasers) and short blocks;
- content: all outermost articles or, without any, the container that most of the varying text runs to, with headlines, paragraphs
  and larger blocks around it.

A page's text is its content in page order.  Blocks that a page has and its wrapper lacks stay, unless their own tag or class speaks against it;
a page without a host, or that no wrapper fits, is judged by the same rules on its own numbers.

The wrapper's skeleton comes from all layouts of a host: they are merged some at a time, and the results again.  Where layouts differ without end, so that a wrapper
of all would be large, a host has several wrappers, each of the layouts with one hash, and a page meets the one that its layout is in.  All pages
are counted again for the statistics, by sums, minima and maxima that tasks add up before any shuffle.  Pages are not grouped by host: a
wrapper has one row, which joins them.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, prepare, written

#: Layouts, or wrappers of them, that are merged at once, and how many blocks a wrapper of wrappers has at most.
FAN, NODES = 32, 1024
#: Siblings of one label beyond this number are one slot.
MANY = 4
#: Template: the least share of the pages that have a node, and how many different pages, outside the content and inside.
SHARE, OUTSIDE, INSIDE = 0.5, 2, 5
#: Outside the content: blocks below this share of its text and this many characters a page are short.
SHORT, SHORT_CHARS = 0.08, 200
#: A class or id decides only about lists of records and nodes with less than this share of the text.
MOST = 0.5
#: Open elements at once; blocks deeper than this have no blocks of their own, but what is beside the text goes at any depth.
DEPTH = 256

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z]+")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
RAW = frozenset("script style title textarea noscript template iframe svg annotation annotation-xml select object canvas audio video noembed noframes xmp".split())
#: Of these, those that hold markup, so that they may nest; and those that may close themselves.
NESTING, FOREIGN = frozenset("noscript template svg select object canvas audio video".split()), frozenset(("svg",))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold running text.
ASIDE_TAGS = frozenset("head nav footer aside form menu dialog button search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in a class or id that name something beside the text.
ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies
    copyright disclaimer disqus discussion footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager
    pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription tagcloud toolbar topbar widget""".split()
)
#: Of these, those that name parts of articles too, so that they say little inside one.
IN_ARTICLES = frozenset("header byline legal disclaimer copyright menu navigation search social related discussion notice notices sidebar footer login widget toolbar pagination pager skip".split())
#: How much a class or id says.
LITTLE, CLEAR = 1, 2
#: Which open element a start tag ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}
ARTICLE = frozenset(("article", "main"))
#: Blocks that hold running text.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure dl".split())


class Node:
    """A block element: its label, whether it lies beside the text by itself, and its texts and blocks in page order."""

    __slots__ = ("aside", "block", "hint", "items", "label", "link", "tag")

    def __init__(self, tag: str, label: str, aside: bool = False, hint: int = 0, block: bool = True):
        self.tag, self.label, self.aside, self.hint, self.block = tag, label, aside, hint, block
        self.items: list[str | Node] = []
        self.link = 0


def _attributes(tag: str, raw: str, inside_article: bool) -> tuple[str, bool, int]:
    """(label, aside, hint) of an element: whether its tag or role puts it beside the text, and how clearly its class or id says so."""
    aside = tag in ASIDE_TAGS or (tag == "header" and not inside_article)
    if "=" not in raw and "hidden" not in raw:
        return tag, aside, 0
    attributes = {k.lower(): unescape((v or "").strip("\"'")).lower() for k, v in ATTRIBUTE.findall(raw)}
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
    role = attributes.get("role", "")
    aside = aside or role in ASIDE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    hint = 0
    if names and tag not in ("html", "body", "article", "main"):
        found = ASIDE_WORDS.intersection(WORDS.findall(names))
        hint = CLEAR if (found - IN_ARTICLES if inside_article else found) else LITTLE if found else 0
    if role == "main" or attributes.get("itemprop") == "articlebody":
        tag = "main"
    return (f"{tag}.{names.split()[0]}" if names else tag), aside, hint


def _raw_end(html: str, tag: str, at: int, endless: set[str]) -> int:
    """Where an element that holds no text of the page ends; ``at`` where it never does and is left out alone."""
    if tag in endless:
        return at
    first, depth = 0, 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(html, at):
        if m[1]:
            first = first or m.end()
            depth -= 1
            if not depth or tag not in NESTING:
                return m.end()
        elif not m[0].endswith("/>"):
            depth += 1
    if not first:
        endless.add(tag)
    return first or (at if tag in NESTING else len(html))


def parse(html: str) -> Node:
    """The blocks of a page.  Unclosed and stray tags are put up with; inline elements leave only their text."""
    root = Node("#", "#")
    stack, at, links, articles = [root], 0, 0, 0
    deep: list[str] = []  # elements open beyond DEPTH
    floor = 0  # how many of them hold the one at the top of the stack
    endless: set[str] = set()
    n = len(html)

    def close(k: int) -> None:
        nonlocal articles, links, floor
        articles -= sum(x.tag in ARTICLE for x in stack[k:])
        if k < DEPTH:
            del deep[:]
        del stack[k:]
        links = floor = 0

    def open_(node: Node) -> None:
        nonlocal articles, floor
        stack[-1].items.append(node)
        if len(stack) < DEPTH or (len(stack) == DEPTH and (node.aside or node.hint == CLEAR)):
            floor = len(deep)
            stack.append(node)
            articles += node.tag in ARTICLE
        else:
            deep.append(node.tag)

    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            top = stack[-1]
            top.items.append(text)
            if links:
                top.link += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in deep[floor:]:
                del deep[len(deep) - 1 - deep[::-1].index(tag) :]
            elif tag in BLOCKS or any(x.tag == tag and not x.block for x in stack):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            elif tag in ("td", "th"):
                stack[-1].items.append(" ")
            continue
        if tag in RAW:
            if not (m[3].endswith("/") and (tag in FOREIGN or not re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, at))):
                at = _raw_end(html, tag, at, endless)
            continue
        if tag in BLOCKS:
            if not deep:
                ended, stop = ENDS.get(tag, ((), ()))
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = stack[k].tag
                    if open_tag == "p" or open_tag in ended:
                        close(k)
                        break
                    if open_tag in stop or (stack[k].block and not ended):
                        break
            node = Node(tag, *_attributes(tag, m[3], articles > 0))
            if tag in VOID:
                stack[-1].items.append(node)
            elif len(deep) < DEPTH:  # beyond twice the depth elements only hold text
                open_(node)
        elif tag == "br":
            stack[-1].items.append(" ")
        elif tag == "a":
            links += 1
        elif tag not in VOID and ("=" in m[3] or "hidden" in m[3]):
            label, aside, hint = _attributes(tag, m[3], articles > 0)
            if (aside or hint == CLEAR) and len(stack) < DEPTH:  # an inline element beside the text
                open_(Node(tag, label, True, block=False))
    return root


class Tree:
    """What is aligned: a block, or several blocks of one label that are one slot."""

    __slots__ = ("aside", "hint", "id", "kids", "label", "nodes", "shape", "tag")

    def __init__(self, label: str, tag: str, aside: bool, hint: int, nodes: list[Node], kids: list[Tree]):
        self.label, self.tag, self.aside, self.hint, self.nodes, self.kids = label, tag, aside, hint, nodes, kids
        self.id = -1
        self.shape = hash((label, *[k.shape for k in kids]))


def tree(nodes: list[Node]) -> Tree:
    """The slots under blocks of one label.  Neighbours of one label without blocks of their own are one slot, and so are siblings of a label that is frequent."""
    found = [x for node in nodes for x in node.items if isinstance(x, Node) and x.block]
    times = Counter(x.label for x in found)
    most = MANY if len(nodes) == 1 else 0
    groups: list[list[Node]] = []
    frequent: dict[str, list[Node]] = {}
    last_leaf = ""
    for x in found:
        leaf = not any(isinstance(y, Node) and y.block for y in x.items)
        if times[x.label] > most:
            if x.label not in frequent:
                groups.append(frequent.setdefault(x.label, []))
            frequent[x.label].append(x)
            last_leaf = ""
        elif leaf and x.label == last_leaf:
            groups[-1].append(x)
        else:
            groups.append([x])
            last_leaf = x.label if leaf else ""
    top = nodes[0]
    return Tree(top.label, top.tag, top.aside, top.hint, nodes, [tree(g) for g in groups])


def numbered(t: Tree) -> list[Tree]:
    """All nodes in page order, numbered."""
    order: list[Tree] = []
    stack = [t]
    while stack:
        x = stack.pop()
        x.id = len(order)
        order.append(x)
        stack += x.kids[::-1]
    return order


def own_text(node: Node) -> str:
    """Text that stands directly in a block."""
    return " ".join("".join([x for x in node.items if isinstance(x, str)]).split())


def simple_tree_match(a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
    """Pairs of nodes: roots with equal labels, children in order, as many as possible."""
    pairs = [(a, b)] if a.label == b.label else []
    if pairs and a.kids and b.kids:
        _align(a.kids, b.kids, pairs)
    return pairs


def _align(x: list[Tree], y: list[Tree], pairs: list[tuple[Tree, Tree]]) -> None:
    """Append the pairs of two lists of siblings and of what is under them."""
    ends = []
    while x and y and x[0].shape == y[0].shape and x[0].label == y[0].label:  # equal shapes pair whole, which nothing beats
        ends.append((x[0], y[0]))
        x, y = x[1:], y[1:]
    while x and y and x[-1].shape == y[-1].shape and x[-1].label == y[-1].label:
        ends.append((x[-1], y[-1]))
        x, y = x[:-1], y[:-1]
    for s, t in ends:
        pairs += simple_tree_match(s, t)
    if not x or not y:
        return
    places: dict[str, list[int]] = {}
    for j, t in enumerate(y):
        places.setdefault(t.label, []).append(j)
    # the heaviest chain of pairs that rise on both sides; best[k] sums up the places before a power of two, as only pairs of one label are looked at
    best: list[tuple[int, tuple | None]] = [(0, None)] * (len(y) + 1)
    for s in x:
        found = []
        for j in places.get(s.label, ()):
            k, top = j, (0, None)
            while k:
                top = max(top, best[k], key=lambda b: b[0])
                k -= k & -k
            met = simple_tree_match(s, y[j])
            found.append((j + 1, (top[0] + len(met), (met, top[1]))))
        for k, chain in found:
            while k <= len(y):
                if chain[0] > best[k][0]:
                    best[k] = chain
                k += k & -k
    k, top = len(y), (0, None)
    while k:
        top = max(top, best[k], key=lambda b: b[0])
        k -= k & -k
    chain, met = top[1], []
    while chain:
        met.append(chain[0])
        chain = chain[1]
    for found in reversed(met):
        pairs += found


def merge(wrapper: Tree, page: Tree) -> None:
    """Adds to the wrapper what it lacks of a page, each block after the one that precedes it there."""
    paired = {id(p): w for p, w in simple_tree_match(page, wrapper)}

    def walk(p: Tree) -> None:
        w = paired[id(p)]
        kids, at = w.kids, 0
        where = {id(k): i for i, k in enumerate(kids)}
        after: list[list[Tree]] = [[] for _ in range(len(kids) + 1)]
        for k in p.kids:
            known = paired.get(id(k))
            if known is None:
                after[at].append(k)
            else:
                at = where[id(known)] + 1
                walk(k)
        w.kids = after[0] + [x for i, k in enumerate(kids) for x in (k, *after[i + 1])]
        w.shape = hash((w.label, *[k.shape for k in w.kids]))

    if paired:
        walk(page)


def dump(t: Tree) -> list:
    return [t.label, t.tag, int(t.aside), int(t.hint), [dump(k) for k in t.kids]]


def load(wrapper: str) -> Tree:
    """A wrapper with numbered nodes."""

    def build(x: list) -> Tree:
        return Tree(x[0], x[1], bool(x[2]), x[3], [], [build(k) for k in x[4]])

    t = build(json.loads(wrapper))
    numbered(t)
    return t


@lru_cache(maxsize=256)
def loaded(wrapper: str) -> Tree:
    return load(wrapper)


class Verdict:
    """What the nodes of a tree are, from numbers of each: pages that have it, blocks, unlinked and linked characters that are no template."""

    def __init__(self, root: Tree, numbers: dict[int, tuple[float, float, float, float]]):
        self.numbers = numbers
        self.plain: dict[int, float] = {}
        self.linked: dict[int, float] = {}
        self.parent: dict[int, Tree] = {}
        order: list[Tree] = []
        stack = [root]
        while stack:
            t = stack.pop()
            order.append(t)
            if not t.aside:
                stack += t.kids
                self.parent |= {k.id: t for k in t.kids}
        for t in reversed(order):
            _, _, plain, linked = numbers.get(t.id, (0, 0, 0, 0))
            self.plain[t.id] = 0.0 if t.aside else plain + sum(self.plain[k.id] for k in t.kids)
            self.linked[t.id] = 0.0 if t.aside else linked + sum(self.linked[k.id] for k in t.kids)
        whole = self.plain[root.id]
        #: Nodes beside the text, which go with all that they hold.
        self.beside = {t.id for t in order if t.aside or self._named(t, whole)}
        #: Where the text lies.
        self.roots, self.by_article = {root.id}, False
        articles = [t for t in order if t.label.split(".")[0] in ARTICLE and self._outermost(t)]
        if articles and (sum(self.plain[t.id] for t in articles) >= 0.2 * whole):
            self.roots, self.by_article = {t.id for t in articles}, True
        #: Nodes of the content, in which a text counts as template only on several pages.
        self.inside = self.roots - {root.id}
        if not self.inside:
            self._surroundings(root)
        for t in order:
            if t.id in self.parent and self.parent[t.id].id in self.inside:
                self.inside.add(t.id)

    def _named(self, t: Tree, whole: float) -> bool:
        """Whether the class or id of a block puts it beside the text."""
        if t.hint == CLEAR and self.plain[t.id] < MOST * whole:
            return True
        return t.hint > 0 and ((t.hint == LITTLE and self.linked[t.id] > self.plain[t.id]) or self._records(t))

    def _outermost(self, t: Tree) -> bool:
        """Whether a node lies neither in an article nor beside the text."""
        if t.id in self.beside:
            return False
        while (t := self.parent.get(t.id)) is not None:
            if t.id in self.beside or t.label.split(".")[0] in ARTICLE:
                return False
        return True

    def _surroundings(self, t: Tree) -> None:
        """Walk down to the container of most of the text; what stands around it and is no text goes beside."""
        chain = [t]
        while True:
            kids = [k for k in t.kids if k.kids and k.id not in self.beside and len(k.kids) > 0]
            down = max(kids, key=lambda k: self.plain[k.id], default=None)
            if down is None or not self.plain[t.id] or self.plain[down.id] < MOST * self.plain[t.id]:
                break
            chain.append(down)
            t = down
        core = chain[-1]
        self.inside = {core.id}
        for a, b in zip(chain, chain[1:]):
            for k in a.kids:
                if k is not b and k.id not in self.beside and not self._around(k, core):
                    self.beside.add(k.id)

    def _around(self, k: Tree, core: Tree) -> bool:
        """Whether a block around the content belongs to it."""
        if k.tag in RUNNING or any(x.tag == "h1" for x in k.kids):
            return True
        if self.linked[k.id] > self.plain[k.id] or self._records(k):
            return False
        pages = max(1.0, self.numbers.get(k.id, (1,))[0])
        return self.plain[k.id] >= SHORT * self.plain[core.id] or self.plain[k.id] >= SHORT_CHARS * pages

    def _records(self, k: Tree) -> bool:
        """Whether a block is a list of records: most of its text stands in blocks of one label, two or more to a page, with blocks of their own."""
        while True:
            whole, pages = self.plain[k.id], max(1.0, self.numbers.get(k.id, (1,))[0])
            by_label: dict[str, list[float]] = {}
            for x in k.kids:
                got = by_label.setdefault(x.label, [0.0, 0.0, 0.0])
                got[0] += self.plain.get(x.id, 0.0)
                got[1] += self.numbers.get(x.id, (0, 0))[1]
                got[2] += bool(x.kids) or x.tag in ("li", "div", "dd")
            if any(got[0] >= 0.7 * whole > 0 and got[1] >= 2 * pages and got[2] for got in by_label.values()):
                return True
            k = next((x for x in k.kids if whole > 0 and self.plain.get(x.id, 0.0) >= 0.7 * whole), None)
            if k is None:
                return False


def measured(t: Tree) -> Iterator[tuple[int, Node, str, int]]:
    """(node, block, text, unlinked characters) of each block of a numbered tree that has text of its own."""
    for x in numbered(t):
        for node in x.nodes:
            if text := own_text(node):
                yield x.id, node, text, max(0, len(text) - node.link)


def alone(page: Tree) -> Verdict:
    """A page judged by its own numbers."""
    sums: dict[int, list[float]] = {}
    for x in numbered(page):
        sums[x.id] = [1, len(x.nodes), 0, 0]
    for i, _, text, plain in measured(page):
        sums[i][2] += plain
        sums[i][3] += len(text) - plain
    return Verdict(page, {i: tuple(s) for i, s in sums.items()})


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _shared_article(order: list[Tree], of: dict[int, int], inside: set[int], beside: set[int], fixed: set[int]) -> set[int]:
    """The template texts inside the content of a page, where they are more than the rest of it: then they are its article, which others share."""
    content = {id(t) for t in order if of.get(t.id) in inside}
    for t in order:  # blocks that the wrapper lacks lie where their parents do
        if id(t) in content:
            content |= {id(k) for k in t.kids if of.get(k.id) is None}
    nodes = [node for t in order if id(t) in content for node in t.nodes if id(node) not in beside]
    common = {id(node) for node in nodes if id(node) in fixed}
    sizes = [0, 0]
    for node in nodes:
        sizes[id(node) in common] += len(own_text(node))
    return common if sizes[1] > sizes[0] else set()


def extract(html: str, wrapper: Tree | None = None, verdict: Verdict | None = None, template: frozenset[tuple[int, int]] = frozenset()) -> str:
    """The main text of a page; without a wrapper, or where it does not fit, by the page's own numbers."""
    page = tree([parse(html)])
    order = numbered(page)
    of = {p.id: w.id for p, w in simple_tree_match(page, wrapper)} if wrapper is not None else {}
    roots = [t for t in order if of.get(t.id) in verdict.roots] if of else []
    if not roots:
        verdict, of, template = alone(page), {t.id: t.id for t in order}, frozenset()
        roots = [t for t in order if t.id in verdict.roots]
    beside, fixed = set(), set()
    for t in order:
        w = of.get(t.id)
        if (w in verdict.beside) if w is not None else (t.aside or t.hint == CLEAR):
            beside |= {id(node) for node in t.nodes}
        elif template and w is not None:
            fixed |= {id(node) for node in t.nodes if (w, text_hash(own_text(node))) in template}
    if fixed:
        fixed -= _shared_article(order, of, verdict.inside, beside, fixed)

    def lines(fixed: set[int]) -> list[str]:
        out: list[str] = []
        starts = {id(node) for t in roots for node in t.nodes}
        stack: list[tuple[Node, bool]] = [(page.nodes[0], False)]
        held: list[str] = []

        def end() -> None:
            if text := " ".join(unescape("".join(held)).split()):
                out.append(text)
            held.clear()

        def walk(node: Node, on: bool) -> None:
            on = on or id(node) in starts
            speaks = on and id(node) not in fixed
            for x in node.items:
                if isinstance(x, str):
                    if speaks:
                        held.append(x)
                elif x.block:
                    end()
                    if id(x) not in beside and not x.aside:
                        walk(x, on)
                    end()

        walk(*stack[0])
        end()
        return out

    found = lines(fixed)
    if not found and fixed:  # nothing varies: the page is all template, so its own text stays
        found = lines(set())
    return "\n".join(found)


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def skeleton(html: str) -> str:
    """The blocks of a page without their texts: its layout."""
    return json.dumps(dump(tree([parse(html)])), separators=(",", ":"))


def layouts(pages: DataFrame) -> DataFrame:
    """(host, layout, skeleton, n): each layout of a host, its hash, and how many pages have it.  pages: (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter((h, skeleton(html)) for h, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            columns = [pa.array([h for h, _ in found], pa.string()), pa.array([text_hash(x) for _, x in found], pa.int64()), pa.array([x for _, x in found], pa.string()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "layout", "skeleton", "n"])

    found = pages.select("host", "html").mapInArrow(run, "host string, layout long, skeleton string, n long")
    return found.groupBy("host", "layout", "skeleton").agg(F.sum("n").alias("n"))


def _merged(rows: DataFrame) -> DataFrame:
    """(host, parts, part, n, nodes, wrapper): the wrappers of each part (host, parts, part, n, place, wrapper) merged, those of most pages first."""

    def build(table: pa.Table) -> pa.Table:
        found = sorted(zip(table["n"].to_pylist(), table["place"].to_pylist(), table["wrapper"].to_pylist()), key=lambda x: (-x[0], x[1], x[2]))
        whole = load(found[0][2])
        for _, _, wrapper in found[1:]:
            merge(whole, load(wrapper))
        first = {c: [table[c][0].as_py()] for c in ("host", "parts", "part")}
        return pa.table(first | {"n": [sum(x[0] for x in found)], "nodes": [len(numbered(whole))], "wrapper": [json.dumps(dump(whole), separators=(",", ":"))]})

    return rows.groupBy("host", "parts", "part").applyInArrow(build, "host string, parts long, part long, n long, nodes long, wrapper string")


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, parts, part, wrapper) from pages (host, html): a host's wrapper, or several, each of all layouts whose hash leaves ``part`` by ``parts``."""
    found = scratch.write(layouts(pages), "layouts")
    n = F.count(F.lit(1))
    parts = F.when(n <= FAN, 1).when(n <= FAN**2, FAN).when(n <= FAN**3, FAN**2).when(n <= FAN**4, FAN**3).otherwise(FAN**4).cast("long")
    rows = found.join(found.groupBy("host").agg(parts.alias("parts")), "host")
    made = _merged(rows.select("host", "parts", (F.col("layout") % F.col("parts")).alias("part"), "n", F.col("layout").alias("place"), F.col("skeleton").alias("wrapper")))
    made = scratch.write(made.withColumn("done", F.col("parts") == 1), "wrappers")
    while not made.where("not done").isEmpty():
        fewer = (F.col("parts") / FAN).cast("long")
        tried = scratch.write(_merged(made.where("not done").select("host", fewer.alias("parts"), (F.col("part") % fewer).alias("part"), "n", F.col("part").alias("place"), "wrapper")), "tried")
        fits = tried.groupBy("host").agg((F.max("nodes") <= NODES).alias("fits"))
        kept = made.join(fits, "host", "left").where("fits is null or not fits").withColumn("done", F.lit(True)).drop("fits")
        made = scratch.write(kept.unionByName(tried.join(fits, "host").where("fits").withColumn("done", F.col("parts") == 1).drop("fits")), "wrappers")
    scratch.free("layouts", "tried")
    return made.select("host", "parts", "part", "wrapper")


def dealt(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Rows (key, url, html, host) with the name of their wrapper as host: of a host with several wrappers, host#part by the page's layout."""
    if made.where("parts > 1").isEmpty():
        return rows
    several = written(made.where("parts > 1").select("host", "parts").distinct(), "parts")  # stays, as what is returned reads it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [h if parts is None else f"{h}#{text_hash(skeleton(html)) % parts}" for html, h, parts in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.string())], names=["key", "url", "html", "host"])

    joined = rows.join(several, "host", "left").select("key", "url", "html", "host", "parts")
    return joined.mapInArrow(run, rows.select("key", "url", "html", "host").schema)


def _counted(pages: DataFrame) -> DataFrame:
    """(host, node, x, n, plain, linked, low, high): over all pages of a host, for each wrapper node how many pages have it (x null), and for each text
    there, by hash x, its blocks, its unlinked and linked characters, and the least and the largest hash of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int, int | None], list] = {}
            for h, page_hash, wrapper, html in zip(*(b.column(i).to_pylist() for i in range(4))):
                page = tree([parse(html)])
                numbered(page)
                of = {p.id: w.id for p, w in simple_tree_match(page, loaded(wrapper))}
                for w in of.values():
                    sums.setdefault((h, w, None), [0, 0, 0, page_hash, page_hash])[0] += 1
                for i, _, text, plain in measured(page):
                    if i in of:
                        s = sums.setdefault((h, of[i], text_hash(text)), [0, 0, 0, page_hash, page_hash])
                        s[0] += 1
                        s[1] += plain
                        s[2] += len(text) - plain
                        s[3], s[4] = min(s[3], page_hash), max(s[4], page_hash)
            columns = [[k[0] for k in sums], [k[1] for k in sums], [k[2] for k in sums], *([s[i] for s in sums.values()] for i in range(5))]
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "node", "x", "n", "plain", "linked", "low", "high"])

    found = pages.select("host", "h", "wrapper", "html").mapInArrow(run, "host string, node int, x long, n long, plain long, linked long, low long, high long")
    return found.groupBy("host", "node", "x").agg(*[F.sum(c).alias(c) for c in ("n", "plain", "linked")], F.min("low").alias("low"), F.max("high").alias("high"))


def models(pages: DataFrame, made: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper, nodes, constant) for the hosts of pages (host, h, html): the wrapper (made: host, wrapper), the numbers of its nodes, the texts that may be template."""
    # written tables have a size that Spark knows: it broadcasts them where they are small and does not shuffle pages for them then
    counted = scratch.write(_counted(pages.join(made, "host")), "counted")
    per_node = counted.groupBy("host", "node").agg(F.max(F.when(F.col("x").isNull(), F.col("n"))).alias("pages"), *[F.sum(F.when(F.col("x").isNotNull(), F.col(c))).alias(c) for c in ("n", "plain", "linked")])
    per_node = scratch.write(per_node.select("host", "node", "pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "plain", "linked")]), "nodes")
    often = counted.where("x is not null and low < high and n >= 2").join(per_node.select("host", "node", "pages"), ["host", "node"]).where(F.col("n") >= SHARE * F.col("pages"))
    constant = often.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "x", "n", "plain", "linked"))).alias("constant"))  # a few for each node
    nodes = per_node.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "n", "plain", "linked"))).alias("nodes"))  # one for each node
    out = made.join(nodes, "host", "left").join(constant, "host", "left")
    out = written(out.select("host", "wrapper", "nodes", "constant"), "models")
    scratch.free("wrappers", "counted", "nodes")
    return out


@lru_cache(maxsize=256)
def _decided(wrapper: str, nodes: tuple, constant: tuple) -> tuple[Tree, Verdict, frozenset[tuple[int, int]]]:
    """(wrapper, verdict, template) of a host."""
    root = loaded(wrapper)

    def judged(template: tuple) -> Verdict:
        off: dict[int, list[float]] = {}
        for node, _, _, plain, linked in template:
            s = off.setdefault(node, [0.0, 0.0])
            s[0] += plain
            s[1] += linked
        return Verdict(root, {i: (pages, n, plain - off.get(i, (0, 0))[0], linked - off.get(i, (0, 0))[1]) for i, pages, n, plain, linked in nodes})

    verdict, raw = judged(constant), judged(())
    if raw.by_article and not verdict.by_article:  # pages that share their article
        verdict = raw
    kept = tuple(c for c in constant if c[2] >= (INSIDE if c[0] in verdict.inside else OUTSIDE))
    shared = sum(c[3] + c[4] for c in kept if c[0] in verdict.inside)
    if 2 * shared > sum(plain + linked for i, _, _, plain, linked in nodes if i in verdict.inside):
        kept = tuple(c for c in kept if c[0] not in verdict.inside)
    judgement = verdict if verdict is raw or len(kept) == len(constant) else judged(kept)
    return root, judgement, frozenset((node, x) for node, x, *_ in kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Null html is empty and gives an empty text; a null or malformed url has no host, and such pages are read by their own blocks, as is a page that its
    host's wrapper does not fit.  Copies of a page never make its text template.  Repeated rows give a row each; an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    scratch = Scratch(pages.sparkSession)
    made = wrappers(rows.where("host <> ''"), scratch)
    rows = dealt(rows, made)
    known = rows.where("host <> ''").select("host", F.xxhash64("html").alias("h"), "html")
    name = F.when(F.col("parts") > 1, F.concat_ws("#", "host", "part")).otherwise(F.col("host")).alias("host")
    by_host = models(known, made.select(name, "wrapper"), scratch)
    id_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for html, wrapper, nodes, constant in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                if wrapper is None:
                    texts.append(extract(html))
                else:
                    texts.append(extract(html, *_decided(wrapper, *(tuple(tuple(s.values()) for s in x or ()) for x in (nodes, constant)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(by_host, "host", "left").select("key", "url", "html", "wrapper", "nodes", "constant")
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
