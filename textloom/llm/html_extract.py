"""Main text of web pages by wrapper induction.

Pages of one host and one layout (the same set of containers and classes) form a cluster. The cluster's page of the smallest hash
gives the wrapper's tree. All other pages of the cluster, copies once, are aligned with it by simple tree matching (the
order-preserving match of equal tags that holds most nodes, by dynamic programming over children); over all of them, each
node of the wrapper sums up how many pages have it, its words, its words in links, and each bit of its text's hash. A node
whose text is the same on nearly all its pages is template; a node whose text varies is a slot.

Slots are ranked by their varying text. From the root the wrapper follows, as long as one container holds ``DOMINANT`` of the varying words
that its parent holds, that container; where it stops is the content. Beside this way stand the other slots: headings, paragraphs and
the like that vary belong to the article; template, slots of links, lists, and containers of less than ``MAJOR`` of the content's words
(menus, adverts, footers, teasers, comments) don't. Constant text inside the content is the article's own, but for what stands before
the first or after the last varying block of a content that isn't an article or main element.

Each page is then parsed whole and aligned with the wrapper along this way. What only this page has stays if it has paragraphs or headings
of its own and isn't made of links. Inside the content, tags that are never text (scripts, forms, navigation, asides) go, and what a
class names as an advert or comments, unless it is nearly all of the page. Blocks are joined by line breaks.

A cluster needs ``LEAST_PAGES`` different pages. Pages of smaller clusters take the wrapper of their host's largest cluster. Pages of
hosts without one, and those that lack the wrapper's content, have only their tags, roles and classes: their text is that of the
main or article elements (not of articles that are less than half as long as the longest), and of headings and paragraphs beside
them, or else of the whole page.

Scale: a cluster's statistics are sums, made first in each task, so that a host with a third of all pages is no burden to any;
wrappers are a few KB a cluster and meet the pages by a broadcast of measured size, or else by a join on host, layout and salt.

Cases: null html is empty and gives empty text; a null url counts as host ''; unclosed and stray tags are repaired; repeated rows
give repeated results and count once for the wrapper; of clusters of equal size the first layout hash is the host's largest;
very long and deeply nested pages are aligned whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._store import Scratch, bounded_batches, small

LEAST_PAGES, SALTS = 3, 64
#: Shares from which a text is a template's, and words are mostly links.
CONSTANT, LINKS = 0.8, 0.6
#: Share of its parent's varying words with which a container is followed, and of the content's with which one beside it is kept.
DOMINANT, MAJOR = 0.6, 0.25
#: Share of a page's words from which on a container is its text, whatever its class says.
WHOLE = 0.9
#: Cells of a table of the alignment that are in memory at once; shapes and clusters that a worker remembers.
CELLS, SHAPES, CLUSTERS = 4_000_000, 300_000, 2000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option br".split())
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}
_AUTO = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl select html body div article section main td th li".split())
_DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas nav header footer aside form button select textarea input dialog menu title noembed noframes audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
# Class names of what isn't the article, alone or at the end of a compound; names that stand before a container's name; and such names.
_NAMES = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond related recommended widget pagination pager toolbar skip".split())
_BEFORE = frozenset("nav navbar menu site page header footer sidebar ad ads advert cookie consent gdpr newsletter share social comment comments promo sponsor related recommended breadcrumb".split())
_CONTAINERS = frozenset("header box container wrapper wrap bar list area block section slot unit links items form inner outer left right top bottom posts stories articles content panel nav row thread overlay".split())
# Names that are also ordinary words: alone, they count only as the first class.
_AMBIGUOUS = frozenset("share sharing reply replies respond related recommended notice notices banner social comment promo skip popup".split())
# Tags of running text: never followed as containers, and not judged by their class; those of them that can stand beside the content.
_BESIDE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre table figure".split())
_FLOW = _BESIDE | frozenset("ul ol dl details address hr".split())
_INNER = _BESIDE | frozenset("li dt dd td th tr tbody thead caption figcaption summary a b i em strong code q cite small sup sub br".split())
_SPACE = re.compile(r"[\s\xa0]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")


class Node:
    __slots__ = ("attrs", "children", "hash", "links", "shape", "tag", "words")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []  # children: Node or str
        self.shape = self.hash = self.words = self.links = 0


def parse(text: str) -> Node:
    """The DOM of a page, unclosed and stray tags repaired."""
    root = Node("#root")
    stack, at = [root], 0
    find, n = _TOKEN.search, len(text)
    while at < n:
        m = find(text, at)
        if not m:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE and tag not in _BLOCK:
                    break  # a stray inline end stays inside its block
        elif m[2] or m[4]:  # the second: an unpaired quote in a tag
            tag, attrs = (m[2] or m[4]).lower(), m[3] or m[5] or ""
            ends = _AUTO.get(tag)
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in _SCOPE:
                        break
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
                    if stack[i].tag in ("table", "ul", "ol", "dl", "select"):
                        break
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                node.children.append(text[at : end.start() if end else n])
                at = end.end() if end else n
            elif tag not in _VOID and not attrs.rstrip().endswith("/"):
                stack.append(node)
    return root


def named_boilerplate(value: str) -> bool:
    """Whether a class or id names something else than the article: ``menu``, ``main-menu``, ``ad-slot``, but not ``related-work``."""
    for at, token in enumerate(value.split()):
        parts = [p for p in re.split(r"[^a-z]+", token) if p]
        if at and len(parts) == 1 and parts[0] in _AMBIGUOUS:
            continue
        if parts and (token in ("header", "site-header") or parts[-1] in _NAMES or len(parts) > 1 and parts[0] in _BEFORE and all(p in _CONTAINERS for p in parts[1:])):
            return True
    return False


def boilerplate(node: Node, inside: bool = False, most: float = float("inf")) -> bool:
    """Whether tag, role or class say that a node isn't the article's text; ``inside`` an article or main a header is its own. A class
    says so only of containers of up to ``most`` words."""
    if node.tag in _DROPPED and not (inside and node.tag == "header"):
        return True
    if not node.attrs:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and node.words <= most and node.tag not in ("article", "main", "body", "html") and node.tag not in _INNER and not (inside and node.tag == "header") and named_boilerplate(value):
            return True
    return bool(_HIDDEN.search(node.attrs)) or "display:none" in node.attrs.replace(" ", "")


def blocks(node: Node, most: float = float("inf"), inside: bool = False) -> list[str]:
    """Text of the blocks under ``node`` in page order, without boilerplate; ``most`` as there."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        t = _SPACE.sub(" ", entities.unescape("".join(now))).strip()
        if t:
            out.append(t)
        now.clear()

    work: list = [(node, inside)]
    while work:
        x, within = work.pop()
        if isinstance(x, str):
            now.append(x)
        elif x is None:
            flush()
        elif x is node or not boilerplate(x, within, most):
            if x.tag in _BLOCK:
                flush()
                work.append((None, within))
            within = within or x.tag in ("article", "main")
            work.extend((y, within) for y in reversed(x.children))
    flush()
    return out


def elements(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node)]


class Shapes:
    """Trees of tags and classes, told apart by number, and how many nodes (doubled; a shared class counts one more) two of them can
    match. Equal subtrees, of whatever pages, are compared once."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def number(self, label: tuple[str, str], below: tuple[int, ...]) -> int:
        key = (label, below)
        if key not in self.known:
            self.known[key] = len(self.parts)
            self.parts.append(key)
        return self.known[key]

    def size(self, x: int, y: int) -> int:
        if x > y:
            x, y = y, x
        got = self.sizes.get((x, y))
        if got is None:
            (a, below_a), (b, below_b) = self.parts[x], self.parts[y]
            got = 0 if a[0] != b[0] else 2 + (a == b) + sum(self.size(below_a[i], below_b[j]) for i, j in self.align(below_a, below_b))
            self.sizes[x, y] = got
        return got

    def align(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        """The order-preserving pairs that match most."""
        n, m, low = len(a), len(b), 0
        while low < n and low < m and a[low] == b[low]:  # equal ends are always matched in some best alignment
            low += 1
        while n > low and m > low and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
        out = [(i, i) for i in range(low)]
        if n > low and m > low:
            out += [(low + i, low + j) for i, j in self.between(a[low:n], b[low:m])]
        return out + [(i, m + i - n) for i in range(n, len(a))]

    def between(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        tags_a, tags_b = [self.parts[x][0][0] for x in a], [self.parts[y][0][0] for y in b]
        there = dict(zip(tags_b, range(len(b)), strict=True))
        if len(there) == len(b) and len(set(tags_a)) == len(a):  # each tag once: if in one order, all pairs can be had
            pairs = [(i, there[t]) for i, t in enumerate(tags_a) if t in there]
            if all(p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False)):
                return pairs
        kinds_a, kinds_b = ({k: i for i, k in enumerate(dict.fromkeys(x))} for x in (a, b))
        worth = np.array([[self.size(p, q) for q in kinds_b] for p in kinds_a], dtype=np.int32)
        return _best(worth, np.array([kinds_a[x] for x in a]), np.array([kinds_b[y] for y in b]))


def _rows(worth: np.ndarray, ia: np.ndarray, ib: np.ndarray, keep: bool) -> np.ndarray:
    """The best sums of alignments of the rest from each pair of places on: all rows, or the first alone."""
    out = np.zeros((len(ia) + 1 if keep else 1, len(ib) + 1), dtype=np.int32)
    row = np.zeros(len(ib) + 1, dtype=np.int32)
    for i in range(len(ia) - 1, -1, -1):
        best = np.maximum(row[:-1], row[1:] + worth[ia[i]][ib])
        row = np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)
        out[i if keep else 0] = row
    return out


def _best(worth: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> list[tuple[int, int]]:
    n, m = len(ia), len(ib)
    if n * m > CELLS and n > 1:  # too large for one table: halves meet where both together are best
        half = n // 2
        after = _rows(worth, ia[half:], ib, False)[0]
        before = _rows(worth, ia[:half][::-1], ib[::-1], False)[0][::-1]
        at = int((before + after).argmax())
        return _best(worth, ia[:half], ib[:at]) + [(half + i, at + j) for i, j in _best(worth, ia[half:], ib[at:])]
    best = _rows(worth, ia, ib, True)
    out, i, j = [], 0, 0
    while i < n and j < m:
        w = int(worth[ia[i], ib[j]])
        if w and best[i, j] == best[i + 1, j + 1] + w:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i + 1, j]:
            i += 1
        else:
            j += 1
    return out


def label(node: Node) -> tuple[str, str]:
    """A node's tag, and its classes without digits."""
    if node.attrs and "class" in node.attrs:
        for name, a, b, c in _ATTRIBUTE.findall(node.attrs):
            if name.lower() == "class":
                return node.tag, re.sub(r"\d+", "", (a or b or c).lower())
    return node.tag, ""


def measured(root: Node, shapes: Shapes) -> Node:
    """Numbers the tree's shapes, and sums up each node's text: hash, words, and words in links."""
    order, work = [], [root]
    while work:
        x = work.pop()
        order.append(x)
        work.extend(elements(x))
    for x in reversed(order):
        below, parts, words, links = [], [], 0, 0
        for y in x.children:
            if isinstance(y, str):
                t = y.split()
                if t:
                    parts.append(" ".join(t))
                    words += len(t)
            else:
                below.append(y.shape)
                if y.hash:
                    parts.append(str(y.hash))
                    words, links = words + y.words, links + y.links
        x.shape = shapes.number(label(x), tuple(below))
        if parts and x.tag not in ("script", "style", "noscript", "template"):
            x.hash = xxhash.xxh32_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass")) or 1
            x.words, x.links = words, words if x.tag == "a" else links
    return root


class Skeleton:
    """A wrapper's tree without its text: nodes by number, in document order."""

    def __init__(self, rows: list[list], shapes: Shapes):
        self.rows = rows  # tag, class, number of the parent
        self.below: list[list[int]] = [[] for _ in rows]
        for i, (_, _, parent) in enumerate(rows):
            if parent >= 0:
                self.below[parent].append(i)
        self.shape = [0] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            self.shape[i] = shapes.number((rows[i][0], rows[i][1]), tuple(self.shape[j] for j in self.below[i]))

    def matched(self, root: Node, shapes: Shapes, wanted: frozenset | None = None) -> list[tuple[int, Node]]:
        """Simple tree matching: the wrapper's nodes and their partners in a page; ``wanted``: only these nodes, and those above them."""
        out, work = [], [(0, root)]
        if wanted is not None:
            ways: set[int] = set()
            for i in wanted:
                while i >= 0 and i not in ways:
                    ways.add(i)
                    i = self.rows[i][2]
            wanted = frozenset(ways)
        while work:
            i, node = work.pop()
            out.append((i, node))
            below = self.below[i]
            if not below or wanted is not None and not any(j in wanted for j in below):
                continue
            under = elements(node)
            if under:
                pairs = shapes.align(tuple([self.shape[j] for j in below]), tuple([y.shape for y in under]))
                work.extend((below[p], under[q]) for p, q in pairs if wanted is None or below[p] in wanted)
        return out


def skeleton(root: Node) -> list[list]:
    rows: list[list] = []
    work: list[tuple[Node, int]] = [(root, -1)]
    while work:
        x, parent = work.pop()
        rows.append([*label(x), parent])
        work.extend((y, len(rows) - 1) for y in reversed(elements(x)))
    return rows


class Statistics:
    """Sums over a cluster's pages for each node of its wrapper."""

    def __init__(self, rows: list[list]):
        self.n, self.words, self.links = (np.zeros(len(rows), dtype=np.int64) for _ in range(3))
        self.bits = np.zeros((len(rows), 32), dtype=np.int64)

    def add(self, pairs: list[tuple[int, Node]]) -> None:
        held = [(i, x) for i, x in pairs if x.hash]
        at = np.array([i for i, _ in held], dtype=np.int64)
        h = np.array([x.hash for _, x in held], dtype=np.int64)
        self.n[at] += 1
        self.words[at] += [x.words for _, x in held]
        self.links[at] += [x.links for _, x in held]
        self.bits[at] += h[:, None] >> np.arange(32) & 1


def wrapper_of(rows: list[list], n: np.ndarray, words: np.ndarray, links: np.ndarray, bits: np.ndarray) -> dict:
    """The tree; the way from its root to the content; of the nodes beside the way and inside the content, which are template
    (``fixed``) and which are no part of an article (``minor``). A text that holds in a share ``p`` of the pages sets each of its
    bits in ``(1 + p) / 2`` of them, as the others' bits are even."""
    many = np.maximum(n, 1)
    share = 2 * (np.maximum(bits, many[:, None] - bits) / many[:, None]).mean(axis=1) - 1
    fixed = (n >= LEAST_PAGES) & (share >= CONSTANT)
    linked = (n >= LEAST_PAGES) & ~fixed & (links >= LINKS * words) & (words > 0)
    below: list[list[int]] = [[] for _ in rows]
    varying = (words - links).astype(np.int64)
    for i in range(len(rows) - 1, -1, -1):  # children have higher numbers
        for j in below[i]:
            varying[i] -= (words[j] - links[j]) - varying[j]
        if fixed[i]:
            varying[i] = 0
        if rows[i][2] >= 0:
            below[rows[i][2]].append(i)
    way = [0]
    while True:
        kept = [j for j in below[way[-1]] if rows[j][0] not in _FLOW and rows[j][0] not in _INNER and rows[j][0] in _BLOCK | {"html", "body"}]
        first = max(kept, key=lambda j: (varying[j], -j), default=-1)
        if first < 0 or not varying[first] or varying[first] < DOMINANT * varying[way[-1]]:
            break
        way.append(first)
    there = [j for i in way for j in below[i] if j not in way]
    least = MAJOR * varying[way[-1]]
    minor = [j for j in there if linked[j] or rows[j][0] not in (_FLOW if rows[j][2] == way[-1] else _BESIDE) and varying[j] < least]
    return {"tree": rows, "way": way if varying[way[-1]] else [], "fixed": [j for j in there if fixed[j]], "minor": minor}


def content(tree: Node) -> list[Node]:
    """The page's main elements, else its outermost articles but for those much shorter than the longest, else the whole page."""
    for tag in ("main", "article"):
        found, work = [], [tree]
        while work:
            x = work.pop()
            if x.tag == tag and not boilerplate(x):
                found.append(x)
            else:
                work.extend(y for y in reversed(elements(x)) if x.tag == "#root" or not boilerplate(x))
        if found:
            longest = max(x.words for x in found)
            return [x for x in found if 2 * x.words >= longest]
    return [tree]


def flowing(node: Node) -> bool:
    """Whether a node is or holds running text that isn't mostly links, and isn't a row of equal parts."""
    if node.links >= LINKS * node.words and node.words or boilerplate(node):
        return False
    if node.tag in _BESIDE:
        return True
    under = elements(node)
    if node.tag in _FLOW or len(under) > 1 and under[0].tag not in _FLOW and len({label(x) for x in under}) == 1:
        return False
    return any(x.tag in _BESIDE or x.tag not in _INNER and x.tag not in _FLOW and flowing(x) for x in under)


def beside(tree: Node, kept: list[Node]) -> Node:
    """``kept`` elements with the headings and paragraphs that stand beside the way to them, as one tree."""
    ids, holds = {id(x) for x in kept}, set()

    def mark(x: Node) -> bool:
        found = id(x) in ids
        for y in elements(x):
            found = mark(y) or found
        if found:
            holds.add(id(x))
        return found

    mark(tree)

    def cut(x: Node) -> Node:
        if id(x) in ids:
            return x
        out = Node("div")
        for y in elements(x):
            if id(y) in holds:
                out.children.append(cut(y))
            elif y.tag in _BESIDE and flowing(y):
                out.children.append(y)
        return out

    return cut(tree)


def trimmed(node: Node, of: dict[int, int], fixed: frozenset, minor: frozenset) -> Node:
    """The content's children from the first block of the article to the last."""
    children = node.children
    is_own = lambda y: isinstance(y, Node) and y.hash and of.get(id(y)) not in fixed and of.get(id(y)) not in minor and not boilerplate(y) and (y.tag in _FLOW or id(y) in of or flowing(y))
    own = [i for i, y in enumerate(children) if is_own(y)]
    out = Node("article")
    if not own or any(isinstance(y, str) and y.strip() for y in children):  # text of its own: nothing to go by
        out.children = [y for y in children if isinstance(y, str) or of.get(id(y)) not in minor]
    else:
        out.children = children[own[0] : own[-1] + 1]
    return out


class Extractor:
    """Extracts pages; remembers shapes and wrappers within bounds."""

    def __init__(self):
        self.shapes = Shapes()
        self.held: dict[str, tuple[Skeleton, list[int], frozenset, frozenset]] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # a page may nest as deep as it is long

    def bounded(self) -> None:
        if len(self.shapes.parts) > SHAPES or len(self.shapes.sizes) > SHAPES or len(self.held) > CLUSTERS:
            self.__init__()

    def wrapper(self, told: str) -> tuple[Skeleton, list[int], frozenset, frozenset]:
        if told not in self.held:
            w = json.loads(told)
            self.held[told] = Skeleton(w["tree"], self.shapes), w.get("way", []), frozenset(w.get("fixed", ())), frozenset(w.get("minor", ()))
        return self.held[told]

    def text(self, page: str, told: str | None) -> str:
        self.bounded()
        tree = measured(parse(page), self.shapes)
        found = self.induced(tree, told) if told is not None else None
        if found is None:
            found = beside(tree, content(tree))
        return "\n".join(blocks(found, WHOLE * tree.words))

    def induced(self, tree: Node, told: str) -> Node | None:
        """The page's content and what belongs to it beside the way, by its wrapper; None if the page has no such content."""
        skeleton_, way, fixed, minor = self.wrapper(told)
        near = frozenset(j for i in way for j in skeleton_.below[i])
        pairs = skeleton_.matched(tree, self.shapes, near | frozenset(way))
        at, of = dict(pairs), {id(x): i for i, x in pairs}
        if not way or way[-1] not in at:
            return None
        depth = {id(at[i]): k for k, i in enumerate(way)}
        last = at[way[-1]]

        def stays(y: Node) -> bool:
            i = of.get(id(y))
            if i is not None and (i in fixed or i in minor):
                return False
            if y.tag in ("article", "main"):
                return 2 * y.words >= last.words
            return flowing(y) if i is None else not boilerplate(y) and not (y.words and y.links >= LINKS * y.words)

        def cut(x: Node) -> Node:
            if x is last:
                return x if x.tag in ("article", "main") else trimmed(x, of, fixed, minor)
            out = Node("div")
            out.children = [cut(y) if id(y) in depth else y for y in elements(x) if id(y) in depth or stays(y)]
            return out

        return cut(tree)


def extract(page: str, wrapper: dict | None) -> str:
    return Extractor().text(page, json.dumps(wrapper) if wrapper else None)


def induce(pages: list[str]) -> dict | None:
    """The wrapper of a few pages of one cluster; None for fewer than ``LEAST_PAGES`` different ones."""
    pages = sorted(set(pages))
    if len(pages) < LEAST_PAGES:
        return None
    made = Extractor()
    rows = skeleton(parse(pages[0]))
    of, told = Skeleton(rows, made.shapes), Statistics(rows)
    for p in pages:
        told.add(of.matched(measured(parse(p), made.shapes), made.shapes))
    return wrapper_of(rows, told.n, told.words, told.links, told.bits)


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[^:]*://([^/?#]*)", 1), F.lit("")))


def layout(html: str = "html") -> Column:
    """A digest of the set of a page's container tags with their classes, without digits."""
    tags = "div|section|article|main|nav|header|footer|aside|form"
    opened = F.array_distinct(F.regexp_extract_all(html, F.lit(f"(?i)<((?:{tags})(?:\\s[^>]*?class\\s*=\\s*[\"']?[^\"'>]*)?)[\\s>/\"']"), F.lit(1)))
    bare = F.split(F.regexp_replace(F.lower(F.array_join(opened, "<")), "\\s[^<]*?class\\s*=\\s*[\"']?|[0-9]+", " "), "<")
    return F.md5(F.array_join(F.array_sort(F.array_distinct(bare)), "<"))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps({"tree": skeleton(parse(x.as_py()))}) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(trees, pa.string())], ["host", "layout", "tree"])


_BITS = [f"b{i}" for i in range(32)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statistics of the pages of a task, a row for each cluster and node."""
    held: dict[tuple, Statistics] = {}
    one = Extractor()

    def told() -> pa.RecordBatch:
        cols: list[list] = [[], [], []]
        for (h, l), s in held.items():
            some = np.flatnonzero(s.n)
            cols[0] += [h] * len(some)
            cols[1] += [l] * len(some)
            cols[2].append(np.column_stack([some, s.n[some], s.words[some], s.links[some], s.bits[some]]))
        values = np.concatenate(cols[2]) if cols[2] else np.zeros((0, 36), dtype=np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(36))], ["host", "layout", "node", "n", "words", "links", *_BITS])

    for batch in batches:
        for h, l, tree, page in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "tree")), batch.column("html"), strict=True):
            one.bounded()
            of = one.wrapper(tree)[0]
            if (h, l) not in held:
                held[h, l] = Statistics(of.rows)
            held[h, l].add(of.matched(measured(parse(page.as_py()), one.shapes), one.shapes))
        if len(held) > CLUSTERS:
            yield told()
    yield told()


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for tree, nodes in zip(batch.column("tree").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
            rows = json.loads(tree)["tree"]
            s = Statistics(rows)
            for x in nodes:
                s.n[x["node"]], s.words[x["node"]], s.links[x["node"]], s.bits[x["node"]] = x["n"], x["words"], x["links"], x["bits"]
            made.append(json.dumps(wrapper_of(rows, s.n, s.words, s.links, s.bits)))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(made, pa.string())], ["host", "layout", "wrapper"])


def met(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with what ``found(host, layout, ...)`` has for their cluster: broadcast, or joined by host, layout and salt."""
    light = small(found)
    if light is not found:
        return pages.join(light, ["host", "layout"], "left")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "h"), F.lit(SALTS)).cast("int")).join(salted, ["host", "layout", "salt"], "left")


def wrappers(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``pages(page_id, host, layout, h, html)`` with each page's own cluster, and ``host, layout, wrapper`` (JSON) of every cluster."""
    raw = pages
    distinct = scratch.save(pages.groupBy("host", "layout", "h").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first")), "pages")
    sizes = distinct.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("ref")).where(F.col("n") >= LEAST_PAGES)
    sizes = scratch.save(sizes, "clusters")
    mains = sizes.groupBy("host").agg(F.max_by("layout", F.struct("n", "layout")).alias("main"))
    known = sizes.select("host", "layout", F.lit(True).alias("own"))
    pages = pages.join(small(known), ["host", "layout"], "left").join(small(mains), "host", "left")
    pages = pages.withColumn("layout", F.when(F.col("own"), F.col("layout")).otherwise(F.coalesce("main", "layout"))).drop("main")
    refs = sizes.select("host", "layout", F.col("ref").alias("h"))
    chosen = raw.select("html", "h").join(small(refs), "h").dropDuplicates(["host", "layout"])
    trees = scratch.save(chosen.select("host", "layout", "html").mapInArrow(_skeletons, "host string, layout string, tree string"), "trees")
    copied = scratch.save(distinct.where("copies > 1").select("host", "layout", "h", "first"), "copied")
    once = pages.where("own").join(small(copied), ["host", "layout", "h"], "left").where("first is null or first = page_id").drop("first")
    sums = met(once.select("page_id", "host", "layout", "h", "html"), trees).where("tree is not null").select("host", "layout", "tree", "html")
    sums = sums.mapInArrow(_sums, "host string, layout string, node long, n long, words long, links long, " + ", ".join(f"{b} long" for b in _BITS))
    sums = sums.groupBy("host", "layout", "node").agg(*(F.sum(c).alias(c) for c in ("n", "words", "links", *_BITS)))
    nodes = sums.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "n", "words", "links", F.array(*_BITS).alias("bits"))).alias("nodes"))  # one page's nodes
    made = nodes.join(trees, ["host", "layout"]).mapInArrow(_wrappers, "host string, layout string, wrapper string")
    return pages.drop("own"), scratch.save(made, "wrappers")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    spark = pages.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "html")
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    named = named.withColumns({"host": host(), "layout": layout(), "h": F.xxhash64("html")})
    placed, found = wrappers(named, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Extractor()
        for batch in batches:
            texts = [one.text(page.as_py(), w) for page, w in zip(batch.column("html"), batch.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met(placed, found).select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
