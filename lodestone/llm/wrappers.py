"""Main text of pages by wrapper induction: what the pages of a host have in common is template.

A page becomes a tree of its block elements, labelled by tag, class, id and role. Neighbours of one
label are one node with repeats. Trees of a host are aligned by simple tree matching (the most nodes
that can be paired with parents and order kept), and what is aligned becomes one node of the wrapper,
which counts its pages and knows whether its text was the same on all of them. Text that three pages or
more share, while their longest blocks differ, is template; nodes whose text varies are slots. Of the
slots those of menus, adverts, forms, comments and the like (by tag and by words in class, id or role)
and lists that are mostly links are no content. The content's region is the wrapper's article or main
elements if it has any, else the smallest element that holds most of the varying text, with its title.

How the work is dealt. Only trees travel, with a hash of each node's text, never the pages. A task
makes one of all trees of a host that are equal; equal ones of all tasks are joined next (sums, exact
in any order), and different ones are aligned `FAN_IN` at a time, level by level, so the pages of a hot
host never meet in one task. The wrappers are then sent to the pages: broadcast up to `MOST_BYTES`,
else by a join on host. A task aligns each kind of tree with its host's wrapper once.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, written

FAN_IN, MOST_BYTES = 256, 32 << 20
#: Elements nested deeper than this count as part of the one at this depth; trees kept by a task.
DEEPEST, KEPT = 150, 20_000
#: Pages that must share a text, and the share of links that makes a list a menu.
LEAST_PAGES, LINKS = 3, 0.5

BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
#: Elements and words of class, id and role that mark what is not the text of the page.
ASIDE_TAGS = frozenset("aside button canvas dialog fieldset footer form head menu nav object optgroup option search select svg textarea".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: What a start tag closes, up to the elements that keep it open.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_P_SCOPE = frozenset("button caption html object table td th body article".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element of a page or of a wrapper. digest: of its own text, None if that differs between its
    pages; witnesses: the least and greatest hash of the longest blocks of its pages."""

    __slots__ = ("label", "kids", "pages", "digest", "low", "high", "chars", "links", "_shape", "size", "of")

    def __init__(self, label: str, kids: list[Node], pages: int = 1, digest: int | None = 0, low: int = 0, high: int = 0, chars: int = 0, links: int = 0):
        self.label, self.kids, self.pages, self.digest, self.low, self.high, self.chars, self.links = label, kids, pages, digest, low, high, chars, links
        self._shape = self.of = None

    @property
    def shape(self) -> str:
        if self._shape is None:
            self._shape = f"{self.label}({','.join(k.shape for k in self.kids)})"
            self.size = 1 + sum(k.size for k in self.kids)
        return self._shape

    def dump(self) -> list:
        return [self.label, self.pages, self.digest, self.low, self.high, self.chars, self.links, [k.dump() for k in self.kids]]

    def each(self) -> Iterator[Node]:
        yield self
        for k in self.kids:
            yield from k.each()


def load(of: list) -> Node:
    return Node(of[0], [load(k) for k in of[7]], *of[1:7])


def label_of(tag: str, attributes: str) -> str:
    """The tag and the words of class, id and role, numbers aside."""
    words = sorted({w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")}) if attributes else ()
    return ".".join((tag, *words))


def parsed(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of a page's block elements, and its blocks of text in order with the element that each
    is in and the characters of it in links."""
    root = Node("", [])
    stack, nodes = [""], [root]  # open elements; for each the block element that it is or is in
    blocks, words, linked, in_link, at = [], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            blocks.append((nodes[-1], text, min(linked, len(text))))
        words.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal in_link
        if any(a is not b for a, b in zip(nodes[i:], nodes[i - 1 :])):
            flush()
        in_link -= stack[i:].count("a")
        del stack[i:], nodes[i:]

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        words.append(text)
        if in_link:
            linked += len("".join(text.split()))

    tokens = _TOKEN.scanner(page)
    while m := tokens.search():
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            if tag in stack:
                i = len(stack) - 1 - stack[::-1].index(tag)
                if tag in BLOCKS or BLOCKS.isdisjoint(stack[i:]):
                    close(i)
                else:  # what is open above it stays open
                    in_link -= tag == "a"
                    del stack[i], nodes[i]
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            at = end.end()
            tokens = _TOKEN.scanner(page, at)
            continue
        if tag in BLOCKS:
            opened, kept = _CLOSES.get(tag, (None, ()))
            if opened:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i] in kept:
                        break
                    if stack[i] in opened:
                        close(i)
            if "p" in stack:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i] == "p":
                        close(i)
                        break
                    if stack[i] in _P_SCOPE:
                        break
            flush()
            if tag in VOID:
                continue
            if len(stack) <= DEEPEST:
                node = Node(label_of(tag, attributes), [])
                nodes[-1].kids.append(node)
            else:
                node = nodes[-1]
            stack.append(tag)
            nodes.append(node)
        elif tag == "br":
            words.append(" ")
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(tag)
            nodes.append(nodes[-1])
            in_link += tag == "a"
    if at < len(page):
        say(page[at:])
    flush()
    return root, blocks


def tree(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """A page's tree with repeats made one, and its blocks in order, each with its node of the tree."""
    root, blocks = parsed(page)
    texts: dict[int, list[str]] = {}
    longest = xxhash.xxh64_intdigest(max((t for _, t, _ in blocks), key=len, default="")) >> 1
    for node, text, linked in blocks:
        texts.setdefault(id(node), []).append(text)
        node.chars += len(text)
        node.links += linked
    for node in root.each():
        node.low = node.high = longest
        if id(node) in texts:
            node.digest = xxhash.xxh64_intdigest("\n".join(texts[id(node)])) >> 1
    folded = _folded(root)
    return folded, [(_home(node), text) for node, text, _ in blocks]


def _home(node: Node) -> Node:
    """The node that a node was made part of, and all on the way to it told so."""
    way = []
    while node.of is not None:
        way.append(node)
        node = node.of
    for n in way:
        n.of = node
    return node


def _folded(node: Node) -> Node:
    """Neighbours of one label made one, from the leaves upwards; on one page, so pages stay one."""
    kids: list[Node] = []
    for label, run in groupby(map(_folded, node.kids), key=lambda k: k.label):
        same = list(run)
        out = same[0]
        if len(same) > 1:
            if any(k.kids for k in same):
                for k in same[1:]:
                    out = merged(out, k)
                for n in out.each():
                    n.pages = 1
            else:
                out = Node(label, [], 1, 0, out.low, out.high, sum(k.chars for k in same), sum(k.links for k in same))
                for k in same:
                    k.of = out
            out.digest = xxhash.xxh64_intdigest(" ".join(str(k.digest) for k in same)) >> 1
        kids.append(out)
    node.kids = kids
    return node


def pairs(a: list[Node], b: list[Node], known: dict) -> list[tuple[Node | None, Node | None]]:
    """Two rows of siblings aligned so that the most nodes are paired, in order; unpaired ones between."""
    if [x.shape for x in a] == [x.shape for x in b]:
        return list(zip(a, b))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            row[j + 1] = max(above[j + 1], row[j], above[j] + matched(x, y, known) if x.label == y.label else 0)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1].label == b[j - 1].label and best[i][j] == best[i - 1][j - 1] + matched(a[i - 1], b[j - 1], known):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif j and (not i or best[i][j] == best[i][j - 1]):
            j -= 1
            out.append((None, b[j]))
        else:
            i -= 1
            out.append((a[i], None))
    return out[::-1]


def matched(a: Node, b: Node, known: dict) -> int:
    """Simple tree matching: the number of pairs of nodes of two trees whose roots have one label."""
    if a.shape == b.shape:
        return a.size
    if not a.kids or not b.kids:
        return 1
    key = (id(a), id(b))
    if key not in known:
        row = [0] * (len(b.kids) + 1)
        for x in a.kids:
            corner = 0
            for j, y in enumerate(b.kids):
                here = corner + matched(x, y, known) if x.label == y.label else 0
                corner, row[j + 1] = row[j + 1], max(row[j + 1], row[j], here)
        known[key] = 1 + row[-1]
    return known[key]


def merged(a: Node, b: Node, known: dict | None = None) -> Node:
    """One node of two of the same label, their subtrees aligned. The given ones point to it."""
    known = {} if known is None else known
    kids = [merged(x, y, known) if x and y else x or y for x, y in pairs(a.kids, b.kids, known)]
    out = Node(a.label, kids, a.pages + b.pages, a.digest if a.digest == b.digest else None, min(a.low, b.low), max(a.high, b.high), a.chars + b.chars, a.links + b.links)
    a.of = b.of = out
    return out


def aside(node: Node) -> bool:
    """Whether tag or words say that an element is no part of the text. An element that holds an
    article is never one by its words alone."""
    tag, *words = node.label.split(".")
    if tag in ASIDE_TAGS:
        return True
    if tag in ("", "html", "body", "main") or not ASIDE_WORDS.intersection(words):
        return False
    return not any(n.label.split(".")[0] in ("article", "main") for k in node.kids for n in k.each())


def template(node: Node) -> bool:
    """Whether a node's own text is the host's: the same on its pages, which differ otherwise."""
    return node.digest is not None and node.pages >= LEAST_PAGES and node.low != node.high


def decided(wrapper: Node) -> list[bool]:
    """For each node of a wrapper in order of depth-first traversal, whether its own text is content."""
    keep: dict[int, bool] = {}
    mass: dict[int, int] = {}

    def weigh(node: Node, out: bool, in_article: bool) -> tuple[int, int, int]:
        tag = node.label.split(".")[0]
        out = out or aside(node) or (tag == "header" and not in_article)
        sums = [node.chars, node.links, 0 if out or template(node) else node.chars - node.links]
        for k in node.kids:
            for i, x in enumerate(weigh(k, out, in_article or tag in ("article", "main"))):
                sums[i] += x
        if not in_article and tag in ("ul", "ol", "dl", "table", "div", "section") and sums[0] and sums[1] > LINKS * sums[0]:
            sums[2] = 0
            for n in node.each():
                keep[id(n)] = False
        keep.setdefault(id(node), not out and not template(node))
        mass[id(node)] = sums[2]
        return tuple(sums)

    def articles(node: Node) -> list[Node]:
        if aside(node):
            return []
        if node.label.split(".")[0] == "article":
            return [node]
        inner = [a for k in node.kids for a in articles(k)]
        return inner or ([node] if node.label.split(".")[0] == "main" else [])

    def titled(node: Node) -> bool:
        return any(n.label.split(".")[0] == "h1" for n in node.each())

    weigh(wrapper, False, False)
    regions = [a for a in articles(wrapper) if mass[id(a)]]
    if not regions:
        node = wrapper
        while node.kids:
            top = max(node.kids, key=lambda k: mass[id(k)])
            if top.label.split(".")[0] not in ("html", "body", "div", "section", "center", "table", "tbody", "tr", "td") or mass[id(top)] < 0.6 * mass[id(node)] or (titled(node) and not titled(top)):
                break
            node = top
        regions = [node]
    inside = {id(n) for r in regions for n in r.each()}
    return [keep[id(n)] and id(n) in inside for n in wrapper.each()]


def extracted(page: str, wrapper: tuple[Node, list[bool]] | None, known: dict) -> str:
    """The content of a page, a block a line. known: a task's decisions by wrapper and tree."""
    root, blocks = tree(page)
    key = (id(wrapper), root.shape)
    if key not in known:
        if len(known) >= KEPT:
            known.clear()
        known[key] = _transferred(root, wrapper)
    keep = dict(zip(map(id, root.each()), known[key]))
    return "\n".join(text for node, text in blocks if keep[id(node)])


def _transferred(root: Node, wrapper: tuple[Node, list[bool]] | None) -> list[bool]:
    """The wrapper's decisions for the nodes of one tree; its own where the wrapper has none."""
    own = decided(root)
    if wrapper is None:
        return own
    keep = dict(zip(map(id, wrapper[0].each()), wrapper[1]))
    got: dict[int, bool] = {}

    def go(a: Node, b: Node) -> None:
        got[id(b)] = keep[id(a)]
        for x, y in pairs(a.kids, b.kids, cache):
            if x and y:
                go(x, y)

    cache: dict = {}
    go(wrapper[0], root)
    out = [got.get(id(n), mine) for n, mine in zip(root.each(), own)]
    return out if any(out) else own


def host_of(url: Column) -> Column:
    """What stands between :// and the path, in lower case; empty for null and without ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(F.lower(url), "://([^/?#]*)", 1)).otherwise(F.lit(""))


def induced(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, wrapper: one row for each host, its wrapper as text. Pages without a host share nothing."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(page), F.lit("")).alias("page")).where("host <> ''")
    trees = rows.mapInArrow(_trees, "host string, shape bigint, tree string")
    salted = trees.withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(64)))
    kinds = salted.groupBy("host", "shape", "salt").applyInArrow(_joined, "host string, shape bigint, tree string").groupBy("host", "shape").applyInArrow(_joined, "host string, shape bigint, tree string")
    kinds = written(kinds, "trees")
    most = kinds.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    left = -(-most // FAN_IN)
    kinds = kinds.withColumn("shape", F.pmod(F.col("shape"), F.lit(max(left, 1))))
    while True:
        kinds = kinds.groupBy("host", "shape").applyInArrow(_joined, "host string, shape bigint, tree string")
        if left <= 1:
            return kinds.select("host", F.col("tree").alias("wrapper"))
        left = -(-left // FAN_IN)
        kinds = kinds.withColumn("shape", F.expr(f"shape div {FAN_IN}"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's trees, equal ones of a host joined."""
    for batch in batches:
        found: dict[tuple[str, str], Node] = {}
        for host, page in zip(batch["host"].to_pylist(), batch["page"].to_pylist()):
            node, _ = tree(page)
            key = host, node.shape
            found[key] = merged(found[key], node) if key in found else node
        yield _rows([(host, _signed(shape), node) for (host, shape), node in found.items()])


def _signed(shape: str) -> int:
    return xxhash.xxh64_intdigest(shape) >> 1


def _rows(found: list[tuple[str, int, Node]]) -> pa.RecordBatch:
    columns = zip(*[(h, s, json.dumps(n.dump(), separators=(",", ":"))) for h, s, n in found]) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["host", "shape", "tree"])


def _joined(got: pa.Table) -> pa.Table:
    """One tree of a group's, the commonest first, so that the rarer are fitted to it."""
    nodes = sorted((load(json.loads(t)) for t in got["tree"].to_pylist()), key=lambda n: (-n.pages, n.shape, json.dumps(n.dump())))
    out = nodes[0]
    for n in nodes[1:]:
        out = merged(out, n)
    return pa.Table.from_batches([_rows([(got["host"][0].as_py(), got["shape"][0].as_py(), out)])])


def extract(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text", wrappers: DataFrame | None = None) -> DataFrame:
    """All rows of pages and their columns, `text` added: the content, a block a line, references
    decoded and white space within a block made one space. Null, empty and markup-only pages give an
    empty text. Pages without a host, and hosts of fewer than three pages, go by tags, names and links
    alone. Equal rows give equal texts, and no order is asked of them; a column named like `text` is
    replaced. wrappers: those of `induced`, of these pages if not given."""
    wrappers = written(induced(pages, url, page) if wrappers is None else wrappers, "wrappers")
    held = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0))).first()[0]
    frame = pages.drop(text)
    host, key, wrapper = fresh(frame, "host", "of_host", "wrapper")
    side = wrappers.select(F.col("host").alias(key), F.col("wrapper").alias(wrapper))
    joined = frame.withColumn(host, host_of(F.col(url)))
    joined = joined.join(F.broadcast(side) if held <= MOST_BYTES else side, F.col(host) == F.col(key), "left").drop(host, key)
    schema = StructType([*frame.schema.fields, StructField(text, StringType())])
    return joined.mapInArrow(lambda batches: _extract(batches, page, wrapper, text), schema)


def _extract(batches: Iterator[pa.RecordBatch], page: str, wrapper: str, text: str) -> Iterator[pa.RecordBatch]:
    loaded: dict[str | None, tuple[Node, list[bool]] | None] = {None: None}
    known: dict = {}
    for batch in batches:
        at = batch.schema.get_field_index(wrapper)
        own = batch.column(at).dictionary_encode()
        if len(loaded) > KEPT:
            loaded, known = {None: None}, {}
        for w in own.dictionary.to_pylist():
            if w not in loaded:
                node = load(json.loads(w))
                loaded[w] = node, decided(node)
        by = [loaded[w] for w in own.dictionary.to_pylist()]
        which = np.where(own.indices.is_null().to_numpy(zero_copy_only=False), -1, own.indices.fill_null(0).to_numpy())
        out = [extracted(p or "", by[w] if w >= 0 else None, known) for p, w in zip(batch[page].to_pylist(), which)]
        rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(out, pa.string())], [*[n for n, _ in rest], text])
