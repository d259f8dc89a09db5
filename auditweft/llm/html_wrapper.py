"""Main text of web pages by wrapper induction over the pages of each host.

1. Every page is parsed into a tree of block elements; like text elements side by side are one node.
2. The trees of a host are aligned by simple tree matching and folded into one wrapper tree, in
   groups first and then over the groups, so that no task holds all pages of a large host.
3. Every page is aligned with its host's wrapper. A block that stands in the same slot of half of a
   host's different pages (three at least) is template. Slots that vary are content, unless they draw
   from a stock: nearly all their texts, on this host and wherever the same elements lead to a block,
   stand on several pages whose longest blocks differ. Menus, adverts and notices that rotate do so;
   an article's text returns only in copies of the article. Slots of link text are no content either.
4. What the statistics leave open, names settle: blocks under an element or name of menus, headers,
   footers, adverts and the like are no content, unless most of a host's varying text has that name;
   reader comments never are. If a host has an article or main element with varying text, only
   that is content.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Generator, Iterator
from math import isqrt
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted

# Element roles and name hints.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math select button title".split())
TEXT = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd pre blockquote tr td th figcaption option".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog head".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HINT = re.compile(
    r"(?i)(?:^|[\s_\-#.])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|side\w*|widget\w*|cookie\w*|consent|gdpr|notices?|alert|"
    r"share\w*|social\w*|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|paywall|copyright|legal|pagination|pager|tags?|toolbar|search\w*)(?:$|[\s_\-#.\d])"
)
COMMENTS = re.compile(r"(?i)(?:^|[\s_\-#.])(?:comments?|comment-?list|respond|disqus|replies)(?:$|[\s_\-#.\d])")
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_STOP = re.compile(r"[>\"']")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Trees folded at a time.
GROUP = 64
#: Pairs of subtrees and cells of rows whose weights are remembered; others are weighed again.
MEMO = 1 << 20
#: Most bytes of wrappers sent to every executor at once.
BROADCAST_BYTES = 32 << 20


class Node:
    __slots__ = ("kids", "label", "number", "shape", "texts")

    def __init__(self, label: str):
        self.label, self.kids, self.number, self.shape = label, [], -1, -1
        self.texts: dict[str, Node] | None = None  # its text elements by label


def _label(tag: str, attrs: str) -> str:
    if not attrs or "=" not in attrs:
        return tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAME.finditer(attrs)}
    return tag + "".join("." + re.sub(r"\d+", "#", _SPACE.sub(".", found[k].strip())) for k in ("class", "id", "role") if found.get(k))


def markup(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, tag, attributes) of the page's markup; the caller may send where to go on.

    Every character is looked at a bounded number of times: a quote that nothing closes is no quote.
    """
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in "\"'>"}
    while m := _OPEN.search(page, at):
        tag, closing, attrs = m[2], bool(m[1]), ""
        at = m.end()
        if tag is None:
            end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            if end == ">" and at > last[">"]:
                continue
            k = page.find(end, at)
            at = k + len(end) if k >= 0 else n
        else:
            while (stop := _STOP.search(page, at)) and stop[0] != ">":
                at = page.index(stop[0], stop.end()) + 1 if last[stop[0]] >= stop.end() else stop.end()
            attrs = page[m.end() : stop.start() if stop else n]
            at = stop.end() if stop else n
        to = yield m.start(), at, closing, tag and tag.lower(), attrs
        if to is not None:
            at = to
            yield 0, 0, False, None, ""  # the answer to send


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int, int]]]:
    """Block tree of a page and its blocks in page order: (node, text, characters, of these in links)."""
    root = Node("root")
    stack: list[tuple[str, Node]] = [("root", root)]
    is_open: dict[str, int] = {}
    blocks: list[tuple[Node, str, int, int]] = []
    parts: list[tuple[str, bool]] = []
    links, at, n = 0, 0, len(page)

    def flush():
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in parts))).strip()
            if text:
                blocks.append((stack[-1][1], text, len(text), sum(len(t) for t, a in parts if a)))
            parts.clear()

    def close(least: int):
        for tag, _ in stack[least:]:
            is_open[tag] -= 1
        del stack[least:]

    tokens = markup(page)
    for start, end, closing, tag, attrs in tokens:
        if start > at:
            parts.append((page[at:start], links > 0))
        at = end
        if tag is None:
            continue
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                m = _ENDS[tag].search(page, at)
                at = m.end() if m else n
                tokens.send(at)
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if is_open.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                links = 0
            continue
        if stack[-1][0] == "p" and tag in CLOSES_P or tag == "li" and stack[-1][0] == "li":
            close(len(stack) - 1)
        top, label = stack[-1][1], _label(tag, attrs)
        node = (top.texts or {}).get(label) if tag in TEXT else None
        if node is None:
            node = Node(label)
            top.kids.append(node)
            if tag in TEXT:
                top.texts = top.texts or {}
                top.texts.setdefault(label, node)
        if not attrs.endswith("/"):
            stack.append((tag, node))
            is_open[tag] = is_open.get(tag, 0) + 1
    if at < n:
        parts.append((page[at:], links > 0))
    flush()
    return root, blocks


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out


class Shapes:
    """Numbers of subtrees: equal ones have one number."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []

    def number(self, root: Node) -> None:
        for node in reversed(preorder(root)):
            key = (node.label, tuple(k.shape for k in node.kids))
            if key not in self.known:
                self.known[key] = len(self.labels)
                self.labels.append(node.label)
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1]))
            node.shape = self.known[key]


def to_text(root: Node) -> str:
    """The tree in preorder, a line of depth and label for each node."""
    out, todo = [], [(0, root)]
    while todo:
        depth, node = todo.pop()
        out.append(f"{depth} {node.label}")
        todo += [(depth + 1, k) for k in reversed(node.kids)]
    return "\n".join(out)


def from_text(text: str) -> Node:
    path: list[Node] = []
    for line in text.split("\n"):
        depth, _, label = line.partition(" ")
        node = Node(label)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def numbered(root: Node) -> Node:
    for i, node in enumerate(preorder(root)):
        node.number = i
    return root


Weighing = Generator[tuple[int, int], int, Any]


def matched(n: int, m: int, weights: Callable[[int], Weighing]) -> Weighing:
    """(weight, pairs of places) of the best order-preserving matching of lists of n and m items.

    ``weights`` gives a place of the first list its weights with all places of the other; pairs that have to
    be weighed first are yielded. The rows of the recurrence are array operations. Only the first row of each
    block of rows is kept; on the way back the block's steps are found again, as bits, so that memory grows
    with m times the root of n.
    """
    size = max(64, isqrt(n))

    def row(i: int, last: np.ndarray) -> Weighing:
        w = yield from weights(i)
        diagonal = np.where(w > 0, last[:-1] + w, -1)
        out = np.zeros(m + 1, np.int64)
        np.maximum(last[1:], diagonal, out=out[1:])
        np.maximum.accumulate(out, out=out)
        return out, diagonal

    starts = [np.zeros(m + 1, np.int64)]
    for k in range(size, n, size):
        last = starts[-1]
        for i in range(k - size, k):
            last, _ = yield from row(i, last)
        starts.append(last)
    total, pairs = None, []
    i, j = n, m
    bit = lambda bits, k: bits[k >> 3] >> (7 - (k & 7)) & 1
    while i and j:
        first = (i - 1) // size * size
        last, steps = starts[first // size], []
        for k in range(first, i):
            last, diagonal = yield from row(k, last)
            steps.append((np.packbits(diagonal == last[1:]), np.packbits(last[:-1] == last[1:])))
        total = int(last[-1]) if total is None else total
        while i > first and j:
            up, left = steps[i - 1 - first]
            if bit(up, j - 1):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif bit(left, j - 1):
                j -= 1
            else:
                i -= 1
    return total or 0, pairs[::-1]


class Matcher:
    """Simple tree matching of subtrees, each pair of unlike ones weighed once, without recursion.

    Lists of any length and trees of any size are aligned by the same weights. Time grows with the pairs of
    unlike subtrees, memory doesn't: beyond MEMO pairs the remembered weights start anew.
    """

    def __init__(self, *roots: Node):
        self.shapes, self.known = Shapes(), {}
        for root in roots:
            self.shapes.number(root)
        labels: dict[str, int] = {}
        self.label = np.array([labels.setdefault(x, len(labels)) for x in self.shapes.labels])
        self.inner = np.array([bool(k) for k in self.shapes.kids])

    def _middle(self, a, b) -> tuple[int, int, int]:
        """(equal children at the start, ends of the rest of both): like children at both ends match in some best matching."""
        lo, n, m = 0, len(a), len(b)
        while lo < min(n, m) and a[lo] == b[lo]:
            lo += 1
        while n > lo and m > lo and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
        return lo, n, m

    def _rows(self, a, b) -> Callable[[int], Weighing]:
        """Weights of children by their subtrees."""
        other = np.array(b, np.int64)
        label, inner = self.label[other], self.inner[other]
        made: dict[int, np.ndarray] = {}

        def row(i: int) -> Weighing:
            x = a[i]
            if x in made:
                return made[x]
            alike = label == self.label[x]
            w = alike * np.where(other == x, self.shapes.sizes[x], 1)
            if self.inner[x]:  # a subtree without children matches by its root alone
                places = np.flatnonzero(alike & inner & (other != x))
                ys = other[places].tolist()
                found = {}
                for y in dict.fromkeys(ys):
                    known = self.known.get((x, y))
                    found[y] = (yield x, y) if known is None else known
                w[places] = [found[y] for y in ys]
            if len(made) * len(b) <= MEMO:
                made[x] = w
            return w

        return row

    def _weighed(self, x: int, y: int) -> Weighing:
        """Size of the largest order-preserving matching of two subtrees; 0 unless their roots match."""
        if x == y or self.label[x] != self.label[y]:
            return self.shapes.sizes[x] if x == y else 0
        a, b = self.shapes.kids[x], self.shapes.kids[y]
        lo, n, m = self._middle(a, b)
        out = 1 + sum(self.shapes.sizes[k] for k in (*a[:lo], *a[n:]))
        if n > lo and m > lo:
            out += (yield from matched(n - lo, m - lo, self._rows(a[lo:n], b[lo:m])))[0]
        if len(self.known) >= MEMO:
            self.known.clear()
        self.known[x, y] = out
        return out

    def _run(self, work: Weighing):
        """What ``work`` returns; the pairs that it yields are weighed first, on a stack of their own."""
        todo, value = [work], None
        while todo:
            try:
                pair = todo[-1].send(value)
            except StopIteration as end:
                todo.pop()
                value = end.value
            else:
                todo.append(self._weighed(*pair))
                value = None
        return value

    def weight(self, x: int, y: int) -> int:
        return self._run(self._weighed(x, y))

    def aligned(self, x: Node, y: Node) -> list[tuple[Node | None, Node | None]]:
        """Children of two matched nodes in order, paired where simple tree matching pairs them."""
        a, b = [k.shape for k in x.kids], [k.shape for k in y.kids]
        lo, n, m = self._middle(a, b)
        pairs = [(i, i) for i in range(lo)]
        if n > lo and m > lo:
            pairs += [(lo + i, lo + j) for i, j in self._run(matched(n - lo, m - lo, self._rows(a[lo:n], b[lo:m])))[1]]
        pairs += [(n + k, m + k) for k in range(len(a) - n)]
        out: list[tuple[Node | None, Node | None]] = []
        i = j = 0
        for p, q in [*pairs, (len(a), len(b))]:
            out += [(k, None) for k in x.kids[i:p]] + [(None, k) for k in y.kids[j:q]]
            if p < len(a):
                out.append((x.kids[p], y.kids[q]))
            i, j = p + 1, q + 1
        return out


def match(a: Node, b: Node) -> int:
    """Size of the largest order-preserving matching of two trees whose roots agree."""
    return Matcher(a, b).weight(a.shape, b.shape) if a.label == b.label else 0


def merge(wrapper: Node, tree: Node) -> Node:
    """The wrapper with the tree's unmatched nodes put in at their places."""
    matcher = Matcher(wrapper, tree)
    todo = [(wrapper, tree)]
    while todo:
        a, b = todo.pop()
        pairs = matcher.aligned(a, b)
        a.kids = [x or y for x, y in pairs]
        todo += [(x, y) for x, y in pairs if x and y and x.shape != y.shape]
    return wrapper


def slots(wrapper: Node, tree: Node) -> dict[int, int]:
    """Number of the wrapper node of every matched tree node (by the tree's numbers)."""
    matcher = Matcher(wrapper, tree)
    out = {tree.number: wrapper.number}
    todo = [(wrapper, tree)]
    while todo:
        a, b = todo.pop()
        if a.shape == b.shape:
            out.update((y.number, x.number) for x, y in zip(preorder(a), preorder(b)))
            continue
        for x, y in matcher.aligned(a, b):
            if x and y:
                out[y.number] = x.number
                todo.append((x, y))
    return out


def outside(wrapper: Node) -> tuple[set[int], dict[int, int], set[int]]:
    """(numbers of the wrapper's nodes whose element or name of comments marks them as no content, those under
    another telling name with the topmost node of that name, those in an article)."""
    out, named, article = set(), {}, set()
    todo = [(wrapper, False, -1, False)]
    while todo:
        node, off, top, inside = todo.pop()
        tag, _, name = node.label.partition(".")
        inside = inside or tag in ("article", "main")
        off = off or tag in OUTSIDE or bool(name and tag != "article" and COMMENTS.search("." + name))
        if top < 0 and name and tag != "article" and HINT.search("." + name):
            top = node.number
        if off:
            out.add(node.number)
        elif top >= 0:
            named[node.number] = top
        if inside:
            article.add(node.number)
        todo += [(k, off, top, inside) for k in node.kids]
    return out, named, article


def content(wrapper: Node, weights: dict[int, int], marks: set[int], names: bool = True, articles: bool = True) -> tuple[set[int], set[int]]:
    """(slots that are no content, the slots outside which nothing is content, if any).

    ``weights`` are the characters of varying text by slot, ``marks`` the slots that statistics turn down.
    """
    off, named, article = outside(wrapper)
    if names:
        held: dict[int, int] = {}
        for slot, chars in weights.items():
            if slot in named and slot not in marks:
                held[named[slot]] = held.get(named[slot], 0) + chars
        rest = sum(n for slot, n in weights.items() if slot not in off and slot not in marks)
        off |= {slot for slot, top in named.items() if 2 * held.get(top, 0) <= rest or not rest}
    off |= marks
    return off, article if articles and article & weights.keys() - off else set()


def _fold(table: pa.Table) -> pa.Table:
    trees = sorted(table.column("tree").to_pylist())
    wrapper = from_text(trees[0])
    for t in trees[1:]:
        merge(wrapper, from_text(t))
    return pa.table([pa.array([table.column("host")[0].as_py()]), pa.array([to_text(wrapper)])], names=["host", "tree"])


def _wrappers(trees: DataFrame) -> DataFrame:
    """One wrapper a host, folded from groups of trees in as many rounds as its trees need."""
    while True:
        sizes = trees.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        most = sizes.agg(F.max("parts").alias("n")).first()["n"] or 1
        dealt = trees.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("tree"), F.col("parts")))
        trees = persisted(dealt.select("host", "part", "tree").groupBy("host", "part").applyInArrow(_fold, "host string, tree string"), "wrappers")
        if most == 1:
            return trees


def _shared(wrappers: DataFrame) -> DataFrame:
    """Wrappers marked for sending to every executor, if their bytes are few; else a join shuffles them."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) if t == "string" else 40 * F.greatest(F.size(c), F.lit(0)) for c, t in wrappers.dtypes), F.lit(100))
    return F.broadcast(wrappers) if (wrappers.agg(F.sum(size).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES else wrappers


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    return zlib.crc32(raw) << 31 | (zlib.adler32(raw) & 0x7FFFFFFF)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def _trees(own: DataFrame) -> DataFrame:
    """Per page: host, page fingerprint, tree, its blocks as (node number, hash, characters, in links, hash of the
    elements that lead there), and the hash of its longest block outside of menus, footers and the like."""

    def described(root: Node, blocks) -> tuple[list[dict], int]:
        at: dict[Node, tuple[int, bool]] = {}
        todo = [(root, 0, False)]
        while todo:
            node, above, off = todo.pop()
            at[node] = own = _hash(f"{above}/{node.label}"), off or node.label.partition(".")[0] in OUTSIDE
            todo += [(k, *own) for k in node.kids]
        rows = [{"node": b.number, "h": _hash(t), "n": n, "l": k, "path": at[b][0]} for b, t, n, k in blocks]
        return rows, max(((not at[b][1], r["n"], r["h"]) for (b, *_), r in zip(blocks, rows)), default=(0, 0, 0))[2]

    def run(batches):
        for batch in batches:
            rows = []
            for h in batch.column(1).to_pylist():
                root, blocks = parse(h)
                numbered(root)
                rows.append((_hash(h), to_text(root), *described(root, blocks)))
            kind = pa.list_(pa.struct([("node", pa.int32()), *((c, pa.int64()) for c in ("h", "n", "l", "path"))]))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), kind, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["host", "page", "tree", "blocks", "main"])

    return own.select("host", "html").mapInArrow(run, "host string, page long, tree string, blocks array<struct<node:int,h:long,n:long,l:long,path:long>>, main long")


class _Aligner:
    """Alignments of page trees with wrappers, remembered by both texts."""

    def __init__(self):
        self.known: dict[tuple[str, str], dict[int, int]] = {}

    def __call__(self, wrapper: str, tree: str) -> dict[int, int]:
        key = (wrapper, tree)
        if key not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            self.known[key] = slots(numbered(from_text(wrapper)), numbered(from_text(tree)))
        return self.known[key]


def _spread(big: DataFrame, by: str, small: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """Left join of rows with one row a key, in parts by another column, so that a frequent key is many tasks."""
    copies = small.withColumn("_part", F.explode(F.array(*map(F.lit, range(parts)))))
    return big.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(copies, [*keys, "_part"], "left").drop("_part")


def induce(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 3, share: float = 0.5, link_share: float = 0.6, stock_share: float = 0.9
) -> DataFrame:
    """Per host: tree (the wrapper), template (slot:hash of constant blocks), marks (slots of link text, and
    those that draw from a stock of texts), vary (characters of varying text by slot)."""
    seen = persisted(_trees(_pages(pages, id_col, url_col, html_col)).dropDuplicates(["host", "page"]), "trees")
    trees = seen.select("host", "tree").distinct()
    wrappers = _wrappers(trees)
    names = ["slot", "h", "path", "main", "n", "l"]

    def place(batches):
        align = _Aligner()
        for batch in batches:
            host, rows = [], []
            for name, tree, wrapper, blocks, main in zip(*(batch.column(i).to_pylist() for i in range(5))):
                at = align(wrapper, tree)
                own: dict[tuple[int, int, int], list[int]] = {}
                for b in blocks:
                    s = own.setdefault((at.get(b["node"], -1), b["h"], b["path"]), [0, 0])
                    s[0] += b["n"]
                    s[1] += b["l"]
                host += [name] * len(own)
                rows += [(*key, main, *sums) for key, sums in own.items()]
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["host", *names])

    few = _shared(wrappers)
    schema = "host string, " + ", ".join(f"{c} long" for c in names)
    placed = seen.join(few.withColumnRenamed("tree", "wrapper"), "host").select("host", "tree", "wrapper", "blocks", "main").mapInArrow(place, schema)
    sums = [F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("l").alias("l"), F.min("main").alias("least"), F.max("main").alias("most")]
    blocks = persisted(placed.groupBy("host", "slot", "h", "path").agg(*sums), "blocks")
    # texts of a stock: on several pages, with different longest blocks
    stock = blocks.groupBy("path", "h").agg(F.sum("pages").alias("all"), F.min("least").alias("least"), F.max("most").alias("most"))
    stock = stock.filter((F.col("all") >= least_pages) & (F.col("least") < F.col("most"))).select("path", "h", F.lit(True).alias("again"))
    # a host's blocks meet its number of pages in parts, so that no task gets all of a large host's
    total = seen.groupBy("host").agg(F.count("*").alias("total"))
    met = _spread(blocks.drop("least", "most"), "host", stock, ["path", "h"]).withColumn("place", F.xxhash64("slot", "h"))
    marked = _spread(met, "place", total, ["host"]).withColumn("fixed", (F.col("pages") >= least_pages) & (F.col("pages") >= F.col("total") * share))
    again = F.sum(F.when(F.col("again"), F.col("pages")).otherwise(0))
    marked = persisted(marked.drop("place", "total"), "marked")
    everywhere = marked.groupBy("path").agg((again / F.sum("pages")).alias("path_again"))
    # a slot's blocks share one way of elements
    per_slot = marked.groupBy("host", "slot").agg(
        F.min("path").alias("path"), F.sum("n").alias("n"), F.sum("l").alias("l"), (again / F.sum("pages")).alias("slot_again"), F.sum(F.when(~F.col("fixed"), F.col("n"))).alias("vary")
    )
    per_slot = _spread(per_slot, "host", everywhere, ["path"])
    # at most 1/share constant blocks stand in one place, so a host's lists are bounded by its wrapper
    fixed = marked.filter("fixed").groupBy("host").agg(F.collect_set(F.concat_ws(":", "slot", "h")).alias("template"))
    turned_down = (F.col("l") > F.col("n") * link_share) | (F.col("slot_again") >= stock_share) & (F.col("path_again") >= stock_share)
    slots_of = per_slot.groupBy("host").agg(
        F.collect_list(F.when(turned_down, F.col("slot"))).alias("marks"), F.collect_list(F.when(F.col("vary").isNotNull(), F.struct("slot", "vary"))).alias("vary")
    )
    return persisted(wrappers.join(fixed, "host", "left").join(slots_of, "host", "left"), "hosts")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrappers: DataFrame | None = None, names: bool = True, articles: bool = True) -> DataFrame:
    """Per row: page_id, url, text (blocks in page order joined by one space), n_chars.

    A null page is empty; pages without a host share one wrapper. Pages that are exact copies count
    once when template and content are told apart, so a host of copies keeps its text. If a page has
    no content slot its text is ''. Repeated rows and null ids are kept; other columns are ignored.
    ``names`` and ``articles`` say whether names and article elements settle what alignment leaves open.
    """
    own = _pages(pages, id_col, url_col, html_col)
    hosts = induce(pages, id_col, url_col, html_col) if wrappers is None else wrappers
    few = _shared(hosts)

    def run(batches):
        align, roles = _Aligner(), {}
        for batch in batches:
            texts = []
            for host, page, wrapper, template, marks, vary in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
                root, blocks = parse(page)
                if not blocks or wrapper is None:
                    texts.append("")
                    continue
                numbered(root)
                at = align(wrapper, to_text(root))
                if host not in roles:
                    if len(roles) > 2000:
                        roles.clear()
                    weights = {v["slot"]: v["vary"] for v in vary or ()}
                    roles[host] = *content(numbered(from_text(wrapper)), weights, set(marks or ()), names, articles), set(template or ())
                off, only, template = roles[host]
                keep = []
                for b, t, _, _ in blocks:
                    slot = at.get(b.number, -1)
                    if slot in off or only and slot not in only or f"{slot}:{_hash(t)}" in template:
                        continue
                    keep.append(t)
                texts.append(" ".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = own.join(few.withColumnRenamed("tree", "wrapper"), "host", "left").select("page_id", "url", "host", "html", "wrapper", "template", "marks", "vary")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
