"""Main text of pages by wrapper induction.

A page becomes a tree of block elements; runs of equal siblings (list items, paragraphs) are one
node. The pages of a host share few distinct trees, whose counts, text fingerprints and text sizes are summed up
before anything is shuffled. Per host, all trees are aligned by simple tree matching and merged into one
wrapper, in groups whose wrappers are merged in turn; then every tree is aligned with its host's wrapper.

On hosts with LEAST_PAGES different pages the slots of the wrapper decide: a slot with one text on
all its pages, or with few texts that come back while the main text doesn't, is template; the others vary.
The region of the article is the smallest container that holds MOST of a tree's varying text, and its varying slots
(and varying headings of the first level) are the main text. HTML's own elements for menus, footers, forms and the like
are no part of it; names (classes and the like) only tell varying adverts and comments inside the region from the article.
Pages of hosts with fewer pages have no wrapper: their elements and names decide alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import lean, rows_of, stage, table

LEAST_PAGES = 5
#: A text that comes back on so many pages on average is a template's variant, if the main text is another on three of four pages.
VARIANT = 4
#: The part of a tree's varying text that the article's region holds at least.
MOST = 0.75
#: Elements that are nested deeper count as the one at this depth.
DEPTH = 150
#: Trees (or wrappers of trees) of a host that are merged by one task, about.
TREES = 500
#: Bytes of slots that are sent to every executor at most, about; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Cells of a table of siblings that is held whole; larger ones are halved until they fit.
TABLE = 1 << 22

# HTML's element groups, and words by which sites mark what isn't the article.
BLOCKS = frozenset("html head body title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button textarea noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
DROPPED = frozenset("head title nav footer aside form menu dialog header button select option optgroup textarea noscript iframe template object svg canvas audio video fieldset legend".split())
MAIN = frozenset(("article", "main"))
CLOSES_P = BLOCKS - frozenset("html head body title option optgroup button textarea noscript iframe template li dd dt td th tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPES = frozenset("ul ol menu dl table body html article section div".split())
MARKS = frozenset("nav navbar navigation menu header masthead footer contentinfo sidebar aside complementary ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe signup login popup modal overlay dialog form search searchform widget toolbar pagination pager skip".split())
COMMENTS = frozenset("comment comments commentlist respond disqus discussion replies reviews".split())
#: Elements of running text: they are left out only if all of their names are such marks.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th".split())
APART = frozenset(("div", "section", "td", "table"))
#: Elements that can't be the region of an article.
NO_REGION = RUNNING | frozenset("ul ol dl figure figcaption address summary caption header".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</?\Z|</[^a-zA-Z>][^>]*>?", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z0-9]+")


class Names(NamedTuple):
    """Words by which sites name what isn't the article, and the article itself."""

    marks: frozenset[str] = MARKS
    comments: frozenset[str] = COMMENTS
    main: frozenset[str] = MAIN


NAMES = Names()


class Node:
    __slots__ = ("children", "label", "slot")

    def __init__(self, label: str):
        self.label, self.children, self.slot = label, [], -1


class Open(NamedTuple):
    tag: str
    node: Node
    dropped: int  # 0: no; 1: by its names; 2: by its element, or as comments
    main: bool
    never: bool  # by its element (other than a header), or as comments
    marked: bool  # by its names


class Block(NamedTuple):
    node: Node
    text: str
    dropped: bool  # what elements and names say by themselves
    main: bool
    never: bool
    marked: bool


def _opened(tag: str, attributes: str, above: Open, known: Names) -> Open:
    names = " ".join(m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)).lower() if attributes.strip() else ""
    words = set(NAME.findall(names))
    label = f"{tag}.{names.strip()}" if names and not re.search(r"\d", names) else tag
    is_main, dropped = tag in known.main or ("main" in words & known.main and tag in APART), above.dropped
    if is_main and dropped == 1:
        dropped = 0
    inside = above.main or is_main
    comments = bool(words & known.comments) and tag not in ("html", "body", "main")
    names_it = tag not in ("html", "body") and not is_main and bool(words & known.marks) and not (inside and words & known.marks <= {"header"}) and (tag not in RUNNING or words <= known.marks)
    if (tag in DROPPED and not (tag == "header" and inside)) or comments:
        dropped = 2
    elif not dropped and names_it:
        dropped = 1
    siblings = above.node.children
    if siblings and siblings[-1].label == label and tag not in APART:
        node = siblings[-1]
    else:
        node = Node(label)
        siblings.append(node)
    return Open(tag, node, dropped, inside, above.never or comments or (tag in DROPPED and tag != "header"), (above.marked and not is_main) or names_it)


def parse(html: str, known: Names = NAMES) -> tuple[Node, list[Block]]:
    """The tree of block elements and the blocks of text in page order, references decoded and white space collapsed."""
    root = Node("#")
    stack, blocks, run = [Open("#", root, 0, False, False, False)], [], []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            top = stack[-1]
            blocks.append(Block(top.node, text, bool(top.dropped), top.main, top.never, top.marked))

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            run.append(html[at:])
            break
        if m.start() > at:
            run.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close_to(depth)
                        break
                    if tag in ("p", "li") and stack[depth].tag in SCOPES:
                        break
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            inner, at = html[at : close.start() if close else end], close.end() if close else end
            if tag not in ("script", "style"):
                flush()
                stack.append(_opened(tag, m[3] or "", stack[-1], known))
                run.append(inner)
                close_to(len(stack) - 1)
            continue
        if tag in ("svg", "object", "canvas", "audio", "video"):
            close = re.compile(f"</{tag}\\s*>", re.IGNORECASE).search(html, at)
            if close and not (m[3] or "").endswith("/"):
                at = close.end()
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID and tag != "hr" or tag not in BLOCKS:
            continue
        flush()
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        for depth in range(len(stack) - 1, 0, -1) if tag in SIBLINGS else ():
            if stack[depth].tag in SIBLINGS[tag]:
                close_to(depth)
                break
            if stack[depth].tag in SCOPES and not (tag in ("tr", "td", "th") and stack[depth].tag in ("div", "section")):
                break
        if tag != "hr":
            opened = _opened(tag, m[3] or "", stack[-1], known)
            if len(stack) > DEPTH:
                stack[-1].node.children.clear()
                opened = opened._replace(node=stack[-1].node)
            stack.append(opened)
    flush()
    return root, blocks


def numbered(root: Node) -> str:
    """Gives every node its place in preorder; the tree of labels as JSON."""
    count = 0

    def visit(node: Node) -> list:
        nonlocal count
        node.slot, count = count, count + 1
        return [node.label, [visit(c) for c in node.children]]

    return json.dumps(visit(root), ensure_ascii=False, separators=(",", ":"))


class Wrapper:
    """A host's merged tree; slots are the pre-order places of its nodes in the order of their making."""

    def __init__(self, label: str, slots: Iterator[int]):
        self.label, self.children, self.slot, self._slots = label, [], next(slots), slots

    def grown(self, tree: list) -> Wrapper:
        node = Wrapper(tree[0], self._slots)
        node.children = [node.grown(c) for c in tree[1]]
        return node

    def saved(self) -> list:
        return [self.label, self.slot, [c.saved() for c in self.children]]

    def tree(self) -> list:
        return [self.label, [c.tree() for c in self.children]]

    @classmethod
    def restored(cls, saved: list) -> Wrapper:
        node = cls(saved[0], iter((saved[1],)))
        node.children = [cls.restored(c) for c in saved[2]]
        return node


class Kinds:
    """Numbers for subtrees that are equal, and how many nodes two kinds can pair."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[np.ndarray] = []
        self.sizes: list[int] = []
        self._matching: dict[tuple[int, int], int] = {}

    def of(self, label: str, children: list[int]) -> int:
        key = (label, *children)
        if key not in self.numbers:
            self.numbers[key] = len(self.labels)
            self.labels.append(label)
            self.children.append(np.array(children, dtype=np.int64))
            self.sizes.append(1 + sum(self.sizes[c] for c in children))
        return self.numbers[key]

    def matching(self, a: int, b: int) -> int:
        """Simple tree matching: the most nodes that can be paired, keeping labels, order and ancestry."""
        if a == b:
            return self.sizes[a]
        if self.labels[a] != self.labels[b]:
            return 0
        if (a, b) not in self._matching:
            x, y = self.children[a], self.children[b]
            first, last = _ends(x, y)
            same = sum(self.sizes[k] for k in (*x[:first], *x[len(x) - last :]))
            self._matching[a, b] = 1 + same + int(self._row(x[first : len(x) - last], y[first : len(y) - last])[-1])
        return self._matching[a, b]

    def _gains(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each child of x gains with each kind of y's, by rows for x's kinds, and x's rows."""
        of_x, row = np.unique(x, return_inverse=True)
        of_y, column = np.unique(y, return_inverse=True)
        gains = np.array([[self.matching(int(k), int(m)) for m in of_y] for k in of_x], dtype=np.int64).reshape(len(of_x), len(of_y))
        return gains[:, column], row

    def _row(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The most that all of x can pair with the first 0, 1, ... of y."""
        best = np.zeros(len(y) + 1, dtype=np.int64)
        if not len(x) or not len(y):
            return best
        gains, row = self._gains(x, y)
        for r in row:
            best[1:] = np.maximum(best[1:], best[:-1] + gains[r])
            best = np.maximum.accumulate(best)
        return best

    def pairs(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Places of the children of x and y that pair best, in order. Equal ones at both ends pair in any case: nothing can gain more."""
        first, last = _ends(x, y)
        end_x, end_y = len(x) - last, len(y) - last
        inner = self._inner(x[first:end_x], y[first:end_y])
        return [(i, i) for i in range(first)] + [(first + i, first + j) for i, j in inner] + [(end_x + i, end_y + i) for i in range(last)]

    def _inner(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        if not len(x) or not len(y):
            return []
        if len(x) > 1 and (len(x) + 1) * (len(y) + 1) > TABLE:  # in linear space: the best place to part y where x is halved
            half = len(x) // 2
            at = int((self._row(x[:half], y) + self._row(x[half:][::-1], y[::-1])[::-1]).argmax())
            return self._inner(x[:half], y[:at]) + [(half + i, at + j) for i, j in self._inner(x[half:], y[at:])]
        gains, row = self._gains(x, y)
        best = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int64)
        for i, r in enumerate(row, 1):
            best[i, 1:] = np.maximum(best[i - 1, 1:], best[i - 1, :-1] + gains[r])
            best[i] = np.maximum.accumulate(best[i])
        found, i, j = [], len(x), len(y)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return found[::-1]


def _ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How many kinds are the same at the beginning of both, and then at the end."""
    n = min(len(x), len(y))
    differs = np.flatnonzero(x[:n] != y[:n])
    first = int(differs[0]) if len(differs) else n
    differs = np.flatnonzero(x[len(x) - n + first :][::-1] != y[len(y) - n + first :][::-1])
    return first, int(differs[0]) if len(differs) else n - first


def align(wrapper: Wrapper, tree: list, grow: bool = True) -> list[int]:
    """The wrapper's slot of each node of tree, in preorder; nodes without a partner are added to it, or (not grow) have the slot -1."""
    kinds = Kinds()
    numbers: dict[int, int] = {}

    def number(node: Wrapper | list, label: str, children: list) -> int:
        found = kinds.of(label, [number(c, *_parts(c)) for c in children])
        numbers[id(node)] = found
        return found

    number(wrapper, *_parts(wrapper))
    number(tree, *_parts(tree))
    slots: list[int] = []

    def pair(node: Wrapper, other: list) -> None:
        slots.append(node.slot)
        a, b = node.children, other[1]
        partner = {j: i for i, j in kinds.pairs(*(np.array([numbers[id(c)] for c in x], dtype=np.int64) for x in (a, b)))}
        merged, used = [], 0
        for j, child in enumerate(b):
            if j in partner:
                upto = partner[j]
                merged += a[used : upto + 1]
                used = upto + 1
                pair(a[upto], child)
            elif not grow:
                slots.extend([-1] * kinds.sizes[numbers[id(child)]])
            else:
                fresh = node.grown(child)
                merged.append(fresh)
                slots.extend(_preorder(fresh))
        if grow:
            node.children = merged + a[used:]

    pair(wrapper, tree)
    return slots


def _parts(node: Wrapper | list) -> tuple[str, list]:
    return (node.label, node.children) if isinstance(node, Wrapper) else (node[0], node[1])


def _preorder(node: Wrapper) -> list[int]:
    return [node.slot] + [s for c in node.children for s in _preorder(c)]


def induce(trees: pd.DataFrame) -> pd.DataFrame:
    """host, part, groups, wrapper, shape (the wrapper without its slots), pages from one group of a host's trees, merged by frequency."""
    wrapper, slots = None, iter(range(1 << 62))
    for shape in trees.sort_values(["pages", "shape_id"], ascending=[False, True])["shape"]:
        tree = json.loads(shape)
        wrapper = wrapper or Wrapper(tree[0], slots)
        align(wrapper, tree)
    first, dumped = trees.iloc[0], lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    return pd.DataFrame({"host": [first["host"]], "part": [first["part"]], "groups": [first["groups"]], "wrapper": [dumped(wrapper.saved())], "shape": [dumped(wrapper.tree())], "pages": [trees["pages"].sum()]})


def models(trees: DataFrame) -> DataFrame:
    """host, wrapper of all its trees (host, shape_id, shape, pages): round after round, groups of about TREES become one."""
    whole = None
    while True:
        groups = trees.groupBy("host").agg(F.ceil(F.count("*") / max(2, TREES)).alias("groups"))
        parts = trees.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("shape_id"), F.col("groups")))
        merged = stage(parts.groupBy("host", "part").applyInPandas(induce, "host string, part long, groups long, wrapper string, shape string, pages long"))
        last = merged.filter("groups = 1").select("host", "wrapper")
        whole = last if whole is None else whole.unionByName(last)
        trees = merged.filter("groups > 1").select("host", F.col("part").alias("shape_id"), "shape", "pages")
        if trees.isEmpty():
            return whole


def _host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(batch: pa.RecordBatch, known: Names) -> Iterator[tuple[int, str, list[Block]]]:
    for raw in batch.column("text").to_pylist():
        root, blocks = parse(raw.decode("utf-8", "replace"), known)
        shape = numbered(root)
        yield _hash(shape), shape, blocks


class Slot(NamedTuple):
    """What is known of a wrapper's slot: pages that have it, different texts (about), whether there are several, mean size."""

    pages: int
    texts: float
    varies: bool
    size: float


def content(tree: list, slots: dict[int, Slot]) -> list[int]:
    """The places (in preorder) of a tree's nodes that hold main text. slots: by place, of nodes with a text."""
    if not slots:
        return []
    main = max(slots, key=lambda at: (slots[at].size, -at))
    whole = slots[main]
    returns = 4 * whole.texts < 3 * whole.pages  # the main text itself comes back

    def template(at: int, s: Slot) -> bool:
        if at == main or not whole.varies or s.pages < LEAST_PAGES:
            return False
        return not s.varies or (not returns and VARIANT * s.texts <= s.pages)

    varying = {at: s.size for at, s in slots.items() if not template(at, s)}
    labels: list[str] = []
    ends: list[int] = []
    below: list[list[int]] = []

    def number(node: list) -> int:
        at = len(labels)
        labels.append(node[0].split(".", 1)[0])
        ends.append(0)
        below.append([])
        below[at] = [number(c) for c in node[1]]
        ends[at] = len(labels)
        return at

    number(tree)
    sums = np.concatenate(([0.0], np.cumsum([varying.get(at, 0.0) for at in range(len(labels))])))
    held = lambda at: sums[ends[at]] - sums[at]
    region = 0
    while inner := [at for at in below[region] if labels[at] not in NO_REGION]:
        largest = max(inner, key=lambda at: (held(at), -at))
        if not held(largest) or held(largest) < MOST * held(region):
            break
        region = largest
    return [at for at in sorted(varying) if region <= at < ends[region] or labels[at] == "h1"]


def wrappers(pages: DataFrame, known: Names = NAMES) -> DataFrame:
    """host, shape_id, content: the places that hold main text in each distinct tree of a host with LEAST_PAGES different pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of a page and of the text of its slots (-1 stands for the page), and once in a while the tree itself."""
        told: set[tuple] = set()
        for batch in batches:
            for part in rows_of(batch):
                rows: list[tuple] = []
                for host, (shape_id, shape, blocks) in zip(part.column("host").to_pylist(), _parsed(part, known), strict=True):
                    texts: dict[int, str] = {}
                    for b in blocks:
                        if not b.never:
                            texts[b.node.slot] = f"{texts.get(b.node.slot, '')}\n{b.text}"
                    hashes = [_hash(t) for t in texts.values()]
                    rows.append((host, shape_id, None, _hash(repr(hashes)), [-1, *texts], [0, *hashes], [0, *map(len, texts.values())]))
                    if (host, shape_id) not in told:
                        told.add((host, shape_id))
                        rows.append((host, shape_id, shape, None, [], [], []))
                if len(told) > 100_000:
                    told.clear()
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "shape_id", "shape", "page", "slots", "hashes", "sizes"])

    # Copies of a page count once: a text isn't a template because its page was copied.
    distinct = stage(pages.mapInArrow(lean(read), "host string, shape_id long, shape string, page long, slots array<int>, hashes array<long>, sizes array<long>").dropDuplicates(["host", "shape_id", "page"]))
    slots = distinct.filter("page is not null").select("host", "shape_id", F.inline(F.arrays_zip("slots", "hashes", "sizes"))).toDF("host", "shape_id", "slot", "h", "size")
    summed = stage(slots.groupBy("host", "shape_id", "slot").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("size").alias("size"), F.hll_sketch_agg("h").alias("texts")))
    counted = summed.filter("slot < 0").select("host", "shape_id", F.col("n").alias("pages"))
    enough = counted.groupBy("host").agg(F.sum("pages").alias("of"), F.ceil(F.count("*") / max(2, TREES)).alias("parts")).filter(F.col("of") >= LEAST_PAGES).select("host", "parts")
    trees = stage(distinct.filter("page is null").select("host", "shape_id", "shape").join(counted, ["host", "shape_id"]).join(enough, "host"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part of a host's trees comes after the host's wrapper."""
        wrapper = None
        for batch in batches:
            found: list[tuple] = []
            for host, shape_id, shape, saved in zip(*(batch.column(c).to_pylist() for c in ("host", "shape_id", "shape", "wrapper")), strict=True):
                if saved is not None:
                    wrapper = Wrapper.restored(json.loads(saved))
                else:
                    found.append((host, shape_id, shape, align(wrapper, json.loads(shape), grow=False)))
            types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["host", "shape_id", "shape", "places"])

    none = lambda kind: F.lit(None).cast(kind)
    dealt = trees.select("host", F.pmod(F.xxhash64("shape_id"), F.col("parts")).alias("part"), "shape_id", "shape", none("string").alias("wrapper"))
    heads = models(trees.drop("parts")).join(enough, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none("long").alias("shape_id"), none("string").alias("shape"), "wrapper")
    ordered = dealt.unionByName(heads).repartition("host", "part").sortWithinPartitions("host", "part", F.col("wrapper").isNull())
    aligned = stage(ordered.select("host", "shape_id", "shape", "wrapper").mapInArrow(lean(match), "host string, shape_id long, shape string, places array<long>"))
    placed = stage(summed.filter("slot >= 0").join(aligned.select("host", "shape_id", "places"), ["host", "shape_id"]).withColumn("at", F.get("places", "slot")).drop("places"))
    stats = placed.groupBy("host", "at").agg(
        F.sum("n").alias("pages"), F.hll_sketch_estimate(F.hll_union_agg("texts")).cast("double").alias("texts"),
        (F.min("lo") < F.max("hi")).alias("varies"), (F.sum("size") / F.sum("n")).alias("size"),
    )
    of_tree = placed.select("host", "shape_id", "slot", "at").join(stats, ["host", "at"]).groupBy("host", "shape_id").agg(F.collect_list(F.struct("slot", "pages", "texts", "varies", "size")).alias("slots"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content(json.loads(shape), {s["slot"]: Slot(s["pages"], s["texts"], s["varies"], s["size"]) for s in slots or ()}) for shape, slots in zip(batch.column("shape").to_pylist(), batch.column("slots").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape_id"), pa.array(found, pa.list_(pa.int32()))], ["host", "shape_id", "content"])

    return aligned.select("host", "shape_id", "shape").join(of_tree, ["host", "shape_id"], "left").mapInArrow(lean(decide), "host string, shape_id long, content array<int>")


def extract(pages: DataFrame, known: Names = NAMES) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html), from the whole html.

    A null or empty html, or one without main text, gives an empty text. On a host with fewer than LEAST_PAGES different
    pages, text outside of article and main is left out where a page has them. Rows without a url are pages of one nameless
    host; rows that repeat give repeated results.
    """
    rows = pages.select("page_id", "url", _host(F.col("url")).alias("host"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("text"))
    contents = stage(wrappers(rows.select("host", "text"), known))
    few = (contents.agg(F.sum(F.octet_length("host") + 4 * F.size("content") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    ids = rows.schema["page_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                shapes, columns = [], ([], [], [], [])
                for shape_id, _, found in _parsed(part, known):
                    plain = [b for b in found if not b.dropped]
                    plain = {id(b) for b in [b for b in plain if b.main] or plain}
                    shapes.append(shape_id)
                    kept = [b for b in found if not b.never or id(b) in plain]
                    for column, values in zip(columns, zip(*((b.node.slot, b.text, id(b) in plain, not b.never and not b.marked) for b in kept), strict=True) if kept else ([],) * 4, strict=True):
                        column.append(values)
                types = (pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(shapes, pa.int64()), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, types, strict=True))], ["page_id", "url", "host", "shape_id", "slots", "blocks", "plain", "free"])

    found = rows.mapInArrow(lean(blocks), f"page_id {ids}, url string, host string, shape_id long, slots array<int>, blocks array<string>, plain array<boolean>, free array<boolean>")
    joined = found.join(F.broadcast(contents) if few else contents, ["host", "shape_id"], "left")
    varying = F.filter("blocks", lambda _, i: F.get("free", i) & F.array_contains(F.col("content"), F.get("slots", i)))
    text = F.array_join(F.when(F.col("content").isNull(), F.filter("blocks", lambda _, i: F.get("plain", i))).otherwise(varying), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
