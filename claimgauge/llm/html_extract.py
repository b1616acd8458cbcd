"""Main text of web pages by wrapper induction.

The pages of a host are grouped by layout, the set of their named sections. Of each layout, the page with the
most common structure (the smallest id of them) is the seed; layouts with less than ``MIN_LAYOUT_SHARE`` of a
host's pages use the seed of its most common one. The block trees of all pages are aligned with their seed's by
simple tree matching, and counted: a seed node whose text is the same on most of them is template, a slot
whose text varies is content. A page loses what equals the template, wherever it stands.

Copies of the seed say nothing about the template. A page is a copy if it shares most of that part of the
seed's content which varies: without ``article`` or ``main`` the content holds the frame of the site as well, so what
the least similar page shares is taken off first, up to ``MAX_FRAME`` of the seed.

Which region is content at all follows from the markup: the outermost ``article`` elements, else ``main``,
else the body; without menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
known by element name or by words of class, id or role. A name with a word like ``has`` or ``no`` tells what an
element holds and not what it is. A named element that holds nearly all the prose of a page is a wrapper. Scripts,
styles and comments are no text.

The matching keeps as many nodes as possible, and among such matchings pairs as many siblings of equal content as
possible. Sibling lists of any length are aligned in linear space; trees may have any depth.

Hosts may hold any share of the pages: pages are never gathered by host, only counts per seed node are.
Seeds are broadcast up to ``BROADCAST_BYTES``, a checked size; beyond, hosts are dealt to ``SALTS`` tasks each.

A null page has an empty text. A null url is a host of its own. Pages without an id are extracted but never
seeds; repeated rows get the same text; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimgauge.llm.common import store

#: A seed node is template if so many other pages, and such a share of them, have its text.
MIN_PAGES, MIN_SHARE = 3, 0.8
#: A page with such a share of the varying part of the seed's content is a copy of it.
COPY_SHARE = 0.5
#: Pages without ``article`` or ``main`` that all share more than this of the seed are copies of one page.
MAX_FRAME = 0.9
#: Layouts with such a share of a host's pages have a seed of their own, so a host has at most 11 seeds.
MIN_LAYOUT_SHARE = 0.1
#: A named element wraps the content if it holds so many times the text beside it, in stretches of so many characters.
WRAPPER_RATIO, PROSE_CHARS = 4, 60
#: Largest total size of the seeds that is broadcast; beyond, the pages of a host go to so many tasks.
BROADCAST_BYTES, SALTS = 8 << 20, 32
#: Sibling lists with more pairs are aligned by halves, in linear space.
TABLE_CELLS = 1 << 20

# Element names of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template svg object xmp math canvas video audio".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
BAD_ELEMENTS = set("nav header footer aside form button select dialog menu head fieldset".split())
BAD_WORDS = set(
    "ad ads advert advertisement advertisements adverts advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related cookie cookies consent gdpr notice notices alert popup modal "
    "overlay subscribe subscription newsletter signup login share sharing social form search toolbar pagination pager complementary "
    "contentinfo".split()
)
#: With one of these, a name tells what an element holds or lacks.
MODIFIERS = set("has no not with without free hide show enable enabled disable disabled".split())
READER_WORDS = set("comment comments disqus respond replies ad ads advert adverts advertisement".split())
FRAME_ELEMENTS = set("div section nav header footer aside main article form table".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
#: What an end of an element closes with it, never beyond these.
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}}

_TOKEN = re.compile(
    r"<!--(?:>|->)|<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*)>"
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element, or a stretch of text between blocks (``tag`` empty).

    ``bad`` is 3 for elements that are never content, 2 for names of adverts and reader comments and for forms, 1 for
    other names of what is no content but may wrap it, else 0. ``shape`` and ``digest`` are hashes of
    the subtree, without and with its texts; ``nodes`` and ``size`` count its nodes and its text.
    """

    __slots__ = ("tag", "label", "bad", "kids", "text", "shape", "digest", "nodes", "size")

    def __init__(self, tag: str, label: str, bad: int, text: str = ""):
        self.tag, self.label, self.bad, self.kids, self.text = tag, label, bad, [], text


@lru_cache(maxsize=20_000)
def _described(tag: str, attributes: str) -> tuple[str, int]:
    """The label that must be equal for two elements to match, and how surely the element is no content."""
    names, words = [], set()
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "class":
            names += value.split()
        for part in value.split():
            own = {w.lower() for w in _WORD.findall(part)}
            if not own & MODIFIERS:
                words |= own
    bad = 2 if words & READER_WORDS or tag == "form" else 1 if words & BAD_WORDS else 0
    if tag in BAD_ELEMENTS and tag != "form":
        bad = 3
    if tag in ("html", "body", "main"):
        bad = 0
    return ".".join([tag, *sorted(names)]), bad


def preorder(root: Node) -> list[Node]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += reversed(node.kids)
    return found


def _hash(*parts: bytes) -> bytes:
    return blake2b(b"".join(parts), digest_size=16).digest()


def _summarize(root: Node) -> None:
    """Hashes and counts of every subtree, kids first."""
    for node in reversed(preorder(root)):
        label = node.label.encode("utf-8", "surrogatepass") + b"\0"
        node.nodes = 1 + sum(kid.nodes for kid in node.kids)
        if node.tag:
            node.size = sum(kid.size for kid in node.kids)
            node.shape = _hash(label, *[kid.shape for kid in node.kids])
            node.digest = _hash(label, *[kid.digest for kid in node.kids])
        else:
            node.size, node.shape = len(node.text), b"#"
            node.digest = _hash(b"#", node.text.encode("utf-8", "surrogatepass"))


def parse(source: str) -> Node:
    """The block tree of a page; whatever is not closed ends with what holds it."""
    root = Node("#root", "#root", 0)
    stack, pieces, opened = [root], [], Counter()
    at = 0

    def close(depth: int) -> None:
        opened.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                stack[-1].kids.append(Node("", "", 0, text))
            pieces.clear()

    while token := _TOKEN.search(source, at):
        if token.start() > at:
            pieces.append(source[at : token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name = name.lower()
        closing, attributes = token[1], token[3]
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append(" ")
            continue
        bad = 0
        label = name
        if not closing and attributes and not attributes.isspace():
            label, bad = _described(name, attributes)
        elif name in BAD_ELEMENTS:
            bad = 2 if name == "form" else 3
        if name in INLINE and not bad and not opened[name]:
            continue
        flush()
        if closing:
            if opened[name]:
                close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == name))
            continue
        if stack[-1].tag == "p" and name not in INLINE:
            close(len(stack) - 1)
        ended = CLOSES.get(name, ())
        if any(opened[tag] for tag in ended):
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth].tag
                if tag in ended:
                    close(depth)
                elif tag in SCOPES.get(name, ()):
                    break
        node = Node(name, label, bad)
        stack[-1].kids.append(node)
        stack.append(node)
        opened[name] += 1
    pieces.append(source[at:])
    flush()
    _summarize(root)
    return root


def text_nodes(node: Node) -> list[Node]:
    """All stretches of text in page order."""
    return [n for n in preorder(node) if not n.tag]


def _collect(regions: list[Node], kept: set[int]) -> list[Node]:
    """The stretches of text in the regions, without elements that are no content unless ``kept``."""
    found, stack = [], regions[::-1]
    while stack:
        node = stack.pop()
        if not node.tag:
            found.append(node)
        stack += [kid for kid in reversed(node.kids) if not kid.bad or id(kid) in kept]
    return found


def _outermost(root: Node, tag: str, own: int, inside: int) -> list[Node]:
    """The outermost elements of a tag: themselves bad up to ``own``, in elements bad up to ``inside``."""
    found, stack = [], root.kids[::-1]
    while stack:
        node = stack.pop()
        if node.tag == tag and node.bad <= own:
            found.append(node)
        elif node.tag and node.bad <= inside:
            stack += reversed(node.kids)
    return found


def _text_size(nodes: list[Node]) -> int:
    return sum(len(node.text) for node in nodes)


def content_region(root: Node) -> tuple[list[Node], bool]:
    """The stretches of text of the content, in page order, and whether they come from all of the body."""
    # A layout element that is named after a sidebar or header may still wrap the article.
    for inside in (0, 1):
        for tag in ("article", "main"):
            if regions := _outermost(root, tag, 0, inside):
                return _collect(regions, set()), False
    beside = _collect([root], set())
    # What is named like no content holds the article after all if hardly any text is left beside it.
    for own, inside in ((1, 1), (0, 2), (1, 2)):
        for tag in ("article", "main"):
            found = _collect(_outermost(root, tag, own, inside), set())
            if _text_size(found) > WRAPPER_RATIO * _text_size(beside):
                return found, False
    kept: set[int] = set()
    while True:
        wrappers, stack = [], [root]
        while stack:
            node = stack.pop()
            for kid in node.kids:
                if not kid.bad or id(kid) in kept:
                    stack.append(kid)
                elif kid.bad == 1 or kid.tag == "form":
                    wrappers.append(kid)
        if not wrappers:
            return beside, True
        largest = max(wrappers, key=lambda node: node.size)
        inner = _collect([largest], set())
        prose = sum(len(node.text) for node in inner if len(node.text) >= PROSE_CHARS)
        if largest.size <= WRAPPER_RATIO * _text_size(beside) or (inner and (len(inner) < 3 or 2 * prose < _text_size(inner))):
            return beside, True
        kept.add(id(largest))
        beside = _collect([root], kept)


def content_nodes(root: Node) -> list[Node]:
    """The stretches of text of the content region, in page order."""
    return content_region(root)[0]


def skeleton(root: Node) -> bytes:
    """A hash of the nesting of labels, equal neighbours taken together."""
    shapes: dict[int, bytes] = {}
    for node in reversed(preorder(root)):
        inner = [shapes.pop(id(kid)) for kid in node.kids]
        inner = [shape for i, shape in enumerate(inner) if not i or inner[i - 1] != shape]
        shapes[id(node)] = _hash(node.label.encode("utf-8", "surrogatepass") + b"\0", *inner) if node.tag else b"#"
    return shapes[id(root)]


def layout(root: Node) -> bytes:
    """A hash of the set of named sections within five levels, numbers in names left out."""
    names, level = set(), [root]
    for _ in range(5):
        level = [kid for node in level for kid in node.kids if kid.tag]
        names.update(re.sub(r"\d+", "", n.label) for n in level if n.tag in FRAME_ELEMENTS and n.label != "div")
    return _hash("\0".join(sorted(names)).encode("utf-8", "surrogatepass"))


#: Matched nodes by the two shapes; the same pairs of shapes come up on all pages of a host.
_MATCHED: dict[tuple[bytes, bytes], int] = {}
#: Weight of a matched node against a pair of equal siblings, of which a page has fewer.
_NODE = 1 << 24


def _matched(x: Node, y: Node) -> int:
    """The most nodes that can be paired below and with ``x`` and ``y``."""
    if x.label != y.label:
        return 0
    if x.shape == y.shape:
        return x.nodes
    if not x.kids or not y.kids:
        return 1
    key = x.shape, y.shape
    known = _MATCHED.get(key)
    if known is None:
        a, b = x.kids, y.kids
        start, end = _equal_ends([n.shape for n in a], [n.shape for n in b])
        known = 1 + sum(n.nodes for n in a[:start]) + sum(n.nodes for n in a[len(a) - end :])
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        if a and b:
            known += int(_last_row(*_weights(a, b, 0))[-1]) // _NODE
        _MATCHED[key] = known
    return known


def _equal_ends(a: list[bytes], b: list[bytes]) -> tuple[int, int]:
    """How many are equal at the start and, beyond those, at the end: a best matching pairs them."""
    most = min(len(a), len(b))
    start = next((i for i in range(most) if a[i] != b[i]), most)
    most -= start
    return start, next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)


def _weights(a: list[Node], b: list[Node], bonus: int) -> tuple:
    """What a pair of siblings is worth: by the kinds of both and, on top, for equal content."""
    kinds = [{n.shape: n for n in reversed(side)} for side in (a, b)]
    places = [{shape: i for i, shape in enumerate(side)} for side in kinds]
    table = np.zeros((len(kinds[0]), len(kinds[1])), np.int64)
    for i, x in enumerate(kinds[0].values()):
        for j, y in enumerate(kinds[1].values()):
            if x.label == y.label:
                table[i, j] = _matched(x, y) * _NODE
    texts: dict[bytes, int] = {}
    left, right = (np.array([texts.setdefault(n.digest, len(texts)) for n in side]) for side in (a, b))
    return table, np.array([places[0][n.shape] for n in a]), np.array([places[1][n.shape] for n in b]), left, right, bonus


def _rows(table, kind_a, kind_b, left, right, bonus) -> Iterator[np.ndarray]:
    """The best scores of the first siblings of one side with the first ones of the other, row by row."""
    row = np.zeros(len(kind_b) + 1, np.int64)
    yield row
    for kind, text in zip(kind_a, left):
        paired = row[:-1] + table[kind][kind_b]
        if bonus:
            paired += right == text
        row = np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], paired))))
        yield row


def _last_row(*weights) -> np.ndarray:
    for row in _rows(*weights):
        pass
    return row


def _pairing(table, kind_a, kind_b, left, right, bonus) -> list[tuple[int, int]]:
    """The places of a best pairing that keeps the order; long lists are halved where the best one crosses."""
    n, m = len(kind_a), len(kind_b)
    if not n or not m:
        return []
    if n * m > TABLE_CELLS and n > 1:
        half = n // 2
        upper = _last_row(table, kind_a[:half], kind_b, left[:half], right, bonus)
        lower = _last_row(table, kind_a[half:][::-1], kind_b[::-1], left[half:][::-1], right[::-1], bonus)[::-1]
        cut = int(np.argmax(upper + lower))
        first = _pairing(table, kind_a[:half], kind_b[:cut], left[:half], right[:cut], bonus)
        rest = _pairing(table, kind_a[half:], kind_b[cut:], left[half:], right[cut:], bonus)
        return first + [(half + i, cut + j) for i, j in rest]
    scores = list(_rows(table, kind_a, kind_b, left, right, bonus))
    i, j, pairs = n, m, []
    while i and j:
        here = scores[i][j]
        if here == scores[i - 1][j]:
            i -= 1
        elif here == scores[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _paired_kids(x: Node, y: Node) -> list[tuple[Node, Node]]:
    a, b = x.kids, y.kids
    if x.shape == y.shape:
        return list(zip(a, b))
    start, end = _equal_ends([n.digest for n in a], [n.digest for n in b])
    head, tail = list(zip(a[:start], b[:start])), list(zip(a[len(a) - end :], b[len(b) - end :]))
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    return head + [(a[i], b[j]) for i, j in (_pairing(*_weights(a, b, 1)) if a and b else [])] + tail


def align(page: Node, seed: Node) -> list[tuple[Node, Node]]:
    """Matched stretches of text ``(page, seed)`` by simple tree matching: the most nodes in pairs that keep
    order and ancestry, and among those the most siblings of equal content."""
    if len(_MATCHED) > 200_000:
        _MATCHED.clear()
    found, stack = [], [(page, seed)]
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(before + 4 * min(page.nodes, seed.nodes))
    try:
        while stack:
            x, y = stack.pop()
            if x.tag:
                stack += reversed(_paired_kids(x, y))
            else:
                found.append((x, y))
    finally:
        sys.setrecursionlimit(before)
    return found


class Seed:
    """A parsed seed page: its stretches of text by number, and which of them are content."""

    def __init__(self, source: str):
        self.root = parse(source)
        self.number = {id(n): i for i, n in enumerate(text_nodes(self.root))}
        nodes, self.whole = content_region(self.root)
        self.content = {id(n) for n in nodes}
        self.size = _text_size(nodes)

    def equal(self, page: Node) -> dict[int, Node]:
        """The seed's nodes of the same text, by the ids of the page's nodes."""
        return {id(x): y for x, y in align(page, self.root) if x.text == y.text}


@lru_cache(maxsize=500)
def _seed(source: str) -> Seed:
    return Seed(source)


def extract(source: str | None, seed: str | None = None, template: frozenset[int] = frozenset()) -> str:
    """The content of one page without what its template holds."""
    if not source:
        return ""
    root = parse(source)
    known = _seed(seed) if seed and template else None
    equal = known.equal(root) if known else {}
    return " ".join(n.text for n in content_nodes(root) if id(n) not in equal or known.number[id(equal[id(n)])] not in template)


def _host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))


def seeds(pages: DataFrame) -> DataFrame:
    """``host, layout, is_top, seed``: of each layout, the page with the smallest id among those with the most common skeleton."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [(skeleton(root), layout(root)) for root in (parse(text.as_py()) for text in batch.column(2))]
            hashes = [pa.array([pair[i] for pair in roots], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *hashes], ["host", "page_id", "shape", "layout"])

    usable = pages.where("page_id IS NOT NULL AND html <> ''")
    shaped = usable.select("host", "page_id", "html").mapInArrow(run, "host string, page_id long, shape binary, layout binary")
    shapes = shaped.groupBy("host", "layout", "shape").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))
    commonest = F.min_by("page_id", F.struct(-F.col("n"), "page_id")).alias("seed_id")
    layouts = store(shapes.groupBy("host", "layout").agg(commonest, F.sum("n").alias("n")), "layouts")
    hosts = layouts.groupBy("host").agg(F.sum("n").alias("n_host"), F.max(F.struct("n", "layout")).alias("top")).where(F.col("n_host") > MIN_PAGES)
    is_top = F.col("layout") == F.col("top.layout")
    common = (F.col("n") > MIN_PAGES) & (F.col("n") >= MIN_LAYOUT_SHARE * F.col("n_host"))
    best = store(layouts.join(hosts, "host").where(is_top | common).select("host", "layout", is_top.alias("is_top"), "seed_id"), "seed-ids")
    found = usable.select(F.col("host").alias("page_host"), "page_id", "html").join(
        best, (F.col("page_id") == F.col("seed_id")) & (F.col("page_host") == F.col("host"))
    )
    return store(found.groupBy("host", "layout", "is_top").agg(F.min("html").alias("seed")), "seeds")


def _with_host(pages: DataFrame, table: DataFrame, size: Column, on: list[str]) -> DataFrame:
    """The pages with what a table says of their hosts: broadcast if its summed size is within the bound, else
    with the pages of each host dealt to several tasks."""
    if (table.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(table), on, "left")
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(salted, [*on, "salt"], "left").drop("salt")


def aligned_pages(pages: DataFrame, seeded: DataFrame) -> DataFrame:
    """Every page with its content in ``pieces`` (text, and the seed's node if that has the same text, else -1), and
    ``equal``: all nodes of its seed with the same text, of whose content they are ``shared`` characters."""
    import pyarrow as pa

    kept = pages.select("page_id", "url", "host").schema.fields
    schema = T.StructType(
        [
            *kept,
            T.StructField("layout", T.BinaryType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("size", T.LongType()),
            T.StructField("shared", T.LongType()),
            T.StructField("equal", T.ArrayType(T.IntegerType())),
            T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("text", T.StringType())]))),
        ]
    )
    piece = pa.struct([("node", pa.int32()), ("text", pa.string())])
    types = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(piece)]

    def read(source: str | None, choices: list[dict] | None) -> tuple:
        if not source:
            return None, None, None, None, [], []
        root = parse(source)
        content = content_nodes(root)
        if not choices:
            return None, None, None, None, [], [{"node": -1, "text": n.text} for n in content]
        own = layout(root)
        choice = next((c for c in choices if c["layout"] == own), None) or next(c for c in choices if c["is_top"])
        seed = _seed(choice["seed"])
        equal = seed.equal(root)
        shared = sum(len(y.text) for y in equal.values() if id(y) in seed.content)
        pieces = [{"node": seed.number[id(equal[id(n)])] if id(n) in equal else -1, "text": n.text} for n in content]
        return choice["layout"], seed.whole, seed.size, shared, [seed.number[id(y)] for y in equal.values()], pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(source.as_py(), choices.as_py()) for source, choices in zip(batch.column(3), batch.column(4))]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], schema.names)

    choices = seeded.groupBy("host").agg(F.collect_list(F.struct("layout", "is_top", "seed")).alias("choices"))
    size = F.octet_length("host") + F.aggregate("choices", F.lit(0).cast("long"), lambda total, c: total + F.octet_length(c.seed))
    joined = _with_host(pages, choices, size, ["host"])
    return store(joined.select("page_id", "url", "host", "html", "choices").mapInArrow(run, schema), "aligned-pages")


def templates(aligned: DataFrame) -> DataFrame:
    """``host, layout, template``: the numbers of the seed's template nodes."""
    pages = aligned.where("layout IS NOT NULL")
    # The least that a page shares is the frame, if the content is all of the body.
    frames = store(
        pages.groupBy("host", "layout").agg(F.min("shared").alias("least"), F.first("whole").alias("whole"), F.first("size").alias("size"))
        .withColumn("frame", F.when(F.col("whole") & (F.col("least") < MAX_FRAME * F.col("size")), F.col("least")).otherwise(0))
        .select("host", "layout", "frame"),
        "frames",
    )
    judged = _with_host(pages.select("page_id", "url", "host", "layout", "size", "shared", "equal"), frames, F.octet_length("host"), ["host", "layout"])
    is_copy = (F.col("size") > 0) & (F.col("shared") - F.col("frame") >= COPY_SHARE * (F.col("size") - F.col("frame")))
    nodes = F.concat(F.array(F.lit(-1)), "equal")
    counted = judged.where(~is_copy).select("host", "layout", F.explode(nodes).alias("node")).groupBy("host", "layout", "node").count()
    counted = store(counted, "template-counts")
    others = counted.where("node = -1").select("host", "layout", F.col("count").alias("n_pages")).where(F.col("n_pages") >= MIN_PAGES)
    fixed = counted.where("node >= 0").join(others, ["host", "layout"]).where(F.col("count") >= MIN_SHARE * F.col("n_pages"))
    return store(fixed.groupBy("host", "layout").agg(F.collect_list("node").alias("template")), "templates")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    hosted = _host(pages)
    aligned = aligned_pages(hosted, seeds(hosted))
    size = F.octet_length("host") + 4 * F.size("template")
    joined = _with_host(aligned.select("page_id", "url", "host", "layout", "pieces"), templates(aligned), size, ["host", "layout"])
    kept = F.filter("pieces", lambda piece: ~F.coalesce(F.array_contains("template", piece.node), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda piece: piece.text), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
