"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags and classes are one node of the host's tree.
For each node, the entropy over pages of its presentation (the sequence of child elements) and of its content (the text
below it), both relative to the number of pages, say how much it varies. A branch that looks and reads alike on many
pages has a low importance and is removed from each page. Tags and class names whose meaning is boilerplate (menus,
footers, forms, comments and the like) have no importance to begin with, so hosts of one page are cleaned too. Articles
themselves, and plain paragraphs and headings, are never removed as branches: a text that a host repeats is still text.

Only hashes of paths and contents are dealt out, counted by (host, node, hash); a host's removed nodes are one small
array. Identical pages of a host count once.

Edge cases: a null or empty html gives an empty text; unclosed and stray tags are closed or ignored as browsers do, and
a tag cut off by the end of the page is dropped; a null url, or one without ``://``, belongs to the host of no name;
repeated rows are extracted alike; an empty table gives an empty result; other columns are passed through
whatever their names, but for ``host`` and ``text``, which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.rows import packed, unpacked
from tideline.session import materialise


@dataclass(frozen=True)
class ExtractSettings:
    #: A branch is removed where at least so many different pages hold it and its importance is below the limit.
    min_pages: int = 8
    min_importance: float = 0.2
    #: Weight of content against presentation.
    content_weight: float = 0.9


#: Fixed values of HTML: elements that start a block of their own, and elements without content.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())

#: Elements and class, id or role words that mark boilerplate.
NOISE_TAGS = frozenset("nav footer aside form head script style textarea title noscript template iframe svg canvas button select object dialog menu search xmp noembed noframes math audio video".split())
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
    breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social related recommended widget comment comments reply replies disqus
    pagination pager toolbar skip contentinfo complementary search searchbox form""".split()
)
#: What is never removed for its importance, unless it has a class.
PLAIN = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt tr tbody".split())
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("html body article section div ul ol dl table main".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z]+")


@dataclass
class Node:
    tag: str
    path: int  # hash of the path of signatures
    parent: int  # index of the node above, or -1
    removable: bool
    article: bool
    main: bool
    shape: list = field(default_factory=list)  # signatures of child elements
    texts: list = field(default_factory=list)  # indexes of blocks below


def _named(attributes: str) -> tuple[str, bool]:
    """(class and id signature, whether a word marks boilerplate)."""
    found, noise = [], False
    for name, a, b, c in _NAMED.findall(attributes):
        value = (a or b or c).lower()
        noise = noise or not NOISE_WORDS.isdisjoint(_PARTS.split(value))
        if name.lower() != "role":
            found.append(" ".join(sorted(_DIGITS.sub("", value).split())))
    return ".".join(found), noise


def parse(page: str | None) -> tuple[list[tuple[str, int]], list[Node]]:
    """Blocks (text, index of their node) outside boilerplate, in page order, and the page's nodes."""
    import xxhash

    page = page or ""
    nodes, blocks, pending = [Node("#page", 0, -1, False, False, False)], [], []
    # Open elements: (tag, index of the node, or -1 where inline). ``skip``: how many open when boilerplate began.
    stack: list[tuple[str, int]] = [("#page", 0)]
    skip, at, size = 0, 0, len(page)

    def flush():
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                here = next(i for _, i in reversed(stack) if i >= 0)
                blocks.append((text, here))

    def pop(count: int):
        nonlocal skip
        del stack[count:]
        if skip and len(stack) < skip:
            skip = 0

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if not skip and (page[m.start()] != "<" or m.end() - m.start() == 1):
                pending.append(m[0])
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in BLOCKS and not skip:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break  # a stray inline end tag closes nothing beyond its block
            continue
        block = tag in BLOCKS
        if block and not skip:
            flush()
        if tag == "br" and not skip:
            pending.append(" ")
        if block or tag in CLOSES:
            shut = CLOSES.get(tag, frozenset()) | ({"p"} if block else frozenset())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shut:
                    pop(k)
                elif stack[k][0] in BOUNDS:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
        elif attributes.rstrip().endswith("/") and not block:
            continue
        named, noise = _named(attributes) if attributes else ("", False)
        above = next(i for _, i in reversed(stack) if i >= 0)
        inside = nodes[above]
        noise = noise and tag not in ("html", "body", "article", "main") or tag in NOISE_TAGS or tag == "header" and not (inside.article or inside.main)
        if skip or noise or not block:
            stack.append((tag, -1))
            if noise and not skip:
                skip = len(stack)
            continue
        signature = f"{tag}.{named}"
        inside.shape.append(signature)
        path = xxhash.xxh64_intdigest(signature, inside.path)
        main = inside.main or tag == "main" or 'role="main"' in attributes
        nodes.append(Node(tag, path, above, bool(named) or tag not in PLAIN, inside.article or tag == "article", main))
        stack.append((tag, len(nodes) - 1))
    flush()
    return blocks, nodes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def branches(page: str | None) -> list[tuple[int, int, int]]:
    """(path, presentation, content) of the removable nodes; occurrences of a path on the page are one."""
    import xxhash

    blocks, nodes = parse(page)
    for k, (_, node) in enumerate(blocks):
        while node >= 0:
            nodes[node].texts.append(k)
            node = nodes[node].parent
    shapes, contents = {}, {}
    for node in nodes:
        if node.removable and node.texts:
            shapes.setdefault(node.path, []).append(" ".join(node.shape))
            contents.setdefault(node.path, []).extend(blocks[k][0] for k in node.texts)
    digest = xxhash.xxh64_intdigest
    return [(_signed(path), _signed(digest("|".join(shape))), _signed(digest("\n".join(contents[path])))) for path, shape in shapes.items()]


def main_text(page: str | None, removed: frozenset[int] = frozenset()) -> str:
    """Blocks of the articles (else of the main part, else of the page) outside removed branches."""
    blocks, nodes = parse(page)
    if any(nodes[i].article for _, i in blocks):
        blocks = [(t, i) for t, i in blocks if nodes[i].article]
    elif any(nodes[i].main for _, i in blocks):
        blocks = [(t, i) for t, i in blocks if nodes[i].main]
    if removed:
        gone = [False] * len(nodes)
        for i, node in enumerate(nodes):  # parents come first
            gone[i] = node.parent >= 0 and gone[node.parent] or node.removable and _signed(node.path) in removed
        blocks = [(t, i) for t, i in blocks if not gone[i]]
    return "\n".join(t for t, _ in blocks)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def importance(pages: DataFrame, settings: ExtractSettings | None = None) -> DataFrame:
    """host, path, pages, importance of the nodes that at least ``min_pages`` different pages hold."""
    s = settings or ExtractSettings()

    def found(column):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("path", pa.int64()), ("shape", pa.int64()), ("content", pa.int64())]))
        return pa.array([[{"path": p, "shape": a, "content": c} for p, a, c in branches(x.as_py())] for x in column], kind)

    parsed = F.arrow_udf(found, "array<struct<path: bigint, shape: bigint, content: bigint>>")
    html = F.col("html").cast("string")
    nodes = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("page"), F.explode(parsed(html)).alias("node"))
    nodes = nodes.select("host", "page", "node.*").distinct()
    counted = nodes.groupBy("host", "path", "shape", "content").agg(F.count("*").alias("n"))
    # Entropies relative to the number of pages, from counts that are summed per node in two steps.
    shapes = counted.groupBy("host", "path", "shape").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("c"))
    total = shapes.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum("c").alias("c"), F.sum(F.col("n") * F.log("n")).alias("a"))
    total = total.where(F.col("pages") >= s.min_pages)
    # A content seen under two presentations counts as two: that only raises the importance.
    spread = lambda x: 1 - F.col(x) / (F.col("pages") * F.log("pages"))
    value = (1 - s.content_weight) * spread("a") + s.content_weight * spread("c")
    return total.select("host", "path", "pages", value.alias("importance"))


def removed_branches(pages: DataFrame, settings: ExtractSettings | None = None) -> DataFrame:
    """Per host with any: ``_host`` and ``_removed``, the paths of its unimportant nodes."""
    s = settings or ExtractSettings()
    low = importance(pages, s).where(F.col("importance") < s.min_importance)
    return materialise(low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("path").alias("_removed")), "removed_branches")


def extract(pages: DataFrame, settings: ExtractSettings | None = None) -> DataFrame:
    """``pages`` with ``host`` and ``text``."""

    def texts(column, removed):
        import pyarrow as pa

        known: dict[tuple, frozenset] = {}
        out = []
        for page, paths in zip(column, removed.to_pylist(), strict=True):
            key = tuple(paths or ())
            if key not in known:
                known[key] = frozenset(key)
            out.append(main_text(page.as_py(), known[key]))
        return pa.array(out, pa.string())

    removed = removed_branches(pages, settings)
    frame = packed(pages, {"html": "html", "host": host_of(F.col("url"))}, ("html", "host", "text"))
    hosted = frame.join(removed, F.col("host") == F.col("_host"), "left")
    text = F.arrow_udf(texts, "string")(F.col("html").cast("string"), F.col("_removed"))
    return unpacked(hosted.withColumn("text", text), pages, ("host", "text"), html="html", host="host", text="text")
