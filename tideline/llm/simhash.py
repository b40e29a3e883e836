"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits; a bit is set where over half of a text's shingle hashes have it set. Distinct fingerprints
(each standing for all its documents) are spread over shards by vantage-point trees: a node sends a fingerprint left if
its Hamming distance to the node's vantage point is at most the node's radius. Every fingerprint is stored in one shard
and is looked up in every shard that the triangle inequality leaves open, so pairs across boundaries are found, and
found exactly. Two trees, for even and odd numbers of set bits, make use of the fact that distances between a vantage
point and fingerprints of one parity differ by even numbers: within a parity the search radius is 2, across it is 1.

The upper trees are fitted on a bounded sample of fingerprints (they set how even the shards are, never what is found).
Inside a shard the same search goes on in numpy until sides are small. A task returns a spanning forest of the links it
found rather than the links, and components come from alternating star contractions of those edges, each round written
to the shared folder.

Edge cases: null and empty texts have the fingerprint zero, which is linked like any other; equal texts, ties and
repeated rows share a fingerprint and so a component; the id of a component is its smallest non-null doc_id (null if it
has none); an empty table gives an empty result. Other columns are passed through whatever their names, but for those
named ``fingerprint`` or ``component_id``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.rows import packed, unpacked
from tideline.session import materialise


@dataclass(frozen=True)
class SimhashSettings:
    words: int = 3
    distance: int = 2
    #: Most fingerprints that the upper trees are fitted on.
    sample: int = 65536
    #: Fingerprints per shard that the trees aim at; sides compared directly in a shard.
    shard: int = 1024
    leaf: int = 256
    most_shards: int = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """As a signed 64-bit number."""
    import xxhash

    # bytes.lower changes A-Z only and bytes.split parts at ASCII white space only.
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(hashes))
    return int(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)).view(np.int64)) if len(bits) else 0


def with_fingerprint(frame: DataFrame, settings: SimhashSettings) -> DataFrame:
    words = settings.words

    def hashed(texts):
        import pyarrow as pa

        return pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64())

    return frame.withColumn("fingerprint", F.arrow_udf(hashed, "long")(F.col("text").cast("string")))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass(frozen=True)
class Tree:
    """A node is (vantage, radius, left, right); a side below zero is shard -1 - side."""

    nodes: tuple[tuple[int, int, int, int], ...]
    shards: int

    def _walk(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, indexes of the points that come there); ``reach`` zero: where they are stored."""
        stack = [(0 if self.nodes else -1, np.arange(len(points)))]
        while stack:
            side, at = stack.pop()
            if not len(at):
                continue
            if side < 0:
                yield -1 - side, at
                continue
            vantage, radius, left, right = self.nodes[side]
            far = distance(points[at], np.uint64(vantage)).astype(np.int64)
            stack.append((left, at[far - reach <= radius]))
            stack.append((right, at[far + reach > radius]))

    def places(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        found = list(self._walk(points, reach))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([at for _, at in found]), np.concatenate([np.full(len(at), shard) for shard, at in found])


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that part the points best; None if no candidate parts them."""
    best = None
    for vantage in (points[0], points[len(points) // 2], ~points[len(points) // 3], np.uint64(0)):
        far = distance(points, vantage)
        radius = int(np.median(far))
        for r in (radius - 1, radius):
            inside = int((far <= r).sum())
            if 0 < inside < len(points):
                near = int(((far >= r - 1) & (far <= r + 2)).sum())  # those that are looked up on both sides
                worth = near + abs(2 * inside - len(points))
                if best is None or worth < best[0]:
                    best = (worth, vantage, r)
    return best and (best[1], best[2])


def grow(points: np.ndarray, shards: int) -> Tree:
    """Split the fullest side until there are enough shards."""
    import heapq

    if shards < 2 or len(points) < 2:
        return Tree((), 1)
    nodes: list[list[int]] = []
    heap, leaves, serial = [(-len(points), 0, np.sort(points), None)], [], 1
    while heap and len(heap) + len(leaves) < shards:
        _, _, side, parent = heapq.heappop(heap)
        cut = _split(side) if len(side) > 1 else None
        if cut is None:
            leaves.append(parent)
            continue
        vantage, radius = cut
        nodes.append([int(vantage), radius, 0, 0])
        if parent:
            nodes[parent[0]][parent[1]] = len(nodes) - 1
        inside = distance(side, vantage) <= radius
        for which, part in ((2, side[inside]), (3, side[~inside])):
            heapq.heappush(heap, (-len(part), serial, part, (len(nodes) - 1, which)))
            serial += 1
    leaves += [parent for *_, parent in heap]
    if not nodes:
        return Tree((), 1)
    for shard, (node, which) in enumerate(leaves):
        nodes[node][which] = -1 - shard
    return Tree(tuple(map(tuple, nodes)), len(leaves))


def _links(queries: np.ndarray, stored: np.ndarray, reach: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, stored) within ``reach``, by vantage points until a side is small."""
    stack = [(queries, stored)]
    while stack:
        asked, held = stack.pop()
        if not len(asked) or not len(held):
            continue
        cut = _split(held) if len(held) > leaf else None
        if cut is None:
            rows = max(1, (1 << 17) // len(held))
            for at in range(0, len(asked), rows):
                block = asked[at : at + rows]
                i, j = np.nonzero(np.bitwise_count(block[:, None] ^ held[None, :]) <= reach)
                if len(i):
                    yield block[i], held[j]
            continue
        vantage, radius = cut
        inside = distance(held, vantage) <= radius
        far = distance(asked, vantage).astype(np.int64)
        stack.append((asked[far - reach <= radius], held[inside]))
        stack.append((asked[far + reach > radius], held[~inside]))


class _Forest:
    """Union-find over fingerprints; the root of a set is its smallest."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while x != top:
            self.parent[x], x = top, self.parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.parent if (r := self.root(x)) != x]


def _odd(points: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(points) & 1).astype(bool)


def link_edges(prints: DataFrame, settings: SimhashSettings) -> DataFrame:
    """(a, b), a > b: edges that connect exactly those fingerprints that links connect.

    ``prints``: distinct ``fingerprint``, a written table. Within a parity only even distances occur and across it only
    odd ones, so even fingerprints are stored for both and odd ones for their own parity.
    """
    s = settings
    spark = prints.sparkSession
    n = prints.count()
    chosen = prints.orderBy(F.xxhash64("fingerprint")).limit(s.sample) if n > s.sample else prints
    sample = np.array([r[0] for r in chosen.collect()], dtype=np.int64).view(np.uint64)  # at most s.sample numbers
    wanted = int(min(s.most_shards, max(1, n // (2 * s.shard))))
    odd = _odd(sample)
    trees = spark.sparkContext.broadcast((grow(sample[~odd], wanted), grow(sample[odd], wanted)))
    shards = [t.shards for t in trees.value]
    even_reach, odd_reach = s.distance - s.distance % 2, s.distance - (s.distance + 1) % 2

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            is_odd = _odd(points)
            parts = []  # fingerprint, shard, role: 0 stored, 1 looked up within its parity, 2 looked up across
            for parity in (0, 1):
                own, shift = points[is_odd == bool(parity)], parity * shards[0]
                for role, reach in ((0, 0), (1, even_reach)):
                    at, shard = trees.value[parity].places(own, reach)
                    parts.append((own[at], shard + shift, role))
            if odd_reach > 0:
                own = points[is_odd]
                at, shard = trees.value[0].places(own, odd_reach)
                parts.append((own[at], shard, 2))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p.view(np.int64) for p, _, _ in parts])),
                    pa.array(np.concatenate([k for _, k, _ in parts]).astype(np.int32)),
                    pa.array(np.concatenate([np.full(len(p), role, dtype=np.int8) for p, _, role in parts])),
                ],
                names=["fingerprint", "shard", "role"],
            )

    def search(rows):
        import pyarrow as pa

        points, role = rows.column("fingerprint").to_numpy().view(np.uint64), rows.column("role").to_numpy()
        stored = np.unique(points[role == 0])
        forest = _Forest()
        for which, reach in ((1, even_reach), (2, odd_reach)):
            for a, b in _links(points[role == which], stored, reach, s.leaf):
                apart = a > b if which == 1 else a != b
                for x, y in zip(a[apart].view(np.int64).tolist(), b[apart].view(np.int64).tolist(), strict=True):
                    forest.join(x, y)
        edges = forest.edges()
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    placed = prints.select("fingerprint").mapInArrow(place, "fingerprint long, shard int, role tinyint")
    return placed.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges, the root being the smallest of its component.

    Alternating large-star and small-star contractions: each round joins nodes with the smallest of their neighbours by
    an aggregate and an equality join, so a node with many edges is split like any skewed key. Ends when a round changes
    nothing.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = materialise(large.unionByName(least.where(F.col("m") < a).select("a", F.col("m").alias("b"))).where(a != b).distinct(), "large_star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialise(small.where(a != b).distinct(), "small_star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(a.alias("node"), b.alias("root"))
        before = now


def _grouped(frame: DataFrame, s: SimhashSettings) -> DataFrame:
    """A frame with doc_id and text, the latter replaced by ``fingerprint`` (a number), ``_root`` and ``component_id``."""
    hashed = materialise(with_fingerprint(frame, s).drop("text"), "fingerprints")
    classes = materialise(hashed.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")), "classes")
    roots = components(link_edges(classes.select("fingerprint"), s))
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root"))
    names = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    found = rooted.join(names, "_root").select("fingerprint", "_root", "component_id")
    return hashed.join(found, "fingerprint")


def near_duplicates(docs: DataFrame, settings: SimhashSettings | None = None, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    without = (text, "fingerprint", "component_id")
    found = _grouped(packed(docs, {"doc_id": "doc_id", "text": text}, without), settings or SimhashSettings())
    return unpacked(found, docs, without, fingerprint=F.lower(F.lpad(F.hex("fingerprint"), 16, "0")), component_id="component_id")


def representatives(docs: DataFrame, settings: SimhashSettings | None = None, text: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id (nulls last), and of rows that share it the
    one whose text has the smallest hash; of rows that are equal in both, one."""
    last = (1 << 63) - 1
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(last)), "_hash": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))}
    grouped = _grouped(docs.select("doc_id", F.col(text).alias("text"), *[c.alias(n) for n, c in keys.items()]), settings or SimhashSettings())
    chosen = grouped.groupBy("_root").agg(F.min(F.struct("_id", "_hash")).alias("_one")).select("_one.*")
    kept = packed(docs, keys).join(materialise(chosen, "chosen"), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return unpacked(kept, docs)
