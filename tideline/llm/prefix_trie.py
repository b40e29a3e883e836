"""Trie of conversation prefixes from vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Conversations are
dealt out by range of their first turns' digests and then their id, and each task cuts its range into shards of a set
number of conversations. A shard indexes (position, turn) to a bitset of its conversations; depth first, the parent's
bitset is intersected with the postings of the next position, one intersection per child, which gives children, popcounts
and the list of conversations that end there.

In the order that the shards follow, the members of a node lie together. So a node that does not hold a shard's first or
last conversation is whole in that shard, and all its figures are final there. The others, ``open`` nodes, are a path or
two per shard (and, where more conversations than a shard share all the turns they are dealt out by, the nodes below):
their parts are added up by a digest of the sequence, and sums over subtrees follow by doubling pointers to ancestors,
in a number of rounds that grows with the logarithm of the depth. Neither a common first turn nor a much-copied
conversation meets in one task. The turn digests (16 bytes each) of one conversation are one row.

Edge cases: turns are ordered by number, null first, then by digest; a null role or text is empty, and both are told
apart by the length of the role. Rows without a conversation id belong to none. Repeated rows are turns of their own. A
conversation without turns is a member of the root alone. No conversations give no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise


@dataclass(frozen=True)
class TrieSettings:
    #: Conversations of a shard.
    shard: int = 4096
    #: First turns by which conversations are dealt out.
    order_turns: int = 8


@dataclass(frozen=True)
class Trie:
    """``nodes``: (conv_id, depth) of the smallest member names a node; parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ``ends``, the rising ids of members that end there (null where they lie in several shards).
    ``shard_ends``: (conv_id, depth, shard, members) of those nodes; rising from shard to shard."""

    nodes: DataFrame
    shard_ends: DataFrame


def digest(role: Column, text: Column) -> Column:
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, chars): digests and code points of each conversation's turns (conv_id, turn, role, text), in order."""
    chars = F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    turn = F.struct("turn", digest(F.col("role"), F.col("text")).alias("key"), chars.alias("chars"))
    lists = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return lists.select("conv_id", F.col("_turns.key").alias("keys"), F.col("_turns.chars").alias("chars"))


_PART = (
    "shard long, key binary, parent_key binary, parent_conv_id long, depth long, conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved long, chars long, ends array<long>"
)
ROOT = b""


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


@dataclass
class _Node:
    bits: int
    depth: int
    parent: int
    key: bytes | None  # of open nodes
    chars: int
    ended: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0


def shard_nodes(rows: list[tuple[int, list[bytes], list[int]]], order_turns: int) -> tuple[list[int], list[_Node]]:
    """Ids by bit and the nodes of a shard, parents first. ``rows`` in the order they were dealt out."""
    edges = {rows[0][0], rows[-1][0]}
    rows = sorted(rows)  # by id: the lowest bit is the smallest member
    edge = sum(1 << b for b, row in enumerate(rows) if row[0] in edges)
    postings: list[dict[bytes, int]] = []
    ended: dict[int, int] = {}
    for b, (_, keys, _) in enumerate(rows):
        postings += [{} for _ in range(len(keys) - len(postings))]
        for at, key in enumerate(keys):
            postings[at][key] = postings[at].get(key, 0) | 1 << b
        ended[len(keys)] = ended.get(len(keys), 0) | 1 << b
    nodes = [_Node((1 << len(rows)) - 1, 0, -1, ROOT, 0)]
    stack = [0]
    while stack:
        at = stack.pop()
        node = nodes[at]
        node.ended = node.bits & ended.get(node.depth, 0)
        rest = node.bits ^ node.ended
        while rest:
            first = rows[_lowest(rest)]
            turn = first[1][node.depth]
            bits = node.bits & postings[node.depth][turn]
            rest ^= bits
            shared = node.key is not None and (node.depth >= order_turns or bits & edge)
            key = hashlib.blake2b(node.key + turn, digest_size=16).digest() if shared else None
            stack.append(len(nodes))
            nodes.append(_Node(bits, node.depth + 1, at, key, first[2][node.depth]))
    for node in reversed(nodes):
        if node.key is not None:
            continue
        node.leaves += node.children == 0
        node.saved += (node.bits.bit_count() - 1) * node.chars
        above = nodes[node.parent]
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
    return [row[0] for row in rows], nodes


def _members(ids: list[int], bits: int) -> list[int]:
    out = []
    while bits:
        out.append(ids[_lowest(bits)])
        bits &= bits - 1
    return out


def _parts(lists: DataFrame, s: TrieSettings) -> DataFrame:
    """A row per node and shard: final figures of whole nodes, parts of open ones (``key``)."""
    first = F.slice("keys", 1, s.order_turns)
    dealt = lists.select("conv_id", "keys", "chars").repartitionByRange(first, "conv_id").sortWithinPartitions(first, "conv_id")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        base = TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in _PART.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[f.split()[1]] for f in _PART.split(", ")]

        def table(rows: list[tuple], shard: int):
            ids, nodes = shard_nodes(rows, s.order_turns)
            out: list[tuple] = []
            for node in nodes:
                above = nodes[node.parent] if node.parent >= 0 else None
                under_open = above is not None and above.key is not None
                parent = ids[_lowest(above.bits)] if above is not None and not under_open else None
                figures = (node.depth, ids[_lowest(node.bits)], node.bits.bit_count(), node.children, node.leaves, node.saved, node.chars)
                out.append((base + shard, node.key, above.key if under_open else None, parent, *figures, _members(ids, node.ended)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        held: list[tuple] = []
        shard = 0
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            while len(held) >= s.shard:
                yield table(held[: s.shard], shard)
                held, shard = held[s.shard :], shard + 1
        if held:
            yield table(held, shard)

    return dealt.mapInArrow(search, _PART)


def _subtree_sums(values: DataFrame, deepest: int) -> DataFrame:
    """``n_leaves`` and ``saved`` summed over subtrees of (key, up, n_leaves, saved). After k rounds ``up`` is the
    2^k-th ancestor, and the sums hold the descendants nearer than that."""
    state = values
    for _ in range(deepest.bit_length()):
        below = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("_at")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        hop = state.select(F.col("key").alias("_from"), F.col("up").alias("_to"))
        state = materialise(
            state.join(below, F.col("key") == F.col("_at"), "left")
            .join(hop, F.col("up") == F.col("_from"), "left")
            .select("key", F.col("_to").alias("up"), *((F.col(c) + F.coalesce(p, F.lit(0))).alias(c) for c, p in (("n_leaves", F.col("_leaves")), ("saved", F.col("_saved"))))),
            "subtrees",
        )
    return state.select("key", "n_leaves", "saved")


def prefix_trie(lists: DataFrame, settings: TrieSettings | None = None) -> Trie:
    """The trie of (conv_id, keys, chars), one row per conversation, as ``turn_lists`` gives them."""
    s = settings or TrieSettings()
    parts = materialise(_parts(lists, s), "trie_parts")
    opened, whole = parts.where(F.col("key").isNotNull()), parts.where(F.col("key").isNull())
    total = opened.groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("parent_key", "depth", "chars")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved"))
    )
    total = materialise(total, "open_nodes")
    deepest = total.agg(F.max("depth")).first()[0] or 0
    more = total.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("_of")).agg(F.count(F.lit(1)).alias("_more"))
    total = total.join(more, F.col("key") == F.col("_of"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    own = total.select(
        "key", F.col("parent_key").alias("up"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    sums = _subtree_sums(materialise(own, "open_values"), deepest)
    above = total.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens")]
    none = F.lit(None).cast("array<long>").alias("ends")
    merged = total.drop("n_leaves", "saved").join(sums, "key").join(above, "parent_key", "left").select(*figures, none)
    # A parent's id goes to its shards first, so that many children of one node do not meet under its key.
    named = opened.select("shard", "key").join(total.select("key", F.col("conv_id").alias("_up")), "key").withColumnRenamed("key", "parent_key")
    under = whole.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(named, ["shard", "parent_key"])
    under = under.withColumnRenamed("_up", "parent_conv_id").select(*figures, "ends")
    inside = whole.where(F.col("parent_key").isNull()).select(*figures, "ends")
    pieces = opened.where(F.size("ends") > 0).select("key", "shard", F.col("ends").alias("members"))
    pieces = pieces.join(total.select("key", "conv_id", "depth"), "key").select("conv_id", "depth", "shard", "members")
    return Trie(inside.unionByName(under).unionByName(merged), pieces)


def listed(trie: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``, the digest of the rising ids of members that end there, comma-joined.

    Lists over several shards are run through the digest shard by shard, without being put together."""
    kind = "conv_id long, depth long, _sha string"

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["conv_id", "depth", "_sha"])

        at, running = None, None
        for batch in batches:
            done = []
            for conv_id, depth, members in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if at != (conv_id, depth):
                    if at is not None:
                        done.append((*at, running.hexdigest()))
                    at, running = (conv_id, depth), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(",".join(map(str, members)).encode())
            if done:
                yield batch_of(done)
        if at is not None:
            yield batch_of([(*at, running.hexdigest())])

    order = ["conv_id", "depth", "shard"]
    spread = trie.shard_ends.repartition("conv_id", "depth").sortWithinPartitions(*order).mapInArrow(digests, kind)
    here = F.sha2(F.array_join(F.coalesce(F.col("ends").cast("array<string>"), F.array().cast("array<string>")), ","), 256)
    whole = trie.nodes.where(F.col("ends").isNotNull()).withColumn("ends_sha256", here).drop("ends")
    others = trie.nodes.where(F.col("ends").isNull()).join(spread, ["conv_id", "depth"], "left")
    return whole.unionByName(others.withColumn("ends_sha256", F.coalesce("_sha", here)).drop("ends", "_sha"))
