import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import prefix_trie as P

SMALL = P.TrieSettings(shard=3, order_turns=2)
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """Rows of all nodes; ``conversations``: id to its list of (role, text)."""
    members = defaultdict(list)
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, ids in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(ids) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(conversations[c]) == len(path))
        up = members[path[:-1]][0] if path else None
        out.append((ids[0], len(path), up, len(ids), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def turns_of(rows):
    """Id to turns in order; of rows (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(t[2], t[3]) for t in sorted(v, key=lambda t: t[:2])] for c, v in out.items()}


def result(df):
    rows = [tuple(None if v != v else v for v in r) for r in df.select(*NAMES).toPandas().astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def random_rows(seed, n, hot):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        same = c in hot
        for t in range(5 if same else rnd.randint(1, 6)):
            rows.append((c * 7, t if t else None, "user" if t % 2 else None, f"turn {t}" if same else rnd.choice(["a", "bb", "ccc é", "", None])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [SMALL, P.TrieSettings(shard=1, order_turns=1), P.TrieSettings()])
def test_against_brute_force(spark, settings):
    rows = random_rows(3, 90, set(range(20, 50)))
    got = result(P.listed(P.prefix_trie(P.turn_lists(frame(spark, rows)), settings)))
    assert got == brute(turns_of(rows))


def test_one_deep_conversation_and_copies(spark):
    rows = [(c, t, "user", f"t{t}") for c in (1, 2, 3, 4, 5, 6, 7, 8) for t in range(60 if c % 2 else 33)]
    rows += [(9, 0, "user", "t0"), (9, 1, "user", "other"), (9, 2, "user", "t2"), (None, 0, "user", "t0")]
    got = result(P.listed(P.prefix_trie(P.turn_lists(frame(spark, rows)), SMALL)))
    assert got == brute(turns_of(rows))


def test_turnless_and_empty(spark):
    empty = P.turn_lists(frame(spark, []))
    assert P.listed(P.prefix_trie(empty)).count() == 0
    lists = spark.createDataFrame([(4, [], []), (2, [], []), (3, [b"x" * 16], [5])], "conv_id long, keys array<binary>, chars array<long>")
    got = result(P.listed(P.prefix_trie(lists, SMALL)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(2, 0, None, 3, 1, 1, 0, sha("2,4")), (3, 1, 2, 1, 0, 1, 0, sha("3"))]


def test_role_and_text_are_told_apart(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc"), (4, 0, None, "abc")]
    got = result(P.listed(P.prefix_trie(P.turn_lists(frame(spark, rows)))))
    assert [(r[0], r[3]) for r in got if r[1] == 1] == [(1, 1), (2, 1), (3, 2)]


def test_shard_ends_are_whole_and_rising(spark):
    rows = random_rows(5, 60, set(range(30)))
    trie = P.prefix_trie(P.turn_lists(frame(spark, rows)), SMALL)
    pieces = trie.shard_ends.orderBy("conv_id", "depth", "shard").collect()
    assert all(0 < len(p.members) <= 3 for p in pieces)
    joined = defaultdict(list)
    for p in pieces:
        joined[p.conv_id, p.depth] += p.members
    for r in trie.nodes.where(F.col("ends").isNotNull()).collect():
        joined[r.conv_id, r.depth] += r.ends
    assert all(v == sorted(v) for v in joined.values())
    assert sorted(c for v in joined.values() for c in v) == sorted(turns_of(rows))


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_query(spark):
    from compare import connection, differences

    from tideline.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_prefix_trie"](spark, sf)
    note = differences(got.toPandas(), connection(sf).execute(SQL["op12_prefix_trie"]).df())
    assert not note, note
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(got) == brute(rebuilt(turns_of(rows)))
