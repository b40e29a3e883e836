import numpy as np
import pytest
import xxhash

from tideline.llm import simhash as S

SMALL = S.SimhashSettings(shard=32, leaf=8, sample=300)


def plain_fingerprint(text):
    w = [x for x in "".join(c if not "A" <= c <= "Z" else c.lower() for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, reach=2):
    """Smallest member of each component, by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= reach:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {p: find(p) for p in prints}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    out = []
    for k in range(n):
        x = int(centres[k % 6]) if k % 3 else int(rng.integers(0, 1 << 63, dtype=np.uint64))
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_match_all_pairs(spark, seed):
    prints = clustered(700, seed)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(3)
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in S.components(S.link_edges(frame, SMALL)).collect()}
    want = groups(prints)
    same = lambda g, ps: {frozenset(p for p in ps if g.get(p, p) == r) for r in {g.get(p, p) for p in ps}}
    assert same(got, want) == same(want, want)


def test_tree_stores_each_point_once_and_reaches_all():
    points = np.unique(np.array(clustered(2000, 9), dtype=np.uint64))
    tree = S.grow(points[:200], 16)
    at, shard = tree.places(points, 0)
    assert sorted(at) == list(range(len(points))) and tree.shards > 8
    home = dict(zip(at.tolist(), shard.tolist(), strict=True))
    reached = {}
    for a, k in zip(*(x.tolist() for x in tree.places(points, 2)), strict=True):
        reached.setdefault(a, set()).add(k)
    for i in range(0, len(points), 7):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2):
            assert home[int(j)] in reached[i]


TEXTS = [
    (5, "one two three four five six"), (3, "ONE two\tthree four\nfive six"), (9, None), (8, ""), (7, " \n"), (None, "one two three four five six"),
    (1, "Éa b"), (2, "éa b"), (4, "word"), (6, "entirely other words are standing here in a row"), (6, "entirely other words are standing here in a row"), (10, "z " * 30000),
]


def test_documents_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in TEXTS], "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect())
    prints = [(i, plain_fingerprint(t)) for i, t in TEXTS]
    root = groups([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    assert got == sorted((str(i), f"{p:016x}", least.get(root[p])) for i, p in prints)


def test_representatives(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in TEXTS], "doc_id long, text string, source string")
    out = S.representatives(docs)
    assert out.columns == docs.columns
    root = groups([plain_fingerprint(t) for _, t in TEXTS])
    least = {}
    for i, t in TEXTS:
        if i is not None:
            least[root[plain_fingerprint(t)]] = min(i, least.get(root[plain_fingerprint(t)], i))
    assert sorted(r.doc_id for r in out.collect()) == sorted(least.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.representatives(docs).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.root for r in S.components(edges).collect()} == {0}
