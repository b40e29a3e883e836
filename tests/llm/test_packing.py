import random
import zlib

import numpy as np
import pytest

from tideline.llm import packing as P
from tideline.llm.tokens import document_ids, vocabulary_path


def least_cost(total, points, costs, capacity):
    best = {0: 0.0}
    for at, cost in zip(points, costs, strict=True):
        best[at] = cost + min((best[i] + capacity - (at - i) for i in best if 0 < at - i <= capacity), default=np.inf)
    return best[total]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal_over_the_candidates(seed):
    rng = random.Random(seed)
    total, capacity, hard = rng.randrange(50, 400), 32, 1e6
    points = sorted({total, *(rng.randrange(1, total) for _ in range(total // 4)), *range(16, total, 16)})
    costs = [0.0 if rng.random() < 0.3 else 3.0 for _ in points]
    cuts = P.choose_cuts(total, np.array(points), np.array(costs), capacity, hard)
    lengths = np.diff([0, *cuts])
    assert cuts[-1] == total and lengths.max() <= capacity and set(cuts) <= set(points)
    known = dict(zip(points, costs, strict=True))
    assert sum(known[c] for c in cuts) + sum(capacity - lengths) == pytest.approx(least_cost(total, points, costs, capacity))


@pytest.mark.parametrize("seed", range(10))
def test_hard_cuts_fill_long_gaps(seed):
    rng = random.Random(seed)
    total = rng.randrange(100, 1000)
    points = sorted({total, *(rng.randrange(1, total) for _ in range(3))})
    cuts = P.choose_cuts(total, np.array(points), np.zeros(len(points)), 32, 8.0)
    lengths = np.diff([0, *cuts])
    assert cuts[-1] == total and lengths.min() > 0 and lengths.max() <= 32 and sum(32 - lengths) <= 32 * (len(points) + 1)


ROWS = [(1, None), (2, ""), (None, "null id"), (3, "A sentence. " * 3000), (3, "A sentence. " * 3000), (4, "nosentence " * 5000)] + [(10 + i, f"Text number {i}. It has words! " * (i % 60)) for i in range(400)]


def check(got, rows):
    ids = {}
    for i, t in rows:
        ids.setdefault(i, document_ids(t, vocabulary_path()))
    for r in got.itertuples():
        doc = ids[None if r.doc_id != r.doc_id else int(r.doc_id)]
        piece = doc[r.start : r.start + r.length]
        assert r.length > 0 and len(piece) == r.length and r.doc_tokens == len(doc) and zlib.crc32(piece.astype("<u4").tobytes()) == r.ids_crc32
    assert got["length"].sum() == sum(len(ids[i]) for i, _ in rows)
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))
    sums = []
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == np.concatenate(([0], np.cumsum(part["length"])[:-1])).tolist()
        sums.append(part["length"].sum())
    assert max(sums) <= 2048
    return 1 - sum(sums) / (2048 * len(sums))


def test_pieces_cover_every_id_once(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, offset int")
    assert check(P.pack(docs.coalesce(1)).toPandas(), ROWS) < 0.03
    check(P.pack(docs.repartition(7)).toPandas(), ROWS)
    assert check(P.pack(docs.coalesce(1), P.PackSettings(chunk_windows=2)).toPandas(), ROWS) < 0.1
    assert P.pack(docs.limit(0)).count() == 0


def test_order_is_kept(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    got = P.pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    order = [None if x != x else int(x) for x in got[got["start"] == 0]["doc_id"]]
    assert order == [i for i, _ in ROWS]
