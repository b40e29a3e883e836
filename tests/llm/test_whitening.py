import math

import numpy as np
import pytest

from tideline.llm import whitening as W

SMALL = W.WhiteningSettings(block_rows=37)


def brute(vectors, scale=256.0, k=4):
    """Row numbers kept, n, deviations, variances and components by plain sums of Python's whole numbers."""
    rows = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(scale * float(np.float32(c))) for c in vectors[i]] for i in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    dev = {i: sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in rows}
    white = {i: (np.array(x[i]) - np.array(sums) / n) @ axes[:, order] / np.sqrt(values[order]) for i in rows}
    return n, dev, white, values[order] / np.trace(cov)


def test_scatter_equals_plain_sums():
    rng = np.random.default_rng(1)
    for low, high in ((-5, 9), (0, 1), (-(2**62), 2**62), (7, 8)):
        x = rng.integers(low, high, (130, 5), dtype=np.int64)
        sums, products = W.scatter(x)
        y = x.astype(object)
        assert (sums == y.sum(0)).all() and (products == y.T @ y).all()
        back = sum(part.astype(object) << (W.LIMB_BITS * k) for k, part in enumerate(W.limbs(products.ravel())))
        assert (back == products.ravel()).all()


def test_quantised_saturates_and_floors():
    got = W.quantised(np.array([-0.0, 1e300, -1e300, -1e-9, 0.5, 1.999]), 256.0)
    assert got.tolist() == [0, 2**63 - 1, -(2**63), -1, 128, 511]


def _table(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 0.3).tolist()
    v += [v[0]] * 150  # a vector that a third of the rows share
    v[7][2], v[8][0], v[9][1], v[10] = None, float("nan"), float("inf"), None
    return v


def test_against_brute_force(spark, vectors):
    got = W.whiten(_table(spark, vectors).withColumn("n", W.F.lit("clash")), settings=SMALL).toPandas()
    n, dev, white, explained = brute(vectors)
    assert len(got) == 4 * len(dev) and set(got.n) == {n} and (got.identity_error < 1e-9).all()
    sign = {}
    for r in got.itertuples():
        assert int(r.deviation) == dev[r.vec_id]
        want = white[r.vec_id][r.component - 1]
        sign.setdefault(r.component, 1.0 if want * r.whitened > 0 else -1.0)
        assert r.whitened * sign[r.component] == pytest.approx(want, abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)


def test_empty_ragged_and_constant(spark):
    assert W.whiten(_table(spark, [])).count() == 0
    assert W.whiten(_table(spark, [None, [float("nan")], []])).count() == 0
    flat = W.whiten(_table(spark, [[1.0, 2.0], [1.0, 2.0]])).toPandas()
    assert len(flat) == 4 and (flat.whitened == 0).all() and (flat.explained == 0).all() and (flat.n == 1).all()
    ragged = W.whiten(_table(spark, [[1.0, 2.0], [3.0, 1.0], [4.0], [0.5, 0.5]])).toPandas()
    assert set(ragged.vec_id) == {0, 1, 3}


def test_huge_entries_stay_exact(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [0.0, 3.0]]
    got = W.whiten(_table(spark, vectors)).toPandas()
    x = [[2**63 - 1, 256], [-(2**63), 512], [0, 768]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    firsts = got[got.component == 1].sort_values("vec_id").deviation
    assert [None if v is None else int(v) for v in firsts] == [w if w < 10**38 else None for w in want]


def test_query(spark):
    from tideline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_whitening"](spark, sf).toPandas()
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    n, dev, white, _ = brute(vectors)
    assert set(got.n) == {n} and len(got) == 4 * len(vectors) and (got.identity_error < 1e-9).all()
    assert got.deviation.dtype == "int64" and all(dev[i] == d for i, d in zip(got.vec_id, got.deviation, strict=True))
    for r in got.itertuples():
        assert abs(r.whitened) == pytest.approx(abs(white[r.vec_id][r.component - 1]), abs=1e-8)
