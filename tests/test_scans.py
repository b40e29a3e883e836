"""Recurrences in chunks against plain loops: variances of GARCH, hidden states."""

import numpy as np
import pandas as pd
import pytest
from conftest import same

from tideline.config import SplitSettings
from tideline.functions import scan
from tideline.models import garch, hmm
from tideline.operators import folds as X


@pytest.mark.parametrize("m", [0, 1, 2, 7, 97, 500])
def test_linear_recurrence(m):
    x = np.random.default_rng(m).normal(size=m) ** 2
    decay, gain, shift, v = np.array([0.5, 0.999]), np.array([0.1, 0.2]), np.array([0.01, 0.0]), np.array([1.0, 2.0])
    want = [v]
    for value in x:
        want.append(shift + gain * value + decay * want[-1])
    np.testing.assert_allclose(scan.affine_path(v, decay, shift, gain, x), want, rtol=1e-12)


@pytest.mark.parametrize("m", [1, 2, 7, 97])
@pytest.mark.parametrize("reduce", [scan.log_sum, scan.largest])
def test_matrix_chain(m, reduce):
    rng = np.random.default_rng(m)
    ms, v = rng.normal(size=(m, 3, 3)) * 3, rng.normal(size=3)
    on, down = [v], [v]
    for t in range(m):
        on.append(scan.onward(on[-1], ms[t], reduce))
        down.append(scan.back(ms[m - 1 - t], down[-1], reduce))
    np.testing.assert_allclose(scan.forward(v, ms, reduce), on, rtol=1e-10)
    np.testing.assert_allclose(scan.backward(v, ms, reduce), down[::-1], rtol=1e-10)
    np.testing.assert_allclose(scan.onward(v, scan.transfer(ms, reduce), reduce), on[-1], rtol=1e-10)
    maps = rng.integers(0, 3, (m, 3))
    for end in range(3):
        states = [end]
        for t in range(m - 1, -1, -1):
            states.append(maps[t][states[-1]])
        assert (scan.traced(maps)[:, end] == states[::-1]).all()


# ---- GARCH ----------------------------------------------------------------------------


def simulated(n, alpha, beta, s2=1e-4, seed=3):
    rng = np.random.default_rng(seed)
    out, v = np.empty(n), s2
    for t in range(n):
        out[t] = np.sqrt(v) * rng.normal()
        v = s2 * (1 - alpha - beta) + alpha * out[t] ** 2 + beta * v
    return out


def plain_variances(r, alpha, beta):
    s2 = np.mean(r * r)
    out = [s2]
    for x in r:
        out.append(s2 * (1 - alpha - beta) + alpha * x * x + beta * out[-1])
    return np.array(out)


def plain_fit(r, settings):
    """alpha, beta, last variance and likelihood by the same grid, in plain loops."""
    x = y = 0.0
    for stage in range(settings.refinements + 1):
        points = garch.grid_points(settings, stage, x, y)
        scores = []
        for a, b in zip(*garch.parameters(points), strict=True):
            v = plain_variances(r, a, b)
            scores.append(-0.5 * np.sum(np.log(2 * np.pi * v[:-1]) + r * r / v[:-1]))
        x, y = points[int(np.argmax(scores))]
    a, b = (float(p[0]) for p in garch.parameters(np.array([[x, y]])))
    return a, b, plain_variances(r, a, b)[-1], max(scores)


@pytest.fixture(scope="module")
def returns_table(spark):
    parts = []
    for asset, r in (("A", simulated(700, 0.06, 0.9)), ("B", simulated(450, 0.2, 0.7, seed=9)), ("C", np.full(12, 0.01)), ("D", np.zeros(60))):
        parts.append(pd.DataFrame({"asset": asset, "rn": np.arange(len(r)), "ts": pd.date_range("2001-01-01", periods=len(r)), "ret": r, "y": np.abs(r)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[pdf.index[[5, 300, 800]], "ret"] = np.nan
    rows = pdf.astype(object).where(pdf.notna(), None)
    return pdf, spark.createDataFrame(rows, "asset string, rn bigint, ts timestamp_ntz, ret double, y double").persist()


FAST = garch.GarchSettings(lack=(0.4, 0.005, 4), alpha=(0.02, 0.3, 4), refinements=2)


@pytest.mark.parametrize("size", [64, 10_000])
def test_garch_folds_equal_plain_loops(returns_table, size):
    pdf, df = returns_table
    folds = X.walk_forward_splits(X.lengths(df), SplitSettings(n_splits=2, test_size=60, gap=0))
    got = garch.garch_folds(df, folds, size=size, settings=FAST).toPandas()
    assert len(got) == folds.selectExpr("sum(test_hi - test_lo)").first()[0]
    for f in folds.collect():
        mine = pdf[(pdf.asset == f.asset) & (pdf.rn >= f.train_lo) & (pdf.rn < f.train_hi)]
        r = mine.ret.dropna().to_numpy()
        a, b, last, _ = plain_fit(r, FAST)
        out = got[(got.asset == f.asset) & (got.fold == f.fold)].sort_values("ts")
        same(out.alpha, np.full(len(out), a), 1e-12)
        same(out.beta, np.full(len(out), b), 1e-12)
        s2 = np.mean(r * r)
        std = np.sqrt(s2 + (a + b) ** np.arange(len(out)) * (last - s2))
        np.testing.assert_allclose(out.y_pred, std * garch.ANNUAL, rtol=1e-9)
        np.testing.assert_allclose(out.var_95, np.mean(r) + garch.NORMAL_LOWER[0.95] * std, rtol=1e-9, atol=1e-12)


def test_short_and_flat_ranges_have_no_fit(returns_table):
    _, df = returns_table
    chunks = garch.return_chunks(df, ["asset"], 64)
    ranges = X.lengths(df).selectExpr("asset", "0L AS fold", "0L AS lo", "n AS hi")
    got = {r["asset"]: r for r in garch.fit_ranges(chunks, ranges, size=64, settings=FAST).collect()}
    assert set(got) == {"A", "B", "C", "D"} and got["C"]["alpha"] is None and got["D"]["alpha"] is None
    assert got["C"]["rows"] == 12 and got["D"]["s2"] == 0 and got["A"]["alpha"] > 0


@pytest.mark.parametrize("size", [100, 10_000])
def test_conditional_volatility_equals_plain_loop(returns_table, size):
    pdf, df = returns_table
    got = garch.conditional_volatility(df, size=size, settings=FAST).toPandas()
    assert set(got.asset) == {"A", "B"}
    for asset, g in got.groupby("asset"):
        r = pdf[pdf.asset == asset].ret.dropna().to_numpy()
        a, b, *_ = plain_fit(r, FAST)
        same(g.sort_values("ts").cond_vol, np.sqrt(plain_variances(r, a, b)[:-1]), 1e-9)


def test_high_persistence_is_found(spark):
    r = simulated(40_000, 0.03, 0.969, seed=1)
    pdf = pd.DataFrame({"asset": "P", "rn": np.arange(len(r)), "ret": r})
    chunks = garch.return_chunks(spark.createDataFrame(pdf, "asset string, rn bigint, ret double"), ["asset"], 4096)
    ranges = spark.createDataFrame([("P", 0, 0, len(r))], "asset string, fold bigint, lo bigint, hi bigint")
    fit = garch.fit_ranges(chunks, ranges, size=4096).first()
    assert abs(fit["alpha"] - 0.03) < 0.006 and 0.9975 < fit["alpha"] + fit["beta"] < 0.9996


# ---- hidden Markov regimes ------------------------------------------------------------


def plain_hmm(r, start, trans, mean, var):
    """Log likelihood, posteriors, pair sums and best path by loops over rows, scaled."""
    start, trans, mean, var = np.array(start), np.reshape(trans, (len(mean), -1)), np.array(mean), np.array(var)
    dens = np.exp(-0.5 * (r[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var)
    n, k = dens.shape
    a, b, c = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        v = (start if t == 0 else a[t - 1] @ trans) * dens[t]
        c[t] = v.sum()
        a[t] = v / c[t]
    for t in range(n - 2, -1, -1):
        b[t] = trans @ (dens[t + 1] * b[t + 1]) / c[t + 1]
    pairs = sum(np.outer(a[t - 1], dens[t] * b[t]) * trans / c[t] for t in range(1, n))
    d, point = np.log(start) + np.log(dens[0]), []
    for t in range(1, n):
        x = d[:, None] + np.log(trans)
        point.append(x.argmax(0))
        d = x.max(0) + np.log(dens[t])
    path = [int(d.argmax())]
    for p in point[::-1]:
        path.append(int(p[path[-1]]))
    return np.log(c).sum(), a * b, pairs, np.array(path[::-1])


@pytest.fixture(scope="module")
def regimes(spark):
    parts = []
    for asset, n, seed in (("A", 900, 0), ("B", 400, 1), ("C", 231, 2), ("E", 30, 3)):
        rng = np.random.default_rng(seed)
        state, states = 0, []
        for _ in range(n):
            state = state if rng.random() < 0.95 else int(rng.integers(3))
            states.append(state)
        r = rng.normal(np.array([-0.02, 0.0, 0.015])[states], np.array([0.02, 0.004, 0.01])[states])
        parts.append(pd.DataFrame({"asset": asset, "rn": np.arange(n), "ts": pd.date_range("2001-01-01", periods=n), "ret": r}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf, "asset string, rn bigint, ts timestamp_ntz, ret double").persist()


@pytest.mark.parametrize("size", [50, 10_000])
def test_hidden_states_equal_plain_loops(regimes, size):
    pdf, df = regimes
    model = hmm.initial(df, ["asset"])
    models = {m["asset"]: m for m in model.collect()}
    assert set(models) == {"A", "B", "C"}
    chunks = hmm.return_chunks(df, size=size)
    step = {m["asset"]: m for m in hmm.improved(chunks, model).collect()}
    post, path = hmm.posteriors(chunks, model).toPandas(), hmm.best_path(chunks, model).toPandas()
    for asset, m in models.items():
        r = pdf[pdf.asset == asset].ret.to_numpy()
        loglik, gamma, pairs, want = plain_hmm(r, m["start"], m["trans"], m["mean"], m["var"])
        assert abs(step[asset]["loglik"] - loglik) < 1e-9 * abs(loglik)
        same(np.array(post[post.asset == asset].sort_values("rn").posterior.tolist()), gamma, 1e-9)
        assert (path[path.asset == asset].sort_values("rn").state.to_numpy() == want).all()
        mean = gamma.T @ r / gamma.sum(0)
        same(step[asset]["mean"], mean, 1e-9)
        same(step[asset]["var"], (gamma * (r[:, None] - mean) ** 2).sum(0) / gamma.sum(0), 1e-9)
        same(step[asset]["trans"], (pairs / pairs.sum(1, keepdims=True)).ravel(), 1e-9)
        same(step[asset]["start"], gamma[0], 1e-9)


def test_hidden_regimes(regimes):
    pdf, df = regimes
    few = hmm.HmmSettings(rounds=6, size=100)
    got = hmm.hidden_regimes(df, settings=few).toPandas()
    assert len(got) == (pdf.asset != "E").sum()
    again = hmm.hidden_regimes(df, settings=hmm.HmmSettings(rounds=6)).toPandas()
    order = ["asset", "ts"]
    assert (got.sort_values(order).state.to_numpy() == again.sort_values(order).state.to_numpy()).all()
    for _, g in got.groupby("asset"):
        means = g.groupby("regime").ret.mean()
        assert means["Bear"] == means.min() and means["Bull"] == means.max() and (g["rounds"] <= 6).all()


def test_rounds_raise_the_likelihood(regimes):
    _, df = regimes
    chunks, model, last = hmm.return_chunks(df), hmm.initial(df, ["asset"]), None
    for _ in range(4):
        model = hmm.materialise(hmm.improved(chunks, model), "model")
        now = {r["asset"]: r["loglik"] for r in model.collect()}
        assert last is None or all(now[a] >= last[a] - 1e-9 for a in now)
        last = now
