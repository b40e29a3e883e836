"""Unit-root tests against plain regressions."""

import numpy as np
import pandas as pd
import pytest

from tideline.models import linear
from tideline.operators import unitroot as U


def plain(x, most):
    """(lag, t) of the order that AIC chooses over the rows that all orders share."""
    d = np.diff(x)
    y = d[most:]
    best = (np.inf, None, None)
    for p in range(most + 1):
        cols = [x[most:-1], *(d[most - i : -i] for i in range(1, p + 1)), np.ones(len(y))]
        a = np.column_stack(cols)
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        aic = len(y) * np.log(e @ e / len(y)) + 2 * (p + 2)
        if aic < best[0]:
            se = np.sqrt(e @ e / (len(y) - p - 2) * np.linalg.inv(a.T @ a)[0, 0])
            best = (aic, p, b[0] / se)
    return best[1], best[2]


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(size=800)
    near = [0.0]
    for e in noise:
        near.append(0.5 * near[-1] + e)
    series = {"walk": np.cumsum(noise), "near": np.array(near[1:]), "lagged": np.cumsum(np.convolve(noise, [1, 0.6, 0.3])[:800]), "flat": np.full(60, 2.0), "short": np.arange(4.0) ** 2}
    pdf = pd.concat([pd.DataFrame({"asset": k, "rn": np.arange(len(v)), "ts": pd.date_range("2001-01-01", periods=len(v)), "y": v}) for k, v in series.items()])
    return series, spark.createDataFrame(pdf, "asset string, rn bigint, ts timestamp_ntz, y double").persist()


def test_lag_terms_equal_a_regression(walks):
    series, df = walks
    got = {r["asset"]: r for r in U.augmented_dickey_fuller(df, "y", most=3).collect()}
    for name in ("walk", "near", "lagged"):
        lag, t = plain(series[name], 3)
        assert got[name]["lag"] == lag and abs(got[name]["adf"] - t) < 1e-6 and got[name]["n"] == 796
        assert got[name]["p_value"] == pytest.approx(U.chance(t), rel=1e-6)
    assert got["near"]["p_value"] < 0.001 and got["walk"]["p_value"] > 0.05
    assert got["flat"]["lag"] is None and "short" not in got


def test_surface_gives_the_published_critical_values():
    for t, p in ((-3.43, 0.01), (-2.8621, 0.05), (-2.567, 0.10)):
        assert abs(U.chance(t) - p) < 0.002
    assert U.chance(-30.0) == 0 and U.chance(5.0) == 1


def test_folds_are_differenced_by_their_train_rows(spark, walks):
    series, df = walks
    ranges = [(a, f, 0, hi, hi, hi + 20) for a in ("walk", "near") for f, hi in enumerate((300, 700))]
    folds = spark.createDataFrame(ranges, "asset string, fold bigint, train_lo bigint, train_hi bigint, test_lo bigint, test_hi bigint")
    got = {(r["asset"], r["fold"]): r["d"] for r in U.fold_differencing(df, folds, most_lag=2).collect()}
    for a, f, lo, hi, *_ in ranges:
        assert got[a, f] == int(U.chance(plain(series[a][lo:hi], 2)[1]) >= 0.05)
    assert got["near", 1] == 0 and got["walk", 1] == 1
    auto = linear.arx_folds(df, folds, d="auto").toPandas()
    each = {k: linear.arx_folds(df, folds, d=k).toPandas() for k in (0, 1)}
    four = {(r["asset"], r["fold"]): r["d"] for r in U.fold_differencing(df, folds).collect()}
    for (a, f), k in four.items():
        mine, want = (t[(t.asset == a) & (t.fold == f)].sort_values("ts").y_pred.to_numpy() for t in (auto, each[k]))
        assert len(mine) == 20 and np.allclose(mine, want)
