"""Model jobs: least squares, recursion, GARCH chunks, permutations, ensembles, transfer."""

import numpy as np
import pandas as pd
import pytest
from conftest import same
from pyspark.sql import functions as F

from tideline.config import SplitSettings
from tideline.models import linear, trees
from tideline.operators import ensemble, folds as X


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(1)
    parts = []
    for asset, n, b in (("a", 600, (1.0, -2.0)), ("b", 300, (0.5, 3.0))):
        x1, x2 = rng.normal(size=n), rng.normal(5, 2, n)
        noise = rng.normal(0, 0.1, n)
        parts.append(pd.DataFrame({
            "asset": asset, "ts": pd.date_range("2001-01-01", periods=n), "rn": np.arange(n), "n": n,
            "x1": x1, "x2": x2, "y": 4 + b[0] * x1 + b[1] * x2 + noise, "ret": rng.normal(0, 0.02, n),
        }))
    schema = "asset string, ts timestamp_ntz, rn bigint, n bigint, x1 double, x2 double, y double, ret double"
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf, schema).persist()


def test_least_squares(design):
    pdf, df = design
    got = {r["asset"]: r for r in linear.fit_linear(df, ["x1", "x2"], "y", ["asset"]).collect()}
    for asset, g in pdf.groupby("asset"):
        a = np.c_[g.x1, g.x2, np.ones(len(g))]
        b, res, *_ = np.linalg.lstsq(a, g.y, rcond=None)
        same([*got[asset]["coefs"], got[asset]["intercept"]], b, 1e-6)
        assert abs(got[asset]["sse"] - res[0]) < 1e-5


def test_moments_equal_numpy(spark):
    from tideline.functions.gram import group_moments
    from tideline.operators.selection import correlation_matrix

    rng = np.random.default_rng(5)
    k, n = 12, 4000
    x = rng.normal(1e6, 1, (n, k)) @ np.diag(rng.uniform(0.1, 10, k)) + rng.normal(size=(n, 1))
    x[rng.random((n, k)) < 0.1] = np.nan
    x[:, 3] = 0.1
    cols = [f"c{i}" for i in range(k)]
    pdf = pd.DataFrame(x, columns=cols).assign(g=np.where(np.arange(n) % 10 < 8, "hot", "cold"))
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in cols) + ", g string").repartition(7)
    for r in group_moments(df, cols, ["g"], cols).collect():
        own = pdf[pdf.g == r["g"]][cols].dropna().to_numpy()
        assert r["counts"][0] == len(own)
        same(np.reshape(r["comoment"], (k, k)) / len(own), np.cov(own.T, ddof=0), 1e-9)
        same(np.reshape(r["mean"], (k, k))[:, 0], own.mean(0), 1e-12)
    want = pdf[pdf.g == "hot"][cols].corr()
    for r in correlation_matrix(df, cols, ["g"]).filter("g = 'hot'").collect():
        if "c3" in (r["feature_1"], r["feature_2"]):
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - want.loc[r["feature_1"], r["feature_2"]]) < 1e-9


def test_many_matrices_of_one_group_are_merged_in_a_stream(spark, monkeypatch):
    from tideline.functions import gram

    rng = np.random.default_rng(8)
    x = rng.normal(5, 2, (4000, 3))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(g="hot")
    df = spark.createDataFrame(pdf).repartition(500)
    parts = gram._partial(df, list("abc"), ["g"])
    assert parts.count() > 400
    one = gram.merged_moments(parts, ["g"]).collect()
    assert len(one) == 1 and one[0]["counts"][0] == 4000
    same(np.reshape(one[0]["comoment"], (3, 3)) / 4000, np.cov(x.T, ddof=0), 1e-9)


def test_moments_of_folds_equal_copied_rows(design):
    from tideline.functions.gram import range_moments

    pdf, df = design
    ranges = [(a, f, lo, hi) for a in ("a", "b") for f, (lo, hi) in enumerate([(0, 40), (0, 250), (3, 280), (17, 18), (5, 5), (100, 128), (64, 192)])]
    folds = df.sparkSession.createDataFrame(ranges, "asset string, fold bigint, train_lo bigint, train_hi bigint")
    cols = ["x1", "x2", "y"]
    got = {(r["asset"], r["fold"]): r for r in range_moments(df, folds, cols, ["asset"], width=32).collect()}
    assert len(got) == 12  # an empty range has no row
    for a, f, lo, hi in ranges:
        x = pdf[(pdf.asset == a) & (pdf.rn >= lo) & (pdf.rn < hi)][cols].to_numpy()
        if len(x):
            assert got[a, f]["counts"][0] == len(x)
            same(np.reshape(got[a, f]["mean"], (3, 3))[:, 0], x.mean(0), 1e-12)
            same(np.reshape(got[a, f]["comoment"], (3, 3)), (x - x.mean(0)).T @ (x - x.mean(0)), 1e-9)


def test_linear_folds_equal_a_fit_per_fold(design):
    pdf, df = design
    folds = X.walk_forward_splits(X.lengths(df), SplitSettings(n_splits=4, test_size=30))
    got = linear.linear_folds(df, folds, ["x1", "x2"])
    assert "train" not in got._jdf.queryExecution().optimizedPlan().toString().replace("train_lo", "").replace("train_hi", "")
    got = got.toPandas()
    for f in folds.collect():
        g = pdf[pdf.asset == f.asset]
        a, b = (g[(g.rn >= lo) & (g.rn < hi)] for lo, hi in ((f.train_lo, f.train_hi), (f.test_lo, f.test_hi)))
        coef, *_ = np.linalg.lstsq(np.c_[a.x1, a.x2, np.ones(len(a))], a.y, rcond=None)
        mine = got[(got.asset == f.asset) & (got.fold == f.fold)].sort_values("ts")
        same(mine.y_pred, np.c_[b.x1, b.x2, np.ones(len(b))] @ coef, 1e-7)


def test_collinear_features_stay_finite(design):
    _, df = design
    rows = df.withColumn("x3", F.col("x1") * 2).withColumn("zero", F.lit(0.0))
    for r in linear.fit_linear(rows, ["x1", "x3", "zero"], "y", ["asset"]).collect():
        assert np.isfinite(r["coefs"]).all() and np.isfinite(r["intercept"])


def test_autoregression(design):
    _, df = design
    folds = X.walk_forward_splits(X.lengths(df), SplitSettings(n_splits=2, test_size=60, gap=0))
    out = linear.arx_folds(df, folds, ["x1", "x2"], orders=(1, 2)).toPandas()
    want = folds.selectExpr("sum(test_hi - test_lo)").first()[0]
    assert len(out) == want and np.isfinite(out.y_pred).all()
    assert (out["lower"] < out.y_pred).all() and (out.y_pred < out.upper).all()
    assert np.sqrt(((out.y_true - out.y_pred) ** 2).mean()) < 0.2
    inside = ((out.y_true > out["lower"]) & (out.y_true < out.upper)).mean()
    assert 0.85 < inside <= 1


def test_permutation_is_one_to_one(design):
    pdf, df = design
    got = trees.permuted(df, "x1").toPandas()
    for asset, g in pdf.groupby("asset"):
        mine = got[got.asset == asset].sort_values("rn")
        assert sorted(mine.x1) == sorted(g.x1) and (mine.x1.values != g.x1.values).mean() > 0.9
        assert (mine.x2.values == g.x2.values).all()


def test_trees_predict_every_test_row(design):
    _, df = design
    folds = X.walk_forward_splits(X.lengths(df), SplitSettings(n_splits=1, test_size=60))
    out = trees.tree_folds(df, folds, ["x1", "x2"], "y", "forest", "regression", numTrees=5).toPandas()
    assert len(out) == folds.selectExpr("sum(test_hi - test_lo)").first()[0] and np.isfinite(out.y_pred).all()


def test_halving_finds_the_winner_of_the_full_grid_and_is_resumed(spark, design, monkeypatch, tmp_path):
    _, df = design
    folds = X.time_series_splits(X.lengths(df), 3)
    grid = {"maxDepth": [1, 4], "maxIter": [1, 6], "stepSize": [0.3]}
    ledger, fits, plain = str(tmp_path / "ledger"), [], trees.fit

    def counted(*args, **params):
        fits.append(params)
        return plain(*args, **params)

    monkeypatch.setattr(trees, "fit", counted)
    got = trees.halving_search(df, folds, ["x1", "x2"], "y", grid, keep=2, ledger=ledger).collect()
    full = trees.grid_search(df, folds, ["x1", "x2"], "y", grid)
    best = full.filter("is_best").first()
    assert got[0]["params"] == best["params"] and [r["rank"] for r in got] == [1, 2, 3, 4] and sorted(r["folds"] for r in got) == [1, 1, 2, 2]
    entries = spark.read.parquet(ledger).toPandas()
    assert len(entries) == 6 and not entries.duplicated(["params", "fold"]).any()
    fits.clear()
    again = trees.halving_search(df, folds, ["x1", "x2"], "y", grid, keep=2, ledger=ledger).collect()
    assert not fits and again == got


def test_ensembles(spark):
    rows = [("a", 0, 1, m, 1, p) for m, p in (("m1", 2), ("m2", 1), ("m3", 2))] + [("a", 0, 2, m, 0, p) for m, p in (("m1", 2), ("m2", 0))]
    df = spark.createDataFrame(rows, "asset string, fold int, ts int, model string, y_true int, y_pred int")
    got = {r["ts"]: r["y_pred"] for r in ensemble.majority_vote(df).collect()}
    assert got == {1: 2, 2: 0}
    mean = ensemble.weighted_mean(df, {"m1": 1.0, "m2": 3.0}).collect()
    assert {r["ts"]: r["y_pred"] for r in mean} == {1: 1.25, 2: 0.5}


def test_transfer_is_fitted_on_source(design):
    from tideline.plans.transfer import transfer_matrix

    pdf, df = design
    got = {(r["source"], r["target"]): r for r in transfer_matrix(df, ["x1", "x2"], "y", ["a", "b"]).collect()}
    src, dst = pdf[pdf.asset == "a"], pdf[pdf.asset == "b"]
    b, *_ = np.linalg.lstsq(np.c_[src.x1, src.x2, np.ones(len(src))], src.y, rcond=None)
    e = dst.y - np.c_[dst.x1, dst.x2, np.ones(len(dst))] @ b
    assert len(got) == 4 and abs(got["a", "b"]["mse"] - (e**2).mean()) < 1e-4
    assert got["a", "a"]["r2"] > 0.99 > got["a", "b"]["r2"]
