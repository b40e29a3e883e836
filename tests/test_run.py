"""The whole run on short series, and what may depend on test rows."""

import numpy as np
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from tideline.config import FeatureSettings, Settings, SplitSettings
from tideline.plans import run as R
from tideline.plans.registry import REGISTRY, ModelJob, model_job
from tideline.sources.store import ResultStore

SCHEMA = "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"
SETTINGS = Settings(assets=("A", "B", "IDX"), features=FeatureSettings(keep_high_correlation=False), splits=SplitSettings(n_splits=2, test_size=30))


@pytest.fixture(scope="module")
def bars(spark):
    pdf = make_bars({"A": 260, "B": 260, "IDX": 260, "SHORT": 90}, seed=11)
    return spark.createDataFrame(pdf, SCHEMA).persist()


def test_all_stages(spark, bars, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    models = ("naive", "linear", "arx", "garch", "forest")
    classifiers = ("last", "forest", "garch", "arx")
    tables = R.full_run(bars, SETTINGS, store, "007", models, classifiers, sources=("A",), export=True, modules=("lagged",), pairs=(("A", "IDX"),), index_asset="IDX")
    counts = {(r["asset"], r["model"], r["task"]): r["n"] for r in tables["predictions"].groupBy("asset", "model", "task").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(a, m, "regression") for a in ("A", "B", "IDX") for m in (*models, "ensemble")} | {(a, m, "classification") for a in ("A", "B", "IDX") for m in (*classifiers, "ensemble")}
    assert set(counts) >= {w for w in want if w[1] != "ensemble"} and set(counts.values()) == {60}
    assert {r["asset"] for r in tables["left_out"].collect()} == {"SHORT"}
    metrics = tables["metrics"].toPandas()
    assert (metrics[metrics.task == "regression"].mse > 0).all() and metrics[metrics.task == "classification"].accuracy.between(0, 1).all()
    assert (metrics[metrics.model != "ensemble"].model_seconds > 0).all()
    for name in ("performance", "comparison", "fold_index", "regime_metrics", "leakage", "contributions", "importance", "transfer", "bar_checks", "leaderboard"):
        assert tables[name].count() > 0, name
    assert {r["model"] for r in tables["contributions"].select("model").distinct().collect()} == {"linear", "forest"}
    total = tables["contributions"].filter("model = 'forest'").groupBy("asset", "fold", "ts").agg(F.sum("contribution").alias("c"))
    gap = tables["predictions"].filter("model = 'forest' AND task = 'regression'").join(total, ["asset", "fold", "ts"])
    assert gap.count() == 180 and all(r["s"] < 1e-9 for r in gap.groupBy("fold").agg(F.stddev_pop(F.col("y_pred") - F.col("c")).alias("s")).collect())  # one base per model
    assert store.run("007")["run_id"] == "007"


class Stopped(Exception):
    pass


def test_a_broken_run_is_resumed_and_never_seen_in_part(spark, bars, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path / "store"))
    plain = dict(models=("naive", "linear"), classifiers=("last",), modules=("lagged",))
    first = R.full_run(bars, SETTINGS, store, "r", **plain)
    before = sorted(map(str, first["predictions"].collect()))
    calls, broken = [], [True]

    def counted(name, run):
        def call(*args):
            calls.append(name)
            if name == "third" and broken[0]:
                raise Stopped
            return run(*args)

        return call

    linear = model_job("linear").on_frames
    for name in ("one", "two", "third"):
        monkeypatch.setitem(REGISTRY, (name, "regression"), ModelJob(on_frames=counted(name, linear)))
    more = plain | {"models": ("one", "two", "third")}
    with pytest.raises(Stopped):
        R.full_run(bars, SETTINGS, store, "r", **more)
    assert calls == ["one", "two", "third"]
    for table in ("predictions", "metrics", "fold_metrics"):
        assert {r["model"] for r in store.load(table, "r").select("model").distinct().collect()} == {"naive", "linear", "last"}
    assert sorted(map(str, store.load("predictions", "r").select(*first["predictions"].columns).collect())) == before
    broken[0] = False
    tables = R.full_run(bars, SETTINGS, store, "r", **more)
    assert calls == ["one", "two", "third", "third"]
    assert {r["model"] for r in tables["predictions"].select("model").distinct().collect()} == {"one", "two", "third", "last", "ensemble"}
    assert {r["model"] for r in store.load("metrics").select("model").distinct().collect()} == {"one", "two", "third", "last", "ensemble"}
    # a finished attempt is not resumed, and another digest is another attempt
    assert store.attempt("r", "other").seconds == {} and store.view("r").load("metrics", "r").count() > 0
    assert store.load_run("r")["fold_metrics"].count() == store.load("fold_metrics", "r").count() > 0


def test_nothing_prepared_depends_on_test_rows(spark, bars):
    table, names, _ = R.feature_table(bars, SETTINGS, modules=("lagged", "nonlinear"))
    table = R.with_position(table).persist()
    folds = R.walk_forward_splits(R.lengths(table), SplitSettings(n_splits=1, test_size=40)).persist()
    start = folds.select("asset", "test_lo")
    noise = table.join(start, "asset").withColumns({c: F.when(F.col("rn") >= F.col("test_lo"), F.col(c) * 1000 + 7).otherwise(F.col(c)) for c in [*names, "y"]}).drop("test_lo")
    sides = []
    for rows in (table, noise):
        frames, dropped = R.prepared_frames(rows, folds, names, 0.05, False)
        train = frames.filter("role = 'train'").orderBy("asset", "ts").select(*names).toPandas().to_numpy(dtype=float)
        sides.append((train, sorted(map(tuple, dropped.collect()))))
    np.testing.assert_allclose(sides[0][0], sides[1][0], rtol=1e-9, atol=1e-9)
    assert sides[0][1] == sides[1][1] and sides[0][1]


def test_class_weights_reach_the_fit(spark):
    from tideline.models.trees import balanced

    rows = spark.createDataFrame([(1,)] * 9 + [(0,)], "label int")
    weighted, name = balanced(rows, "label", 5.0)
    assert name and {r[0]: round(r[1], 6) for r in weighted.distinct().collect()} == {1: round(10 / 18, 6), 0: 5.0}
    assert balanced(rows, "label", 10.0)[1] is None
