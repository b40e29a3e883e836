"""Split tables: no overlap of train and test, sizes, and short series."""

from tideline.config import SplitSettings, from_dict
from tideline.operators import folds as X


def table(spark, sizes):
    return spark.createDataFrame([(f"s{n}", n) for n in sizes], "asset string, n bigint")


def test_adaptive_splits(spark):
    sizes = (90, 280, 450, 700, 1700, 2405, 6000)
    for expanding in (True, False):
        cfg = SplitSettings(n_splits=12, gap=3, expanding=expanding, max_train=504, strategy="adaptive")
        rows = X.walk_forward_splits(table(spark, sizes), cfg).collect()
        for r in rows:
            n = int(r["asset"][1:])
            assert 0 <= r["train_lo"] < r["train_hi"] <= r["test_lo"] < r["test_hi"] <= n
            assert r["test_lo"] == r["train_hi"] + 3 and r["train_hi"] - r["train_lo"] <= 504
        if expanding:
            assert {int(r["asset"][1:]) for r in rows} == set(sizes)
            assert sum(r["asset"] == "s6000" for r in rows) == 12


def test_fixed_splits(spark):
    sizes = (90, 320, 700, 6000)
    for expanding in (True, False):
        cfg = SplitSettings(n_splits=3, gap=2, test_size=100, expanding=expanding)
        folds = X.walk_forward_splits(table(spark, sizes), cfg)
        rows = {(int(r["asset"][1:]), r["fold"]): r for r in folds.collect()}
        assert sorted(rows) == [(320, 0), (320, 1), *((n, f) for n in (700, 6000) for f in range(3))]
        for (n, fold), r in rows.items():
            assert r["train_hi"] + 2 == r["test_lo"] and r["test_hi"] - r["test_lo"] == 100
            assert (r["train_lo"] == 0) == (expanding or fold == 0)
            assert rows[n, max(f for m, f in rows if m == n)]["test_hi"] == n
        assert [r["asset"] for r in X.unsplit(table(spark, sizes), folds).collect()] == ["s90"]


def test_sliding_splits_count(spark):
    rows = X.sliding_splits(table(spark, (259, 260, 320, 500000)), 200, 60, 60).groupBy("asset").count().collect()
    assert {r["asset"]: r["count"] for r in rows} == {"s260": 1, "s320": 2, "s500000": (500000 - 260) // 60 + 1}


def test_frames_and_scaling_use_train_rows_only(spark):
    rows = spark.range(400).selectExpr("'a' as asset", "id as rn", "cast(id as double) as x", "timestamp_ntz'2001-01-01' + make_dt_interval(cast(id as int)) as ts")
    folds = X.sliding_splits(X.lengths(rows), 100, 50, 50)
    frames = X.fold_frames(rows, folds)
    out = X.scale_folds(frames, ["x"]).toPandas()
    for _, g in out.groupby("fold"):
        train, test = g[g.role == "train"], g[g.role == "test"]
        assert len(train) == 100 and len(test) == 50 and train.ts.max() < test.ts.min()
        assert abs(train.x.mean()) < 1e-9 and abs(train.x.std(ddof=0) - 1) < 1e-9 and test.x.min() > train.x.max()


def test_settings_fall_back():
    s = from_dict({"features": {"ma_short": 0, "rsi_period": 9, "lags": [0, -1], "separation": 0}, "splits": {"n_splits": 2}})
    assert (s.features.ma_short, s.features.rsi_period, s.features.lags, s.features.separation) == (10, 9, (1, 2, 3, 5, 10), 0)
    assert s.splits.n_splits == 2
