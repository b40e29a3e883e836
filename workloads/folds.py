"""Fold queries: split tables, fold frames and fold-wise preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.config import SplitSettings
from tideline.functions.safe import rounded
from tideline.operators import cleaning as C
from tideline.operators import folds as X
from tideline.operators.features import features
from tideline.operators.labels import quantile_labels
from workloads.fixtures import (
    PREDS,
    W,
    forecast_rows,
    predictions_reg,
    priority_bars,
    rnd,
    sliding_folds,
    with_sql,
)
from workloads.registry import query
from workloads.windows import TARGET, VOL5, shown

CFG = SplitSettings()
SIZES = "sizes AS (SELECT asset, count(*) AS n FROM bars GROUP BY asset)"
FOLD_COLS = "asset, fold, train_lo, train_hi, test_lo, test_hi"
FRAMES = """frames AS (SELECT p.asset, p.ts, p.rn, y, last, mean60, fold, CASE WHEN rn < train_hi THEN 'train' ELSE 'test' END AS role
  FROM py p JOIN folds f ON f.asset = p.asset AND rn >= train_lo AND rn < test_hi)"""


def sizes(spark, sf):
    return X.lengths(priority_bars(spark, sf))


def frames(spark, sf):
    rows = forecast_rows(spark, sf).select("asset", "ts", "rn", "y", "last", "mean60")
    return X.fold_frames(rows, sliding_folds(spark, sf))


@query("splits_sliding", with_sql(*PREDS[:3], select=f"SELECT {FOLD_COLS} FROM folds"))
def splits_sliding(spark, sf):
    return sliding_folds(spark, sf)


ADAPT = (
    SIZES,
    "a1 AS (SELECT *, least(252, greatest(20, least(504, greatest(1, n // 10)))) AS block, CASE WHEN n >= 5000 THEN 12 WHEN n >= 2000 THEN 8 WHEN n >= 1000 THEN 5 WHEN n >= 500 THEN 3 ELSE 1 END AS want FROM sizes)",
    "a2 AS (SELECT *, least(5, want, greatest(1, (n - 60) // greatest(1, block))) AS s FROM a1)",
    "a3 AS (SELECT *, CASE WHEN s = 1 THEN greatest(20, least(252, greatest(1, n // 5))) ELSE block END AS test FROM a2)",
    "a4 AS (SELECT *, CASE WHEN s = 1 THEN greatest(60, n - test) ELSE greatest(60, least(756, greatest(126, n // 8))) END AS mt FROM a3)",
    "a5 AS (SELECT *, unnest(range(0, s)) AS fold FROM a4)",
)
FIXED = (
    SIZES,
    "f1 AS (SELECT asset, n, least(5, greatest(0, (n - 5 - 60) // 252)) AS s FROM sizes)",
    "f2 AS (SELECT *, unnest(range(0, s)) AS fold FROM f1)",
    "f3 AS (SELECT *, n - (s - fold) * 252 AS test_lo FROM f2)",
)
EXPANDING = (*FIXED, "adaptive AS (SELECT asset, fold, CAST(0 AS BIGINT) AS train_lo, test_lo - 5 AS train_hi, test_lo, test_lo + 252 AS test_hi FROM f3)")
ROLLING = (*FIXED, "adaptive AS (SELECT asset, fold, test_lo - 5 - (n - s * 252 - 5) AS train_lo, test_lo - 5 AS train_hi, test_lo, test_lo + 252 AS test_hi FROM f3)")
ADAPTIVE = (
    *ADAPT,
    "a6 AS (SELECT *, CASE WHEN s = 1 THEN n - test ELSE mt + ((n - test - mt) * (fold + 1)) // s END AS train_hi FROM a5)",
    "a7 AS (SELECT asset, n, mt, fold, CAST(0 AS BIGINT) AS train_lo, train_hi, train_hi AS test_lo, least(train_hi + test, n) AS test_hi FROM a6)",
    f"adaptive AS (SELECT {FOLD_COLS} FROM a7 WHERE test_hi <= n AND train_hi - train_lo >= mt AND test_hi - test_lo >= 20)",
)


@query("splits_expanding", with_sql(*EXPANDING, select=f"SELECT {FOLD_COLS} FROM adaptive"))
def splits_expanding(spark, sf):
    return X.walk_forward_splits(sizes(spark, sf), CFG)


@query("splits_rolling", with_sql(*ROLLING, select=f"SELECT {FOLD_COLS} FROM adaptive"))
def splits_rolling(spark, sf):
    return X.walk_forward_splits(sizes(spark, sf), SplitSettings(expanding=False))


@query("splits_adaptive", with_sql(*ADAPTIVE, select=f"SELECT {FOLD_COLS} FROM adaptive"))
def splits_adaptive(spark, sf):
    return X.walk_forward_splits(sizes(spark, sf), SplitSettings(strategy="adaptive", gap=0))


@query("split_validity", with_sql(*PREDS[:3], SIZES,
    select="SELECT f.asset, fold, train_lo, train_hi, test_lo, test_hi + fold AS test_hi FROM folds f JOIN sizes s USING (asset) WHERE test_hi + fold <= s.n AND test_hi + fold - test_lo >= 65"))
def split_validity(spark, sf):
    longer = sliding_folds(spark, sf).withColumn("test_hi", F.col("test_hi") + F.col("fold")).join(sizes(spark, sf), "asset")
    return X.valid_splits(longer, 60, 65).drop("n")


@query("time_series_split", with_sql(SIZES, "k AS (SELECT asset, n, n // 6 AS t, unnest(range(0, 5)) AS fold FROM sizes)",
    select="SELECT asset, fold, CAST(0 AS BIGINT) AS train_lo, n - (5 - fold) * t AS train_hi, n - (5 - fold) * t AS test_lo, n - (5 - fold) * t + t AS test_hi FROM k"))
def time_series_split(spark, sf):
    return X.time_series_splits(sizes(spark, sf), 5)


@query("fold_range_join", with_sql(*PREDS, select=f"SELECT asset, fold, ts, rn, {rnd('y', 'y')} FROM test"))
def fold_range_join(spark, sf):
    from tideline.operators.align import range_join

    rows = forecast_rows(spark, sf).filter(F.col("y").isNotNull()).select("asset", "ts", "rn", "y")
    out = range_join(rows, sliding_folds(spark, sf).select("asset", "fold", "test_lo", "test_hi"), ["asset"], "rn", "test_lo", "test_hi", 64)
    return shown(out, {"y": 6}, ("asset", "fold", "ts", "rn"))


@query("fold_frames", with_sql(*PREDS, FRAMES, select=f"SELECT asset, fold, role, ts, {rnd('y', 'y')}, {rnd('last', 'last')} FROM frames"))
def fold_frames(spark, sf):
    return shown(frames(spark, sf), {"y": 6, "last": 6}, ("asset", "fold", "role", "ts"))


@query("fold_index_table", with_sql(*PREDS, FRAMES, select="""SELECT asset, fold, min(ts) FILTER (WHERE role = 'train') AS train_start, max(ts) FILTER (WHERE role = 'train') AS train_end,
  count(*) FILTER (WHERE role = 'train') AS train_size, min(ts) FILTER (WHERE role = 'test') AS test_start, max(ts) FILTER (WHERE role = 'test') AS test_end,
  count(*) FILTER (WHERE role = 'test') AS test_size FROM frames GROUP BY asset, fold"""))
def fold_index_table(spark, sf):
    return X.fold_index(frames(spark, sf))


FOLD_STATS = """st AS (SELECT asset, fold, avg(last) FILTER (WHERE role = 'train') AS ma, stddev_pop(last) FILTER (WHERE role = 'train') AS sa,
  avg(mean60) FILTER (WHERE role = 'train') AS mb, stddev_pop(mean60) FILTER (WHERE role = 'train') AS sb FROM frames GROUP BY 1, 2)"""


@query("fold_scale", with_sql(*PREDS, FRAMES, FOLD_STATS, select=f"SELECT asset, fold, role, ts, {rnd('(last - ma) / sa', 'last')}, {rnd('(mean60 - mb) / sb', 'mean60', 5)} FROM frames JOIN st USING (asset, fold)"))
def fold_scale(spark, sf):
    return shown(X.scale_folds(frames(spark, sf), ["last", "mean60"]), {"last": 6, "mean60": 5}, ("asset", "fold", "role", "ts"))


_POS = range(1, 11)


@query("seq_scale", with_sql(*PREDS[:3],
    f"s AS (SELECT asset, ts, rn, " + ", ".join(f"lag(close, {11 - i}) OVER ({W}) AS x{i}" for i in _POS) + " FROM r)",
    "fr AS (SELECT s.*, fold, CASE WHEN s.rn < train_hi THEN 'train' ELSE 'test' END AS role FROM s JOIN folds f ON f.asset = s.asset AND s.rn >= train_lo AND s.rn < test_hi WHERE x1 IS NOT NULL)",
    "st AS (SELECT asset, fold, " + ", ".join(f"avg(x{i}) FILTER (WHERE role = 'train') AS m{i}, stddev_pop(x{i}) FILTER (WHERE role = 'train') AS d{i}" for i in _POS) + " FROM fr GROUP BY 1, 2)",
    select=f"SELECT asset, fold, role, ts, {rnd('(x1 - m1) / d1', 'first', 5)}, {rnd('(x10 - m10) / d10', 'final', 5)}, "
    + rnd(" + ".join(f"(x{i} - m{i}) / d{i}" for i in _POS), "total", 5) + " FROM fr JOIN st USING (asset, fold)"))
def seq_scale(spark, sf):
    from tideline.operators.features import sequences

    rows = sequences(priority_bars(spark, sf), 10).select("asset", "ts", "rn", "x_seq")
    out = X.scale_sequences(X.fold_frames(rows, sliding_folds(spark, sf)), "x_seq", 10)
    return out.select(
        "asset", "fold", "role", "ts",
        rounded(F.element_at("x_flat", 1), 5).alias("first"),
        rounded(F.element_at("x_flat", 10), 5).alias("final"),
        rounded(F.aggregate("x_flat", F.lit(0.0), lambda a, v: a + v), 5).alias("total"),
    )


@query("scaler_fit_transform", with_sql(
    "st AS (SELECT asset, avg(close) AS m, stddev_pop(close) AS d, avg(volume) AS mv, stddev_pop(volume) AS dv FROM r GROUP BY asset)",
    select=f"SELECT asset, ts, {rnd('(close - m) / d', 'close')}, {rnd('(volume - mv) / dv', 'volume')} FROM r JOIN st USING (asset)"))
def scaler_fit_transform(spark, sf):
    bars = priority_bars(spark, sf).select("asset", "ts", "close", F.col("volume").cast("double").alias("volume"))
    out = C.apply_scaler(bars, C.fit_scaler(bars, ["close", "volume"]), ["close", "volume"])
    return shown(out, {"close": 6, "volume": 6})


@query("finite_filter", with_sql(*PREDS, FRAMES, select="SELECT asset, fold, role, ts FROM frames WHERE y IS NOT NULL AND dayofmonth(ts) <> 13"))
def finite_filter(spark, sf):
    y = F.when(F.dayofmonth("ts") == 13, F.lit(float("-inf"))).otherwise(F.col("y"))
    return X.finite_targets(frames(spark, sf).withColumn("y", y)).select("asset", "fold", "role", "ts")


@query("infer_task", with_sql(VOL5, TARGET,
    "q AS (SELECT asset, quantile_cont(vol5, 0.33) AS q33, quantile_cont(vol5, 0.67) AS q67 FROM v GROUP BY asset)",
    "l AS (SELECT asset, 'y' AS target, y AS v FROM t UNION ALL SELECT asset, 'label', CASE WHEN y <= q33 THEN 0 WHEN y <= q67 THEN 1 WHEN y IS NOT NULL THEN 2 END FROM t JOIN q USING (asset))",
    select="SELECT asset, target, CASE WHEN count(DISTINCT v) <= 10 THEN 'classification' ELSE 'regression' END AS task FROM l GROUP BY 1, 2"))
def infer_task(spark, sf):
    df = quantile_labels(features(priority_bars(spark, sf), ["targets"]), "target_vol5", "vol5")
    long = C.unpivot(df.withColumnRenamed("target_vol5", "y"), ["asset"], ["y", "label"], "target", "v")
    return X.infer_task(long, "v", ["asset", "target"])


@query("log_y_fold", with_sql(*PREDS, FRAMES,
    "f2 AS (SELECT asset, fold, role, ts, CASE WHEN fold % 2 = 0 THEN y ELSE y - 10 END AS y FROM frames WHERE y IS NOT NULL)",
    "mn AS (SELECT asset, fold, coalesce(min(y) FILTER (WHERE role = 'train') > 0, FALSE) AS logged FROM f2 GROUP BY 1, 2)",
    select=f"SELECT asset, fold, role, ts, logged, {rnd('CASE WHEN logged THEN CASE WHEN y + 1e-8 > 0 THEN ln(y + 1e-8) END ELSE y END', 'y')} FROM f2 JOIN mn USING (asset, fold)"))
def log_y_fold(spark, sf):
    df = frames(spark, sf).filter(F.col("y").isNotNull())
    df = df.withColumn("y", F.when(F.col("fold") % 2 == 0, F.col("y")).otherwise(F.col("y") - 10))
    return shown(X.log_targets(df), {"y": 6}, ("asset", "fold", "role", "ts", "logged"))


@query("drop_bad_folds", with_sql(*PREDS,
    "b AS (SELECT *, CASE WHEN fold % 7 = 3 AND dayofmonth(ts) = 1 THEN NULL WHEN fold % 7 = 5 AND dayofmonth(ts) = 2 THEN CAST('inf' AS DOUBLE) ELSE y_pred END AS p FROM preds)",
    select=f"SELECT asset, model, fold, ts, {rnd('p', 'y_pred')} FROM b WHERE (asset, model, fold) NOT IN (SELECT asset, model, fold FROM b WHERE p IS NULL OR isinf(p))"))
def drop_bad_folds(spark, sf):
    d = F.dayofmonth("ts")
    bad = F.when((F.col("fold") % 7 == 3) & (d == 1), F.lit(None)).when((F.col("fold") % 7 == 5) & (d == 2), F.lit(float("inf"))).otherwise(F.col("y_pred"))
    return shown(X.drop_bad_folds(predictions_reg(spark, sf).withColumn("y_pred", bad)), {"y_pred": 6}, ("asset", "model", "fold", "ts"))


_INFO = """SELECT asset, count(*) AS n_splits, min(train_hi - train_lo) AS train_min, max(train_hi - train_lo) AS train_max, round(avg(train_hi - train_lo), 6) AS train_mean,
  round(stddev_pop(train_hi - train_lo), 6) AS train_std, min(test_hi - test_lo) AS test_min, max(test_hi - test_lo) AS test_max, round(avg(test_hi - test_lo), 6) AS test_mean,
  round(stddev_pop(test_hi - test_lo), 6) AS test_std, CAST(sum(train_hi - train_lo + test_hi - test_lo) AS BIGINT) AS total_samples FROM adaptive GROUP BY asset"""
_INFO_KEEP = ("asset", "n_splits", "train_min", "train_max", "test_min", "test_max", "total_samples")
_INFO_ROUND = {c: 6 for c in ("train_mean", "train_std", "test_mean", "test_std")}


@query("split_info", with_sql(*EXPANDING, select=_INFO))
def split_info(spark, sf):
    return shown(X.split_info(X.walk_forward_splits(sizes(spark, sf), CFG)), _INFO_ROUND, _INFO_KEEP)


@query("fold_overlap", with_sql(*EXPANDING,
    """ov AS (SELECT a.asset, greatest(0, least(a.train_hi, b.train_hi) - greatest(a.train_lo, b.train_lo)) / (a.train_hi - a.train_lo) AS tr,
       greatest(0, least(a.test_hi, b.test_hi) - greatest(a.test_lo, b.test_lo)) / (a.test_hi - a.test_lo) AS te
       FROM adaptive a JOIN adaptive b ON a.asset = b.asset AND b.fold = a.fold + 1)""",
    select=f"""SELECT asset, {rnd('min(tr)', 'train_overlap_min')}, {rnd('max(tr)', 'train_overlap_max')}, {rnd('avg(tr)', 'train_overlap_mean')},
  {rnd('min(te)', 'test_overlap_min')}, {rnd('max(te)', 'test_overlap_max')}, {rnd('avg(te)', 'test_overlap_mean')} FROM ov GROUP BY asset"""))
def fold_overlap(spark, sf):
    out = X.fold_overlap(X.walk_forward_splits(sizes(spark, sf), CFG))
    return shown(out, {c: 6 for c in out.columns if c != "asset"}, ("asset",))


@query("validation_summary", with_sql(*EXPANDING, VOL5, TARGET,
    f"info AS ({_INFO})",
    "qual AS (SELECT asset, count(*) FILTER (WHERE y IS NULL) AS missing, count(*) FILTER (WHERE isinf(y)) AS infinite FROM t GROUP BY asset)",
    select="SELECT asset, n_splits, total_samples, missing, infinite, infinite = 0 AND n_splits > 0 AS is_valid FROM info JOIN qual USING (asset)"))
def validation_summary(spark, sf):
    from tideline.plans.validation import validation_summary as summarise

    rows = features(priority_bars(spark, sf), ["targets"]).withColumnRenamed("target_vol5", "y")
    return summarise(rows, X.walk_forward_splits(sizes(spark, sf), CFG), ["y"]).select("asset", "n_splits", "total_samples", "missing", "infinite", "is_valid")
