"""Model jobs on the priority bars (checked by rows and invariants in tests)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.config import SplitSettings, WindowSettings
from tideline.functions.layout import with_position
from tideline.functions.safe import finite
from tideline.models import contributions, linear, mixture, trees
from tideline.operators import folds as X
from tideline.operators.align import returns
from tideline.operators.features import features
from tideline.operators.reports import market_of
from tideline.plans import evaluate, transfer
from workloads.fixtures import ASSETS, PREDS, US_ASSETS, W, forecast_rows, priority_bars, rnd, sliding_folds, with_sql
from workloads.registry import query
from workloads.windows import shown

NAMES = ("lag1", "lag5", "momentum_5", "momentum_10", "vol_cluster_5", "vol_cluster_10", "volatility_5d", "volatility_20d")
AU = tuple(a for a in ASSETS if a not in US_ASSETS)


def model_rows(spark, sf):
    """(asset, ts, rn, n, ret, y, up, three, features) without gaps, renumbered."""
    df = features(priority_bars(spark, sf), ["lagged", "performance", "statistical", "targets", "simple_targets", "cached"])
    three = F.when(F.col("momentum_5") < -0.2, 0).when(F.col("momentum_5") > 0.2, 2).otherwise(1).alias("three")
    rows = df.select("asset", "ts", F.col("log_returns").alias("ret"), F.col("target_vol5").alias("y"), F.col("up_5").alias("up"), three, *NAMES).na.drop()
    return with_position(rows).persist()  # every job reads it several times


#: Test blocks small enough that the short series of the smallest tables have folds too.
SPLITS = SplitSettings(test_size=42)


def folds_of(rows):
    return X.walk_forward_splits(X.lengths(rows), SPLITS)


# Rows without gaps: the longest look-back is a 20-row volatility of returns shifted by its window and the separation
# (at least 10 values), the target looks five rows ahead.
FIRST, LAST = 60, 5
MODEL_ROWS = (
    f"mr AS (SELECT asset, ts, rn - {FIRST} AS rn, n - {FIRST + LAST} AS n FROM r WHERE rn >= {FIRST} AND rn < n - {LAST})",
    "mn AS (SELECT DISTINCT asset, n, least(5, greatest(0, (n - 5 - 60) // 42)) AS s FROM mr)",
    "mf AS (SELECT asset, unnest(range(0, s)) AS fold FROM mn)",
)


def per_fold(preds, *tests, keys=("asset", "fold")):
    """Predictions per fold, whether all are finite, and whether the tests hold for all rows."""
    ok = [F.bool_and(F.coalesce(t, F.lit(False))).alias(n) for n, t in (("finite", finite("y_pred").isNotNull()), *tests)]
    return preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("predictions"), *ok)


def counted(*flags, extra="", join=""):
    return with_sql(*MODEL_ROWS, select=f"SELECT {extra} asset, fold, 42 AS predictions, TRUE AS finite{''.join(f', TRUE AS {f}' for f in flags)} FROM mf {join}")


_TASKS = "(VALUES ('regression'), ('classification'), ('three classes')) AS k(task)"


@query("fit_gbt", counted("usable", extra="task,", join=f", {_TASKS}"))
def fit_gbt(spark, sf):
    """Boosted trees on the target, the two-class and the three-class label; all configured folds and default rounds."""
    rows = model_rows(spark, sf)
    folds = folds_of(rows)
    jobs = (("regression", "y", 0, F.col("y_pred") > 0), ("classification", "up", 2, F.col("y_pred").isin(0, 1)), ("three classes", "three", 3, F.col("y_pred").isin(0, 1, 2)))
    parts = []
    for task, target, classes, usable in jobs:
        preds = trees.tree_folds(rows, folds, NAMES, target, "gbt", "classification" if classes else "regression", classes)
        parts.append(per_fold(preds, ("usable", usable)).withColumn("task", F.lit(task)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fit_forest", counted("inside"))
def fit_forest(spark, sf):
    """A forest's predictions are means of train targets, so none is outside their range."""
    rows = model_rows(spark, sf)
    preds = trees.tree_folds(rows, folds_of(rows), NAMES, "y", "forest", "regression")
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    return per_fold(preds, ("inside", F.col("y_pred").between(low, high)))


@query("fit_arx", counted("ordered"))
def fit_arx(spark, sf):
    """All features on the target as it is."""
    rows = model_rows(spark, sf)
    out = linear.arx_folds(rows, folds_of(rows), NAMES)
    return per_fold(out, ("ordered", (F.col("lower") <= F.col("y_pred")) & (F.col("y_pred") <= F.col("upper"))))


@query("arx_differenced", counted("ordered"))
def arx_differenced(spark, sf):
    """As ``fit_arx``; folds whose train rows show a unit root are differenced."""
    rows = model_rows(spark, sf)
    out = linear.arx_folds(rows, folds_of(rows), NAMES, d="auto")
    return per_fold(out, ("ordered", (F.col("lower") <= F.col("y_pred")) & (F.col("y_pred") <= F.col("upper"))))


AR_ROWS = (
    *PREDS[:2],
    "ar AS (SELECT asset, ts, rn, y, lag(y) OVER (PARTITION BY asset ORDER BY ts) AS lag1 FROM py WHERE y IS NOT NULL)",
    "af AS (SELECT a.*, f.fold, rn >= test_lo AS test, row_number() OVER (PARTITION BY a.asset, f.fold, rn >= test_lo ORDER BY ts) AS h FROM ar a JOIN folds f ON f.asset = a.asset AND rn >= train_lo AND rn < test_hi WHERE lag1 IS NOT NULL)",
    "am AS (SELECT asset, fold, regr_slope(y, lag1) AS phi, regr_intercept(y, lag1) AS base FROM af WHERE NOT test GROUP BY 1, 2)",
    "st AS (SELECT asset, fold, lag1 AS state FROM af WHERE test AND h = 1)",
)


@query("ar1_folds", with_sql(*PREDS[:3], *AR_ROWS[2:],
    select=f"SELECT asset, fold, ts, {rnd('base * (1 - phi ** h) / (1 - phi) + phi ** h * state', 'y_pred', 5)} FROM af JOIN am USING (asset, fold) JOIN st USING (asset, fold) WHERE test"))
def ar1_folds(spark, sf):
    """Autoregression of order one without other columns, forecast step by step through each test block."""
    rows = forecast_rows(spark, sf).select("asset", "ts", "rn", "y")
    return shown(linear.arx_folds(rows, sliding_folds(spark, sf), (), orders=(1,)), {"y_pred": 5}, ("asset", "fold", "ts"))


@query("linear_folds", with_sql(*PREDS[:3],
    "tr AS (SELECT p.asset, fold, regr_slope(y, last) AS b, regr_intercept(y, last) AS a FROM py p JOIN folds f ON f.asset = p.asset AND rn >= train_lo AND rn < train_hi WHERE y IS NOT NULL AND last IS NOT NULL GROUP BY 1, 2)",
    "te AS (SELECT p.asset, fold, ts, y, last FROM py p JOIN folds f ON f.asset = p.asset AND rn >= test_lo AND rn < test_hi WHERE y IS NOT NULL AND last IS NOT NULL)",
    select=f"SELECT asset, fold, ts, {rnd('y', 'y_true', 5)}, {rnd('a + b * last', 'y_pred', 5)} FROM te JOIN tr USING (asset, fold)"))
def linear_folds(spark, sf):
    """Walk-forward least squares on one feature."""
    rows = forecast_rows(spark, sf).select("asset", "ts", "rn", "y", "last")
    return shown(linear.linear_folds(rows, sliding_folds(spark, sf), ["last"]), {"y_true": 5, "y_pred": 5}, ("asset", "fold", "ts"))


@query("forecast_interval", counted("ordered", "wider"))
def forecast_interval(spark, sf):
    """Forecasts of a differenced target; the interval holds the forecast and never narrows with the horizon."""
    rows = model_rows(spark, sf)
    out = linear.arx_folds(rows, folds_of(rows), (), d=1, confidence=0.90)
    before = F.lag("std", 1).over(Window.partitionBy("asset", "fold").orderBy("ts"))  # a test block
    out = out.withColumn("_wider", before.isNull() | (F.col("std") >= before * (1 - 1e-9)))
    return per_fold(out, ("ordered", (F.col("lower") <= F.col("y_pred")) & (F.col("y_pred") <= F.col("upper"))), ("wider", F.col("_wider")))


@query("regime_mixture", with_sql(
    f"m AS (SELECT *, CASE WHEN asset IN ('1-URGENT', '2-HIGH') THEN 'US' ELSE 'AU' END AS market FROM r WHERE ret IS NOT NULL)",
    select="SELECT market, count(*) AS rows, TRUE AS certain, TRUE AS ordered FROM m GROUP BY market"))
def regime_mixture(spark, sf):
    """Rows per market; certainty of the chosen of three states is at least a third; Bear's mean return is below Bull's."""
    rets = returns(priority_bars(spark, sf)).withColumn("market", market_of("asset", US_ASSETS)).persist()
    out = mixture.mixture_regimes(rets, ["US", "AU"])
    mean = lambda r: F.avg(F.when(F.col("regime") == r, F.col("ret")))
    return out.groupBy("market").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("certainty") > 0.33).alias("certain"), F.coalesce(mean("Bear") < mean("Bull"), F.lit(True)).alias("ordered"))


_MODELS = ("naive", "linear", "arx", "garch", "gbt", "forest")


@query("fit_predict_folds", counted(extra="model,", join=", (VALUES " + ", ".join(f"('{m}')" for m in _MODELS) + ") AS k(model)"))
def fit_predict_folds(spark, sf):
    """Every model on every fold."""
    rows = model_rows(spark, sf)
    return per_fold(evaluate.fit_predict_folds(rows, folds_of(rows), NAMES, _MODELS), keys=("asset", "model", "fold"))


_CLASSIFIERS = ("last", "gbt", "forest", "arx", "garch")


@query("fit_predict_classes", counted("label", extra="model,", join=", (VALUES " + ", ".join(f"('{m}')" for m in _CLASSIFIERS) + ") AS k(model)"))
def fit_predict_classes(spark, sf):
    """Every classifier on every fold of the three-class label."""
    rows = model_rows(spark, sf)
    preds = evaluate.fit_predict_folds(rows, folds_of(rows), NAMES, _CLASSIFIERS, task="classification", target="three")
    return per_fold(preds, ("label", F.col("y_pred").isin(0, 1, 2)), keys=("asset", "model", "fold"))


# Windows of one row: the regressor is the close before. Ridge divides the slope by 1.1.
_UNIFORM = (
    f"ub AS (SELECT asset, rn, lag(close) OVER ({W}) AS x, lead(close) OVER ({W}) / close - 1 AS y, n FROM r)",
    "uf AS (SELECT asset, unnest(range(0, CASE WHEN n >= 260 THEN (n - 260) // 60 + 1 ELSE 0 END)) AS fold FROM (SELECT DISTINCT asset, n FROM r))",
    "ut AS (SELECT u.asset, fold, rn >= fold * 60 + 200 AS test, x, y FROM ub u JOIN uf f ON f.asset = u.asset AND rn >= fold * 60 AND rn < fold * 60 + 260 WHERE x IS NOT NULL AND y IS NOT NULL)",
    "um AS (SELECT asset, fold, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my FROM ut WHERE NOT test GROUP BY 1, 2)",
    "up AS (SELECT asset, fold, model, y, my + b / k * (x - mx) AS p FROM ut JOIN um USING (asset, fold), (VALUES ('linear', 1.0), ('ridge', 1.1)) AS m(model, k) WHERE test)",
    "ue AS (SELECT asset, fold, model, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae FROM up GROUP BY ALL)",
)


@query("uniform_eval", with_sql(*_UNIFORM, select=f"SELECT model, {rnd('avg(mse)', 'mse_mean', 5)}, {rnd('avg(mae)', 'mae_mean', 5)}, {rnd('stddev_samp(mse)', 'mse_std', 5)}, {rnd('stddev_samp(mae)', 'mae_std', 5)} FROM ue GROUP BY model"))
def uniform_eval(spark, sf):
    """Linear and ridge regression on the same folds and windows."""
    bars = priority_bars(spark, sf)
    targets = features(bars, ["targets"]).select("asset", "ts", F.col("next_return").alias("y"))
    out = evaluate.uniform_eval(bars, targets, WindowSettings(lookback=1))
    return shown(out, dict.fromkeys(("mse_mean", "mae_mean", "mse_std", "mae_std"), 5), ("model",))


_UNIFORM_MODELS = ("naive", "linear", "ridge", "gbt", "forest")


@query("uniform_all", "SELECT model, TRUE AS usable FROM (VALUES " + ", ".join(f"('{m}')" for m in _UNIFORM_MODELS) + ") AS k(model)")
def uniform_all(spark, sf):
    """All models that predict from frames, on windows of ten rows."""
    bars = priority_bars(spark, sf)
    targets = features(bars, ["targets"]).select("asset", "ts", F.col("next_return").alias("y"))
    out = evaluate.uniform_eval(bars, targets, models=_UNIFORM_MODELS)
    return out.select("model", ((F.col("mse_mean") > 0) & F.col("mae_mean").between(0, F.sqrt("mse_mean"))).alias("usable"))


def _single(spark, sf):
    return forecast_rows(spark, sf).filter(F.col("y").isNotNull() & F.col("last").isNotNull())


_SINGLE = (*PREDS[:2], "one AS (SELECT asset, y, last FROM py WHERE y IS NOT NULL AND last IS NOT NULL)")
_ERRORS = f"{rnd('avg((y - a - b * last) ** 2)', 'mse', 5)}, {rnd('avg(abs(y - a - b * last))', 'mae', 5)}, {rnd('1 - avg((y - a - b * last) ** 2) / var_pop(y)', 'r2', 4)}"


@query("transfer_pool", with_sql(*_SINGLE, f"m AS (SELECT regr_slope(y, last) AS b, regr_intercept(y, last) AS a FROM one WHERE asset IN {US_ASSETS})",
    select=f"SELECT asset, '{','.join(US_ASSETS)}' AS sources, count(*) AS test_size, {_ERRORS} FROM one, m WHERE asset NOT IN {US_ASSETS} GROUP BY asset"))
def transfer_pool(spark, sf):
    out = transfer.transfer_pool(_single(spark, sf), ["last"], "y", US_ASSETS, AU)
    return shown(out, {"mse": 5, "mae": 5, "r2": 4}, ("asset", "sources", "test_size"))


@query("transfer_matrix", with_sql(*_SINGLE, "m AS (SELECT asset AS source, regr_slope(y, last) AS b, regr_intercept(y, last) AS a FROM one GROUP BY asset)",
    select=f"SELECT source, asset AS target, 'linear' AS model, 'regression' AS task, count(*) AS n, {_ERRORS} FROM one, m GROUP BY source, asset"))
def transfer_matrix(spark, sf):
    out = transfer.transfer_matrix(_single(spark, sf), ["last"], "y", ASSETS)
    return shown(out, {"mse": 5, "mae": 5, "r2": 4}, ("source", "target", "model", "task", "n"))


_SETS = ", ".join(f"('maxDepth={d}, stepSize={s}')" for d in (2, 3) for s in (0.1, 0.3))


@query("grid_search", f"SELECT params, 3 AS folds, TRUE AS finite, 1 AS best FROM (VALUES {_SETS}) AS k(params)")
def grid_search(spark, sf):
    """Every parameter set over three expanding folds; exactly one set is the best."""
    rows = model_rows(spark, sf)
    out = trees.grid_search(rows, X.time_series_splits(X.lengths(rows), 3), NAMES, "y", {"maxDepth": [2, 3], "stepSize": [0.1, 0.3]})
    best = out.agg(F.count_if("is_best").alias("n")).scalar()
    return out.select("params", "folds", finite("rmse_mean").isNotNull().alias("finite"), best.alias("best"))


_HALVING = {"maxDepth": [2, 4], "stepSize": [0.1, 0.3], "maxIter": [4, 8], "subsamplingRate": [0.7, 1.0], "featureSubsetStrategy": ["all", "onethird"]}


@query("halving_search", "SELECT 32 AS sets, 1 AS winners, 32 AS first_round, TRUE AS finite, TRUE AS narrowing")
def halving_search(spark, sf):
    """Five parameters of two values each by successive halving: every set has a score, and each round keeps a third."""
    rows = model_rows(spark, sf)
    out = trees.halving_search(rows, X.time_series_splits(X.lengths(rows), 3), NAMES, "y", _HALVING)
    later = F.count_if(F.col("folds") > 1)
    return out.agg(
        F.count(F.lit(1)).alias("sets"), F.count_if(F.col("rank") == 1).alias("winners"), F.count_if(F.col("folds") >= 1).alias("first_round"),
        F.bool_and(finite("score").isNotNull()).alias("finite"), (later == 10).alias("narrowing"))


@query("perm_importance", with_sql(*MODEL_ROWS, "ho AS (SELECT CAST(sum(n - CAST(floor(n * 0.7) AS BIGINT)) AS BIGINT) AS rows FROM mn)",
    select="SELECT feature, rows, TRUE AS finite FROM ho, (VALUES " + ", ".join(f"('{f}')" for f in NAMES) + ") AS k(feature)"))
def perm_importance(spark, sf):
    """Importances of each feature on the later rows of every asset, by a model fitted on the earlier ones."""
    rows = model_rows(spark, sf)
    start = F.floor(F.col("n") * 0.7)
    model = trees.fit(rows.filter(F.col("rn") < start), NAMES, "y", "gbt", "regression")
    held = rows.filter(F.col("rn") >= start).withColumns({"rn": F.col("rn") - start, "n": F.col("n") - start})
    split = trees.feature_importances(model, spark, NAMES)
    out = trees.permutation_importance(model, held, NAMES, "y").join(split, "feature")
    size = held.agg(F.count(F.lit(1)).alias("k")).scalar()
    ok = finite("rmse_increase").isNotNull() & finite("rmse").isNotNull() & F.col("importance").between(0, 1)
    return out.select("feature", size.alias("rows"), ok.alias("finite"))


@query("tree_contributions", with_sql(*MODEL_ROWS, select="SELECT asset, feature, count(*) AS rows, TRUE AS additive, TRUE AS used FROM mr, (VALUES "
    + ", ".join(f"('{f}')" for f in NAMES) + ") AS k(feature) GROUP BY ALL"))
def tree_contributions(spark, sf):
    """Contributions of each feature to boosted trees' predictions: they and the base add up to the prediction."""
    rows = model_rows(spark, sf)
    model = trees.fit(rows, NAMES, "y", "gbt", "regression")
    long = contributions.tree_contributions(model, rows, NAMES, ["asset", "ts"])
    keys = ["asset", "ts"]
    sums = long.groupBy(*keys).agg((F.sum("contribution") + F.max("base")).alias("total"))
    scored = trees.predict(model, rows, NAMES, "y").select(*keys, "y_pred")
    fits = sums.join(scored, keys).select(*keys, (F.abs(F.col("total") - F.col("y_pred")) < 1e-9).alias("fits"))
    return long.join(fits, keys).groupBy("asset", "feature").agg(F.count(F.lit(1)).alias("rows"), F.bool_and("fits").alias("additive"), F.max(F.abs("contribution")).alias("_most")).withColumn(
        "used", F.max("_most").over(Window.partitionBy("feature")) > 0).drop("_most")
