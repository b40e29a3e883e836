"""Result-table queries: unions, rankings, pivots, summaries and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.safe import rounded
from tideline.models.linear import fit_linear
from tideline.operators import ensemble as E
from tideline.operators import metrics as M
from tideline.operators import reports as R
from tideline.session import shared_folder
from tideline.sources.store import ResultStore
from workloads.fixtures import ASSETS, FOLD_METRICS_SQL, PREDS, US_ASSETS, predictions_reg, prediction_ctes, rnd, with_sql
from workloads.metrics import conf_sql
from workloads.registry import query
from workloads.windows import shown

REG = ("mse", "rmse", "mae", "r2")
CLF = ("accuracy", "f1", "precision", "recall")
LEVEL = 9.0


def class_predictions(spark, sf):
    preds = predictions_reg(spark, sf)
    return preds.withColumns({c: (F.col(c) >= LEVEL).cast("int") for c in ("y_true", "y_pred")})


def results(spark, sf):
    """(asset, model, task, metrics and deviations) of both tasks in one table."""
    reg = M.fold_summary(M.regression_metrics(predictions_reg(spark, sf)), REG).withColumn("task", F.lit("regression"))
    clf = M.fold_summary(M.classification_metrics(class_predictions(spark, sf)), CLF).withColumn("task", F.lit("classification"))
    return reg.unionByName(clf, allowMissingColumns=True)


def _summ(cols, src):
    return ", ".join(f"avg({c}) AS {c}, stddev_samp({c}) AS {c}_std" for c in cols)


RES = (
    *PREDS, FOLD_METRICS_SQL,
    f"cp AS (SELECT asset, model, fold, CASE WHEN y_true >= {LEVEL} THEN 1 ELSE 0 END AS y_true, CASE WHEN y_pred >= {LEVEL} THEN 1 ELSE 0 END AS y_pred FROM preds)",
    *conf_sql("cp", "asset, model, fold"),
    f"results AS (SELECT asset, model, 'regression' AS task, count(*) AS n_splits, {_summ(REG, 'fm')} FROM fm GROUP BY asset, model UNION ALL BY NAME "
    f"SELECT asset, model, 'classification' AS task, count(*) AS n_splits, {_summ(CLF, 'sc')} FROM sc GROUP BY asset, model)",
)
_ALL = [c + s for c in (*REG, *CLF) for s in ("", "_std")]


@query("results_union", with_sql(*RES, select="SELECT asset, model, task, n_splits, " + ", ".join(rnd(c, c) for c in _ALL) + " FROM results"))
def results_union(spark, sf):
    return shown(results(spark, sf), {c: 6 for c in _ALL}, ("asset", "model", "task", "n_splits"))


@query("task_filter", with_sql(*RES, select=f"SELECT asset, model, {rnd('rmse', 'rmse')} FROM results WHERE task = 'regression'"))
def task_filter(spark, sf):
    return shown(results(spark, sf).filter(F.col("task") == "regression"), {"rmse": 6}, ("asset", "model"))


@query("metric_aliases", with_sql(*RES, select=f"SELECT asset, model, {rnd('mse', 'mse')}, {rnd('r2', 'r2')} FROM results WHERE task = 'regression'"))
def metric_aliases(spark, sf):
    df = results(spark, sf).filter(F.col("task") == "regression")
    last = F.col("model") == "last"
    mixed = df.select(
        "asset", "model", F.when(last, F.col("mse")).alias("MSE_upper"), F.when(~last, F.col("mse")).alias("mean_squared_error"), F.col("r2").alias("r2_score")
    )
    out = R.unify_metrics(mixed, {"mse": ["mse", "MSE_upper", "mean_squared_error"], "r2": ["R2", "r2", "r2_score"]})
    return shown(out, {"mse": 6, "r2": 6}, ("asset", "model"))


@query("inf_metric_null", with_sql(*RES, select=f"SELECT asset, model, {rnd('CASE WHEN model = $$last$$ THEN NULL ELSE mse END', 'mse')} FROM results WHERE task = 'regression'"))
def inf_metric_null(spark, sf):
    df = results(spark, sf).filter(F.col("task") == "regression")
    df = df.withColumn("mse", F.when(F.col("model") == "last", F.lit(float("inf"))).otherwise(F.col("mse")))
    return R.infinite_to_null(df, ["mse"]).select("asset", "model", rounded("mse").alias("mse"))


@query("best_models", with_sql(*RES, select=f"SELECT asset, model, {rnd('r2', 'r2')} FROM results WHERE task = 'regression' ORDER BY r2 DESC"))
def best_models(spark, sf):
    return R.best_models(results(spark, sf), "regression", "r2").select("asset", "model", rounded("r2").alias("r2"))


@query("best_model", with_sql(*RES, select=f"""SELECT asset, task, metric, model, {rnd('v', 'value')} FROM (
  SELECT asset, task, 'mse' AS metric, arg_min(model, mse) AS model, min(mse) AS v FROM results WHERE mse IS NOT NULL GROUP BY ALL UNION ALL
  SELECT asset, task, 'f1', arg_max(model, f1), max(f1) FROM results WHERE f1 IS NOT NULL GROUP BY ALL)"""))
def best_model(spark, sf):
    df = results(spark, sf)
    parts = [R.best_model(df, m).select("asset", "task", F.lit(m).alias("metric"), "model", rounded(m).alias("value")) for m in ("mse", "f1")]
    return parts[0].unionByName(parts[1])


@query("model_ranking", with_sql(*RES, select=f"""SELECT 'model' AS kind, model AS name, {rnd('avg(rmse)', 'rmse')} FROM results GROUP BY model
  UNION ALL SELECT 'asset', asset, {rnd('avg(rmse)', 'rmse')} FROM results GROUP BY asset"""))
def model_ranking(spark, sf):
    df = results(spark, sf)
    parts = [R.ranking(df, by, "rmse").select(F.lit(by).alias("kind"), F.col(by).alias("name"), rounded("rmse").alias("rmse")) for by in ("model", "asset")]
    return parts[0].unionByName(parts[1])


_A = lambda a: f"a{a[0]}"


@query("pivot_model_asset", with_sql(*RES, select="SELECT model, " + ", ".join(rnd(f"avg(r2) FILTER (WHERE asset = '{a}')", _A(a)) for a in ASSETS) + " FROM results GROUP BY model"))
def pivot_model_asset(spark, sf):
    return shown(R.pivot_mean(results(spark, sf), "model", "asset", ASSETS, "r2", _A), {_A(a): 6 for a in ASSETS}, ("model",))


@query("pivot_asset_model", with_sql(*RES, select="SELECT asset, " + ", ".join(rnd(f"avg(r2) FILTER (WHERE model = '{m}')", m) for m in ("last", "mean60")) + " FROM results GROUP BY asset"))
def pivot_asset_model(spark, sf):
    return shown(R.pivot_mean(results(spark, sf), "asset", "model", ("last", "mean60"), "r2"), {"last": 6, "mean60": 6}, ("asset",))


@query("pivot_model_market", with_sql(*RES, "mk AS (SELECT *, CASE WHEN asset IN ('1-URGENT', '2-HIGH') THEN 'US' ELSE 'AU' END AS market FROM results)",
    select=f"""SELECT model, {rnd("avg(r2) FILTER (WHERE market = 'US')", 'us')}, {rnd("avg(r2) FILTER (WHERE market = 'AU')", 'au')},
  {rnd("avg(accuracy) FILTER (WHERE market = 'US')", 'us_accuracy')}, {rnd("avg(accuracy) FILTER (WHERE market = 'AU')", 'au_accuracy')} FROM mk GROUP BY model"""))
def pivot_model_market(spark, sf):
    df = results(spark, sf).withColumn("market", R.market_of("asset", US_ASSETS))
    r2 = R.pivot_mean(df, "model", "market", ("US", "AU"), "r2", str.lower)
    acc = R.pivot_mean(df, "model", "market", ("US", "AU"), "accuracy", lambda m: f"{m.lower()}_accuracy")
    return shown(r2.join(acc, "model"), {c: 6 for c in ("us", "au", "us_accuracy", "au_accuracy")}, ("model",))


_MEANS = (*REG, *CLF)


@query("model_means", with_sql(*RES, select=" UNION ALL ".join(f"SELECT '{by}' AS kind, {by} AS name, " + ", ".join(rnd(f"avg({c})", c) for c in _MEANS) + f" FROM results GROUP BY {by}" for by in ("model", "asset"))))
def model_means(spark, sf):
    df = results(spark, sf)
    parts = [shown(R.metric_means(df, by).withColumn("kind", F.lit(by)).withColumnRenamed(by, "name"), {c: 6 for c in _MEANS}, ("kind", "name")) for by in ("model", "asset")]
    return parts[0].unionByName(parts[1])


@query("model_consistency", with_sql(*RES, select=f"SELECT model, {rnd('avg(r2)', 'mean')}, {rnd('stddev_samp(r2)', 'std')} FROM results GROUP BY model"))
def model_consistency(spark, sf):
    return shown(R.consistency(results(spark, sf)), {"mean": 6, "std": 6}, ("model",))


PERF = (
    "lg AS (" + " UNION ALL ".join(f"SELECT task, model, asset, '{m}' AS metric, {m} AS value, {'' if m == 'mse' else '-'}{m} AS k FROM results WHERE {m} IS NOT NULL" for m in ("r2", "mse", "accuracy", "f1")) + ")",
    "ps AS (SELECT task, metric, arg_min(model, (k, model, asset)) AS best_model, arg_min(asset, (k, model, asset)) AS best_asset, arg_min(value, (k, model, asset)) AS best_value, avg(value) AS mean, stddev_samp(value) AS std, count(DISTINCT asset) AS assets, count(DISTINCT model) AS models FROM lg GROUP BY 1, 2)",
)


@query("perf_summary", with_sql(*RES, *PERF, select=f"SELECT task, metric, best_model, best_asset, {rnd('best_value', 'best_value')}, {rnd('mean', 'mean')}, {rnd('std', 'std')}, assets, models FROM ps"))
def perf_summary(spark, sf):
    out = R.performance_summary(results(spark, sf))
    return shown(out, {"best_value": 6, "mean": 6, "std": 6}, ("task", "metric", "best_model", "best_asset", "assets", "models"))


def _text_sql(c):
    from tideline.operators.reports import DIGITS

    text = f"printf('%.{DIGITS[c]}f ± %.{DIGITS[c]}f', coalesce({c}, 0), coalesce({c}_std, 0))"
    return f"CASE WHEN task {'=' if c in CLF else '<>'} 'classification' THEN {text} END AS {c}_text"


@query("comparison_table", with_sql(*RES, select="SELECT asset, model, task, " + ", ".join(_text_sql(c) for c in (*REG, *CLF)) + " FROM results"))
def comparison_table(spark, sf):
    return R.comparison_table(results(spark, sf))


@query("best_row", with_sql(*RES, select=f"""SELECT count(*) AS evaluations, count(DISTINCT asset) AS assets, count(DISTINCT model) AS models,
  arg_min(model, rmse) FILTER (WHERE task = 'regression') AS regression_model, arg_min(asset, rmse) FILTER (WHERE task = 'regression') AS regression_asset, {rnd("min(rmse) FILTER (WHERE task = 'regression')", 'regression_value')},
  arg_max(model, f1) FILTER (WHERE task = 'classification') AS classification_model, arg_max(asset, f1) FILTER (WHERE task = 'classification') AS classification_asset, {rnd("max(f1) FILTER (WHERE task = 'classification')", 'classification_value')} FROM results"""))
def best_row(spark, sf):
    out = R.best_rows(results(spark, sf))
    return shown(out, {"regression_value": 6, "classification_value": 6}, ("evaluations", "assets", "models", "regression_model", "regression_asset", "classification_model", "classification_asset"))


@query("key_findings", with_sql(*RES, *PERF, select=f"""SELECT task, best_model AS model, best_asset AS asset, metric, {rnd('best_value', 'value')}
  FROM ps WHERE (task = 'classification' AND metric = 'accuracy') OR (task <> 'classification' AND metric = 'r2')"""))
def key_findings(spark, sf):
    return shown(R.key_findings(R.performance_summary(results(spark, sf))), {"value": 6}, ("task", "model", "asset", "metric"))


@query("export_summary", with_sql(*RES, select="SELECT asset, count(*) AS models, string_agg(DISTINCT model, ',' ORDER BY model) AS model_types, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM results GROUP BY asset"))
def export_summary(spark, sf):
    return R.export_summary(results(spark, sf))


@query("store_summary", with_sql(*RES, select="SELECT count(DISTINCT asset) AS assets, count(DISTINCT (asset, model, task)) AS models, (SELECT count(DISTINCT (asset, model)) FROM preds) AS predictions, CAST(2 AS BIGINT) AS features FROM results"))
def store_summary(spark, sf):
    return R.store_summary(results(spark, sf), predictions_reg(spark, sf), ["last", "mean60"])


RUN_B = prediction_ctes(30, "b")
_FMB = FOLD_METRICS_SQL.replace("fm AS", "fmb AS").replace("FROM preds", "FROM predsb")


def run_metrics(spark, sf):
    runs = []
    for run_id, step in (("step60", 60), ("step30", 30)):
        m = M.regression_metrics(predictions_reg(spark, sf, step), ["asset", "model"])
        runs.append(m.select(F.lit(run_id).alias("run_id"), "asset", "model", F.lit("regression").alias("task"), "rmse", "mae", "r2"))
    return runs[0].unionByName(runs[1])


@query("compare_runs", with_sql(*PREDS, *RUN_B,
    "ra AS (SELECT asset, model, sqrt(avg((y_true - y_pred) ** 2)) AS rmse FROM preds GROUP BY 1, 2)", "rb AS (SELECT asset, model, sqrt(avg((y_true - y_pred) ** 2)) AS rmse FROM predsb GROUP BY 1, 2)",
    select=f"SELECT ra.asset, ra.model, 'regression' AS task, {rnd('ra.rmse', 'step60')}, {rnd('rb.rmse', 'step30')} FROM ra JOIN rb USING (asset, model)"))
def compare_runs(spark, sf):
    out = R.compare_runs(run_metrics(spark, sf), ["step60", "step30"], "rmse")
    return shown(out, {"step60": 6, "step30": 6}, ("asset", "model", "task"))


@query("saved_model_semi", with_sql(*RES, select="SELECT asset, model, task FROM results WHERE (asset, model) IN (SELECT asset, model FROM preds GROUP BY 1, 2 HAVING regr_slope(y_true, y_pred) > 0)"))
def saved_model_semi(spark, sf):
    """Results whose calibration, a line from forecast to outcome, was good enough to be saved."""
    fitted = fit_linear(predictions_reg(spark, sf), ["y_pred"], "y_true", ["asset", "model"])
    saved = ResultStore(spark, shared_folder(spark, "results"))
    saved.save("calibrations", fitted.filter(F.get("coefs", F.lit(0)) > 0), "run-a", by=())
    registry = saved.load("calibrations", "run-a").select("asset", "model")
    return results(spark, sf).select("asset", "model", "task").join(registry, ["asset", "model"], "left_semi")


# ---- ensembles ------------------------------------------------------------------------

ALIGNED = "al AS (SELECT asset, fold, ts, any_value(y_true) AS y_true, max(y_pred) FILTER (WHERE model = 'last') AS last, max(y_pred) FILTER (WHERE model = 'mean60') AS mean60 FROM preds GROUP BY 1, 2, 3)"


@query("ensemble_align", with_sql(*PREDS, ALIGNED, select=f"SELECT asset, fold, ts, {rnd('y_true', 'y_true')}, {rnd('last', 'last')}, {rnd('mean60', 'mean60')} FROM al"))
def ensemble_align(spark, sf):
    return shown(E.align_models(predictions_reg(spark, sf), ["last", "mean60"]), {c: 6 for c in ("y_true", "last", "mean60")}, ("asset", "fold", "ts"))


@query("ensemble_vote", with_sql(*PREDS, ALIGNED, "en AS (SELECT asset, y_true, (0.3 * last + 0.7 * mean60) AS y_pred FROM al WHERE last IS NOT NULL AND mean60 IS NOT NULL)",
    "vt AS (SELECT asset, 'any' AS g, CASE WHEN y_true >= 9 THEN 1 ELSE 0 END AS y_true, least(CASE WHEN last >= 9 THEN 1 ELSE 0 END, CASE WHEN mean60 >= 9 THEN 1 ELSE 0 END) AS y_pred FROM al)",
    *conf_sql("vt", "asset"),
    select=f"""SELECT en.asset, {rnd('avg((y_true - y_pred) ** 2)', 'mse')}, {rnd('avg(abs(y_true - y_pred))', 'mae')}, {rnd('1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*))', 'r2')},
  {rnd('any_value(accuracy)', 'accuracy')}, {rnd('any_value(f1)', 'f1')}, {rnd('any_value(balanced_accuracy)', 'balanced_accuracy')} FROM en JOIN sc USING (asset) GROUP BY en.asset"""))
def ensemble_vote(spark, sf):
    reg = M.regression_metrics(E.weighted_mean(predictions_reg(spark, sf), {"last": 0.3, "mean60": 0.7}), ["asset"])
    clf = M.classification_metrics(E.majority_vote(class_predictions(spark, sf)), ["asset"])
    both = reg.select("asset", "mse", "mae", "r2").join(clf.select("asset", "accuracy", "f1", "balanced_accuracy"), "asset")
    return shown(both, {c: 6 for c in both.columns if c != "asset"}, ("asset",))


# ---- transfer -------------------------------------------------------------------------

TRANSFER = (
    *PREDS[:2], "src AS (SELECT asset AS source, avg(y) AS m FROM py WHERE y IS NOT NULL GROUP BY asset)",
    "tf AS (SELECT source, asset AS target, avg((y - m) ** 2) AS mse, avg(abs(y - m)) AS mae, 1 - sum((y - m) ** 2) / (var_pop(y) * count(*)) AS r2 FROM py JOIN src ON TRUE WHERE y IS NOT NULL GROUP BY 1, 2)",
)


def mean_transfer(spark, sf):
    from workloads.fixtures import forecast_rows
    from tideline.plans.transfer import score_constants, source_means

    rows = forecast_rows(spark, sf).filter(F.col("y").isNotNull())
    return score_constants(rows, source_means(rows, "y", ASSETS), ASSETS, "y")


@query("source_target_cross", with_sql(*TRANSFER, select=f"SELECT source, target, 'mean' AS model, 'regression' AS task, {rnd('mse', 'mse')}, {rnd('mae', 'mae')}, {rnd('r2', 'r2', 5)} FROM tf"))
def source_target_cross(spark, sf):
    return shown(mean_transfer(spark, sf), {"mse": 6, "mae": 6, "r2": 5}, ("source", "target", "model", "task"))


@query("pivot_transfer", with_sql(*TRANSFER, select="SELECT source, " + ", ".join(rnd(f"avg(r2) FILTER (WHERE target = '{a}')", _A(a), 5) for a in ASSETS) + " FROM tf GROUP BY source"))
def pivot_transfer(spark, sf):
    return shown(R.pivot_mean(mean_transfer(spark, sf), "source", "target", ASSETS, "r2", _A), {_A(a): 5 for a in ASSETS}, ("source",))
