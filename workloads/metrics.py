"""Metric queries on the predictions fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.safe import rounded
from tideline.operators import metrics as M
from tideline.operators.features import features
from workloads.fixtures import (
    CLF_SQL,
    FOLD_METRICS_SQL,
    PREDS,
    W,
    predictions_clf,
    predictions_reg,
    priority_bars,
    rnd,
    with_sql,
)
from workloads.folds import FRAMES, frames
from workloads.registry import query
from workloads.windows import REGIME, SLOPE, SLOPE2, shown

FOLD = ("asset", "model", "fold")


def fold_metrics(spark, sf):
    return M.regression_metrics(predictions_reg(spark, sf))


def _fold_query(name, cols, extra=()):
    select = "SELECT asset, model, fold, " + ", ".join([*extra, *[rnd(c, c) for c in cols]]) + " FROM fm"

    @query(name, with_sql(*PREDS, FOLD_METRICS_SQL, select=select))
    def run(spark, sf):
        return shown(fold_metrics(spark, sf), {c: 6 for c in cols}, (*FOLD, *extra))


_fold_query("reg_metrics", ["mse", "rmse", "mae"], ("test_size",))
_fold_query("smape", ["smape"])
_fold_query("r2", ["r2"])
_fold_query("vol_ratio", ["vol_ratio"])


@query("mape", with_sql(*PREDS, select=f"""SELECT asset, model, fold, {rnd('avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8))', 'mape')},
  {rnd('avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-9))', 'mape_fine')}, {rnd('100 * avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8))', 'mape_percent', 4)} FROM preds GROUP BY 1, 2, 3"""))
def mape(spark, sf):
    out = predictions_reg(spark, sf).groupBy(*FOLD).agg(M.mape().alias("mape"), M.mape(1e-9).alias("mape_fine"), M.mape(scale=100.0).alias("mape_percent"))
    return shown(out, {"mape": 6, "mape_fine": 6, "mape_percent": 4}, FOLD)


@query("direction_acc", with_sql(*PREDS,
    "d AS (SELECT asset, model, fold, sign(y_true - lag(y_true) OVER w) AS a, sign(y_pred - lag(y_pred) OVER w) AS b FROM preds WINDOW w AS (PARTITION BY asset, model, fold ORDER BY ts))",
    select=f"SELECT asset, model, fold, {rnd('avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)', 'direction_accuracy')} FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3"))
def direction_acc(spark, sf):
    return shown(M.direction_accuracy(predictions_reg(spark, sf)), {"direction_accuracy": 6}, FOLD)


RANKS = (
    "rk AS (SELECT asset, model, fold, rank() OVER (PARTITION BY asset, model, fold ORDER BY y_true) + (count(*) OVER (PARTITION BY asset, model, fold, y_true) - 1) / 2.0 AS ra, "
    "rank() OVER (PARTITION BY asset, model, fold ORDER BY y_pred) + (count(*) OVER (PARTITION BY asset, model, fold, y_pred) - 1) / 2.0 AS rb FROM preds)",
    "ic AS (SELECT asset, model, fold, corr(ra, rb) AS ic FROM rk GROUP BY 1, 2, 3)",
)


@query("spearman_ic", with_sql(*PREDS, *RANKS, select=f"SELECT asset, model, fold, {rnd('ic', 'ic')} FROM ic"))
def spearman_ic(spark, sf):
    return shown(M.rank_ic(predictions_reg(spark, sf)), {"ic": 6}, FOLD)


_SUM = ("mse", "rmse", "mae", "mape", "smape", "r2")


def _summary_sql(std: str) -> str:
    return "SELECT asset, model, count(*) AS n_splits, " + ", ".join(f"{rnd(f'avg({c})', c)}, {rnd(f'{std}({c})', c + '_std')}" for c in _SUM) + " FROM fm GROUP BY 1, 2"


def _summary(spark, sf, pop):
    out = M.fold_summary(fold_metrics(spark, sf), _SUM, pop=pop)
    return shown(out, {c: 6 for c in out.columns if c not in ("asset", "model", "n_splits")}, ("asset", "model", "n_splits"))


@query("fold_summary", with_sql(*PREDS, FOLD_METRICS_SQL, select=_summary_sql("stddev_samp")))
def fold_summary(spark, sf):
    return _summary(spark, sf, False)


@query("fold_summary_pop", with_sql(*PREDS, FOLD_METRICS_SQL, select=_summary_sql("stddev_pop")))
def fold_summary_pop(spark, sf):
    return _summary(spark, sf, True)


@query("leaderboard", with_sql(*PREDS, FOLD_METRICS_SQL, *RANKS, select="SELECT model, " + ", ".join(
    f"{rnd(f'avg({c})', c + '_mean')}, {rnd(f'stddev_samp({c})', c + '_std')}" for c in ("mse", "mae", "ic")) + " FROM fm JOIN ic USING (asset, model, fold) GROUP BY model"))
def leaderboard(spark, sf):
    preds = predictions_reg(spark, sf)
    both = M.regression_metrics(preds).join(M.rank_ic(preds), list(FOLD))
    out = M.leaderboard(both)
    return shown(out, {c: 6 for c in out.columns if c != "model"}, ("model",))


@query("regime_pred_join", with_sql(*PREDS, SLOPE, SLOPE2, REGIME, select=f"SELECT p.asset, model, fold, p.ts, regime, {rnd('y_true', 'y_true')} FROM preds p LEFT JOIN regime USING (asset, ts)"))
def regime_pred_join(spark, sf):
    reg = features(priority_bars(spark, sf), ["regimes"]).select("asset", "ts", "regime")
    return shown(predictions_reg(spark, sf).join(reg, ["asset", "ts"], "left"), {"y_true": 6}, ("asset", "model", "fold", "ts", "regime"))


@query("regime_metrics", with_sql(*PREDS, SLOPE, SLOPE2, REGIME,
    "pr AS (SELECT * FROM preds JOIN regime USING (asset, ts))",
    select=f"""SELECT asset, model, regime, {rnd('avg((y_true - y_pred) ** 2)', 'mse')}, {rnd('sqrt(avg((y_true - y_pred) ** 2))', 'rmse')}, {rnd('avg(abs(y_true - y_pred))', 'mae')},
  {rnd('avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8))', 'mape')}, count(*) AS n FROM pr WHERE regime IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10"""))
def regime_metrics(spark, sf):
    reg = features(priority_bars(spark, sf), ["regimes"]).select("asset", "ts", "regime")
    out = M.regime_metrics(predictions_reg(spark, sf).join(reg, ["asset", "ts"], "left"))
    return shown(out, {c: 6 for c in ("mse", "rmse", "mae", "mape")}, ("asset", "model", "regime", "n"))


NAIVE = (
    *PREDS, FRAMES,
    "lastv AS (SELECT asset, fold, arg_max(y, ts) AS v FROM frames WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2)",
    "naive AS (SELECT f.asset, fold, ts, y AS y_true, v AS y_pred FROM frames f JOIN lastv USING (asset, fold) WHERE role = 'test' AND y IS NOT NULL)",
)


@query("naive_baseline", with_sql(*NAIVE, select=f"""SELECT asset, fold, {rnd('avg((y_true - y_pred) ** 2)', 'mse')}, {rnd('avg(abs(y_true - y_pred))', 'mae')},
  {rnd('avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8))', 'mape')}, {rnd('1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*))', 'r2', 5)} FROM naive GROUP BY 1, 2"""))
def naive_baseline(spark, sf):
    out = M.regression_metrics(M.naive_predictions(frames(spark, sf)), ["asset", "fold"])
    return shown(out, {"mse": 6, "mae": 6, "mape": 6, "r2": 5}, ("asset", "fold"))


# ---- classification -------------------------------------------------------------------

CONF = (
    "cm AS (SELECT {k}, y_true, y_pred, count(*) AS n FROM {t} GROUP BY ALL)",
    "act AS (SELECT {k}, y_true AS label, sum(n) AS support, sum(n) FILTER (WHERE y_true = y_pred) AS tp0 FROM cm GROUP BY ALL)",
    "gue AS (SELECT {k}, y_pred AS label, sum(n) AS guessed FROM cm GROUP BY ALL)",
    "pr AS (SELECT act.*, coalesce(tp0, 0) AS tp, coalesce(tp0, 0) / support AS rec, coalesce(coalesce(tp0, 0) / nullif(guessed, 0), 0) AS pre FROM act LEFT JOIN gue USING ({k}, label))",
    "pf AS (SELECT *, coalesce(2 * pre * rec / nullif(pre + rec, 0), 0) AS f FROM pr)",
    "sc AS (SELECT {k}, sum(tp) / sum(support) AS accuracy, sum(pre * support) / sum(support) AS precision, sum(rec * support) / sum(support) AS recall, "
    "sum(f * support) / sum(support) AS f1, avg(rec) AS balanced_accuracy, CAST(sum(support) AS BIGINT) AS test_size FROM pf GROUP BY ALL)",
)


def conf_sql(table: str, keys: str) -> tuple[str, ...]:
    return tuple(c.format(t=table, k=keys) for c in CONF)


def clf_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join((CLF_SQL, *ctes)) + "\n" + select


_CLF = ("accuracy", "precision", "recall", "f1")


@query("clf_weighted", clf_sql(*conf_sql("clf", "fold"), select="SELECT fold, test_size, " + ", ".join(rnd(c, c) for c in _CLF) + " FROM sc"))
def clf_weighted(spark, sf):
    return shown(M.classification_metrics(predictions_clf(spark, sf), ["fold"]), {c: 6 for c in _CLF}, ("fold", "test_size"))


@query("balanced_acc", clf_sql(*conf_sql("clf", "fold"), select=f"SELECT fold, {rnd('balanced_accuracy', 'balanced_accuracy')} FROM sc"))
def balanced_acc(spark, sf):
    return shown(M.classification_metrics(predictions_clf(spark, sf), ["fold"]), {"balanced_accuracy": 6}, ("fold",))


@query("confusion", clf_sql(select="SELECT fold, y_true, y_pred, count(*) AS n FROM clf GROUP BY 1, 2, 3"))
def confusion(spark, sf):
    return M.confusion(predictions_clf(spark, sf), ["fold"])


BIN = """bc AS (SELECT fold, count(*) FILTER (WHERE y_prob >= 0.6 AND y_true = 1) AS tp, count(*) FILTER (WHERE y_prob >= 0.6 AND y_true <> 1) AS fp,
  count(*) FILTER (WHERE y_prob < 0.6 AND y_true = 1) AS fn, count(*) FILTER (WHERE y_prob < 0.6 AND y_true <> 1) AS tn,
  -avg(CASE WHEN y_true = 1 THEN ln(greatest(least(y_prob, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(y_prob, 1 - 1e-15), 1e-15)) END) AS log_loss FROM clf GROUP BY 1)"""


@query("clf_binary", clf_sql(BIN, select=f"""SELECT fold, {rnd('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {rnd('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')},
  {rnd('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {rnd('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {rnd('log_loss', 'log_loss')} FROM bc"""))
def clf_binary(spark, sf):
    out = M.binary_metrics(predictions_clf(spark, sf), ["fold"], 0.6)
    return shown(out, {c: 6 for c in out.columns if c != "fold"}, ("fold",))


@query("logloss", clf_sql(BIN, select=f"SELECT fold, {rnd('log_loss', 'log_loss')} FROM bc"))
def logloss(spark, sf):
    return predictions_clf(spark, sf).groupBy("fold").agg(rounded(M.log_loss()).alias("log_loss"))


@query("roc_auc", clf_sql(
    "rk AS (SELECT fold, y_true, rank() OVER (PARTITION BY fold ORDER BY y_prob) + (count(*) OVER (PARTITION BY fold, y_prob) - 1) / 2.0 AS rk FROM clf)",
    "s AS (SELECT fold, sum(rk) FILTER (WHERE y_true = 1) AS sr, count(*) FILTER (WHERE y_true = 1) AS n1, count(*) FILTER (WHERE y_true <> 1) AS n0 FROM rk GROUP BY fold)",
    select=f"SELECT fold, {rnd('(sr - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0)', 'roc_auc')} FROM s"))
def roc_auc(spark, sf):
    return shown(M.roc_auc(predictions_clf(spark, sf), ["fold"]), {"roc_auc": 6}, ("fold",))


@query("threshold_tune", clf_sql(
    "th AS (SELECT unnest(range(1, 9)) AS i)",
    "x AS (SELECT fold, i, y_true, CASE WHEN y_prob >= 0.1 + 0.1 * CAST(i - 1 AS DOUBLE) THEN 1 ELSE 0 END AS y_pred FROM clf, th)",
    *conf_sql("x", "fold, i"),
    "best AS (SELECT fold, i, f1, row_number() OVER (PARTITION BY fold ORDER BY round(f1, 12) DESC, i) AS k FROM sc)",
    select=f"SELECT fold, {rnd('i / 10.0', 'optimal_threshold')}, {rnd('f1', 'f1_optimized')} FROM best WHERE k = 1"))
def threshold_tune(spark, sf):
    return shown(M.tune_threshold(predictions_clf(spark, sf), ["fold"]), {"optimal_threshold": 6, "f1_optimized": 6}, ("fold",))


_UP = f"up AS (SELECT *, CASE WHEN lead(close) OVER ({W}) / close > 1 THEN 1 WHEN lead(close) OVER ({W}) IS NOT NULL THEN 0 END AS y FROM r)"
_UPF = """upf AS (SELECT u.asset, u.ts, y, fold, CASE WHEN u.rn < train_hi THEN 'train' ELSE 'test' END AS role FROM up u JOIN folds f ON f.asset = u.asset AND u.rn >= train_lo AND u.rn < test_hi)"""


@query("last_sign_baseline", with_sql(*PREDS[:3], _UP, _UPF,
    "lastv AS (SELECT asset, fold, CASE WHEN arg_max(y, ts) > 0 THEN 1 ELSE 0 END AS v FROM upf WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2)",
    "ls AS (SELECT asset, fold, y AS y_true, v AS y_pred FROM upf JOIN lastv USING (asset, fold) WHERE role = 'test' AND y IS NOT NULL)",
    *conf_sql("ls", "asset, fold"),
    select=f"SELECT asset, fold, {rnd('accuracy', 'accuracy')}, {rnd('f1', 'f1')} FROM sc"))
def last_sign_baseline(spark, sf):
    from tideline.operators.folds import fold_frames
    from workloads.fixtures import sliding_folds

    df = features(priority_bars(spark, sf), ["targets"], extra=["_rn"])
    y = F.when(F.col("next_return").isNotNull(), (F.col("next_return") > 0).cast("int"))
    rows = df.select("asset", "ts", F.col("_rn").alias("rn"), y.alias("y"))
    preds = M.last_sign_predictions(fold_frames(rows, sliding_folds(spark, sf)))
    return shown(M.classification_metrics(preds, ["asset", "fold"]), {"accuracy": 6, "f1": 6}, ("asset", "fold"))


@query("imbalance_ratio", """WITH c AS (SELECT o_orderpriority AS asset, o_orderstatus AS label, count(*) AS k FROM orders GROUP BY 1, 2)
  SELECT asset, round(max(k) / min(k), 6) + 0.0 AS imbalance, max(k) / min(k) >= 5 AS balance FROM c GROUP BY asset""")
def imbalance_ratio(spark, sf):
    from workloads.fixtures import table

    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("asset"), F.col("o_orderstatus").alias("label"))
    return M.class_imbalance(rows).select("asset", rounded("imbalance").alias("imbalance"), "balance")


@query("class_balance", """WITH c AS (SELECT source AS asset, lang AS label, count(*) AS k FROM documents GROUP BY 1, 2),
  s AS (SELECT asset, sum(k) AS total, count(*) AS classes, max(k) / min(k) AS ratio FROM c GROUP BY asset)
  SELECT doc_id, source AS asset, lang AS label, round(CASE WHEN ratio >= 1.2 THEN total / (classes * k) ELSE 1.0 END, 6) + 0.0 AS weight
  FROM documents d JOIN c ON c.asset = d.source AND c.label = d.lang JOIN s ON s.asset = d.source""")
def class_balance(spark, sf):
    from workloads.fixtures import table

    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("asset"), F.col("lang").alias("label"))
    return M.class_weights(rows, limit=1.2).select("doc_id", "asset", "label", rounded("weight").alias("weight"))
