"""Attribution queries on linear contributions of five features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tideline.functions.safe import rounded
from tideline.operators import attribution as X
from tideline.operators.features import features
from workloads.fixtures import ASSETS, W, priority_bars, rnd, roll, with_sql
from workloads.registry import query
from workloads.windows import shown

NAMES = ("lag1", "momentum_5", "momentum_10", "vol_cluster_5", "mean_reversion_5")
# Coefficients of the two linear models.
COEFS = {
    "wide": {"lag1": 0.8, "momentum_5": -0.25, "momentum_10": 0.15, "vol_cluster_5": 0.05, "mean_reversion_5": 0.6},
    "lean": {"lag1": 0.3, "momentum_5": 0.4, "momentum_10": -0.1, "vol_cluster_5": 0.02, "mean_reversion_5": -0.9},
}
FEAT = (
    f"pc AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS pc FROM r)",
    f"""fe AS (SELECT asset, ts, lag(ret, 31) OVER ({W}) AS lag1, close / lag(close, 5) OVER ({W}) - 1 AS momentum_5, close / lag(close, 10) OVER ({W}) - 1 AS momentum_10,
       {roll('stddev_samp', 'pc', 5)} AS vol_cluster_5, (close - ({roll('avg', 'close', 5)})) / ({roll('stddev_samp', 'close', 5)}) AS mean_reversion_5 FROM pc)""",
    "fx AS (SELECT * FROM fe WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NAMES) + ")",
    "mu AS (SELECT asset, " + ", ".join(f"avg({c}) AS m_{c}" for c in NAMES) + " FROM fx GROUP BY asset)",
    "co AS (" + " UNION ALL ".join(
        f"SELECT fx.asset, '{m}' AS model, ts, '{f}' AS feature, {f} AS value, {b} * ({f} - m_{f}) AS c FROM fx JOIN mu USING (asset)" for m, cs in COEFS.items() for f, b in cs.items()) + ")",
    "im AS (SELECT asset, model, feature, avg(abs(c)) AS importance FROM co GROUP BY 1, 2, 3)",
)


def rows(spark, sf):
    return features(priority_bars(spark, sf), ["lagged", "performance"]).select("asset", "ts", *NAMES).na.drop()


def contributions(spark, sf):
    return X.linear_contributions(rows(spark, sf), COEFS)


def table(spark, sf):
    return X.importance(contributions(spark, sf))


@query("linear_contrib", with_sql(*FEAT, select=f"SELECT asset, model, ts, feature, {rnd('value', 'value')}, {rnd('c', 'contribution')} FROM co"))
def linear_contrib(spark, sf):
    return shown(contributions(spark, sf), {"value": 6, "contribution": 6}, ("asset", "model", "ts", "feature"))


@query("importance", with_sql(*FEAT, select=f"SELECT asset, model, feature, {rnd('importance', 'importance')} FROM im"))
def importance(spark, sf):
    return shown(table(spark, sf), {"importance": 6}, ("asset", "model", "feature"))


def _stat_sql(keys):
    return f"SELECT {keys}, arg_max(feature, importance) AS top_feature, {rnd('max(importance)', 'top_importance')}, {rnd('avg(importance)', 'mean_importance')}, {rnd('stddev_pop(importance)', 'std_importance')} FROM im GROUP BY ALL"


_STATS = {"top_importance": 6, "mean_importance": 6, "std_importance": 6}


@query("importance_stats", with_sql(*FEAT, select=_stat_sql("asset, model")))
def importance_stats(spark, sf):
    return shown(X.importance_stats(table(spark, sf)), _STATS, ("asset", "model", "top_feature"))


@query("importance_by_model", with_sql(*FEAT, select=_stat_sql("model")))
def importance_by_model(spark, sf):
    return shown(X.importance_stats(table(spark, sf), ["model"]), _STATS, ("model", "top_feature"))


@query("importance_by_asset", with_sql(*FEAT, select=_stat_sql("asset")))
def importance_by_asset(spark, sf):
    return shown(X.importance_stats(table(spark, sf), ["asset"]), _STATS, ("asset", "top_feature"))


_CELL = lambda a, m: f"a{a[0]}_{m}"


@query("importance_pivot", with_sql(*FEAT, select="SELECT feature, " + ", ".join(
    rnd(f"avg(importance) FILTER (WHERE asset = '{a}' AND model = '{m}')", _CELL(a, m)) for a in ASSETS for m in COEFS) + " FROM im GROUP BY feature"))
def importance_pivot(spark, sf):
    wide = X.importance_wide(table(spark, sf), ASSETS, list(COEFS), _CELL)
    return shown(wide, {c: 6 for c in wide.columns if c != "feature"}, ("feature",))


TOP = "tp AS (SELECT *, row_number() OVER (PARTITION BY asset, model ORDER BY importance DESC, feature) AS rank FROM im)"


@query("top_features", with_sql(*FEAT, TOP, select=f"SELECT asset, model, feature, CAST(rank AS INTEGER) AS rank, {rnd('importance', 'importance')} FROM tp WHERE rank <= 3"))
def top_features(spark, sf):
    return shown(X.top_features(table(spark, sf), 3), {"importance": 6}, ("asset", "model", "feature", "rank"))


@query("coverage", with_sql(*FEAT, "un AS (SELECT DISTINCT asset FROM r UNION SELECT DISTINCT event_type FROM events)", "cv AS (SELECT asset, count(DISTINCT model) AS k FROM im GROUP BY asset)",
    select="SELECT asset, k IS NOT NULL AS has_data, coalesce(k, 0) AS model_count FROM un LEFT JOIN cv USING (asset)"))
def coverage(spark, sf):
    from tideline.operators.align import symbol_union
    from workloads.fixtures import table as given

    other = given(spark, sf, "events").select(F.col("event_type").alias("asset"))
    return X.coverage(table(spark, sf), symbol_union(priority_bars(spark, sf), other))


@query("model_coverage", with_sql(*FEAT, select="SELECT model, count(DISTINCT asset) AS asset_count FROM im GROUP BY model"))
def model_coverage(spark, sf):
    return X.model_coverage(table(spark, sf))


_PAIRS = sorted(tuple(p) for p in combinations(NAMES, 2))
INTER = (
    "wd AS (SELECT asset, model, ts, " + ", ".join(f"max(c) FILTER (WHERE feature = '{f}') AS {f}" for f in NAMES) + " FROM co GROUP BY 1, 2, 3)",
    "ia AS (" + " UNION ALL ".join(f"SELECT asset, model, '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS corr, corr(abs({a}), abs({b})) AS ac FROM wd GROUP BY 1, 2" for a, b in _PAIRS) + ")",
)


@query("contrib_corr", with_sql(*FEAT, *INTER, select=f"SELECT asset, model, feature_1, feature_2, {rnd('abs(corr)', 'strength')}, {rnd('ac', 'abs_value_corr')} FROM ia"))
def contrib_corr(spark, sf):
    return shown(X.interactions(contributions(spark, sf), NAMES), {"strength": 6, "abs_value_corr": 6}, ("asset", "model", "feature_1", "feature_2"))


@query("top_interactions", with_sql(*FEAT, *INTER, "ti AS (SELECT *, row_number() OVER (PARTITION BY asset, model ORDER BY abs(corr) DESC NULLS LAST, feature_1, feature_2) AS rank FROM ia)",
    select=f"SELECT asset, model, feature_1, feature_2, CAST(rank AS INTEGER) AS rank, {rnd('abs(corr)', 'strength')} FROM ti WHERE rank <= 3"))
def top_interactions(spark, sf):
    return shown(X.top_interactions(X.interactions(contributions(spark, sf), NAMES), 3), {"strength": 6}, ("asset", "model", "feature_1", "feature_2", "rank"))


@query("contrib_temporal", with_sql(*FEAT, "cr AS (SELECT *, row_number() OVER (PARTITION BY asset, model, feature ORDER BY ts) - 1 AS k FROM co)",
    select=f"SELECT asset, model, feature, {rnd('avg(c)', 'mean')}, {rnd('stddev_pop(c)', 'std')}, {rnd('regr_slope(c, k)', 'trend', 8)}, {rnd('stddev_pop(c) / avg(abs(c))', 'volatility')} FROM cr GROUP BY 1, 2, 3"))
def contrib_temporal(spark, sf):
    return shown(X.temporal_stats(contributions(spark, sf)), {"mean": 6, "std": 6, "trend": 8, "volatility": 6}, ("asset", "model", "feature"))


_FR = "(PARTITION BY asset, model, feature ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query("contrib_rolling", with_sql(*FEAT, select=f"SELECT asset, model, feature, ts, {rnd(f'avg(c) OVER {_FR}', 'rolling_mean')}, {rnd(f'stddev_samp(c) OVER {_FR}', 'rolling_std')}, {rnd(f'max(c) OVER {_FR}', 'rolling_max')}, {rnd(f'min(c) OVER {_FR}', 'rolling_min')} FROM co"))
def contrib_rolling(spark, sf):
    return shown(X.rolling_stats(contributions(spark, sf)), {f"rolling_{s}": 6 for s in ("mean", "std", "max", "min")}, ("asset", "model", "feature", "ts"))


_MW = "PARTITION BY asset, model ORDER BY ts"


@query("contrib_changes", with_sql(*FEAT, "sz AS (SELECT asset, model, ts, avg(abs(c)) AS size FROM co GROUP BY 1, 2, 3)",
    "th AS (SELECT asset, model, 0.1 * stddev_pop(size) AS lim FROM sz GROUP BY 1, 2)",
    f"ro AS (SELECT *, row_number() OVER ({_MW}) - 1 AS position, avg(size) OVER ({_MW} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling FROM sz)",
    f"sp AS (SELECT *, lead(rolling) OVER ({_MW}) - rolling AS step FROM ro)",
    select=f"SELECT asset, model, ts, position, {rnd('rolling', 'rolling')}, {rnd('step', 'step')} FROM sp JOIN th USING (asset, model) WHERE abs(step) > lim"))
def contrib_changes(spark, sf):
    out = X.change_points(contributions(spark, sf), deviations=0.1)
    return shown(out, {"rolling": 6, "step": 6}, ("asset", "model", "ts", "position"))


@query("dependence", with_sql(*FEAT, TOP, select=f"SELECT asset, model, ts, feature, {rnd('value', 'value')}, {rnd('c', 'contribution')} FROM co WHERE (asset, model, feature) IN (SELECT asset, model, feature FROM tp WHERE rank <= 2)"))
def dependence(spark, sf):
    co = contributions(spark, sf).drop("value")
    joined = X.with_values(X.dependence(co, X.top_features(X.importance(co), 2)), rows(spark, sf), NAMES)
    return shown(joined, {"value": 6, "contribution": 6}, ("asset", "model", "ts", "feature"))


@query("explain_row", with_sql(*FEAT, "lastrow AS (SELECT asset, max(ts) AS ts FROM fx GROUP BY asset)",
    select=f"""SELECT asset, model, ts, feature, {rnd('c', 'contribution')}, CAST(row_number() OVER (PARTITION BY asset, model, ts ORDER BY abs(c) DESC, feature) AS INTEGER) AS rank,
  {rnd('sum(c) OVER (PARTITION BY asset, model, ts)', 'total')}, CAST(0 AS DOUBLE) AS base_value FROM co WHERE (asset, ts) IN (SELECT asset, ts FROM lastrow)"""))
def explain_row(spark, sf):
    co = contributions(spark, sf)
    last = co.groupBy("asset").agg(F.max("ts").alias("ts"))
    out = X.explain_row(co.join(last, ["asset", "ts"], "left_semi"), F.lit(True))
    return shown(out, {"contribution": 6, "total": 6, "base_value": 6}, ("asset", "model", "ts", "feature", "rank"))


@query("coef_importance", with_sql(*FEAT, "cf(model, feature, b) AS (VALUES " + ", ".join(f"('{m}', '{f}', {b})" for m, cs in COEFS.items() for f, b in cs.items()) + ")",
    select=f"SELECT asset, model, feature, {rnd('0.7 * abs(b) + 0.3 * abs(importance)', 'importance')} FROM im JOIN cf USING (model, feature)"))
def coef_importance(spark, sf):
    scores = table(spark, sf).withColumnRenamed("importance", "score")
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f).alias("f"), F.lit(b).alias("b")) for m, cs in COEFS.items() for f, b in cs.items()])
    match = F.filter(pairs, lambda p: (p.m == F.col("model")) & (p.f == F.col("feature")))
    coefs = scores.select("asset", "model", "feature", F.element_at(match, 1).b.alias("coefficient"))
    return shown(X.coefficient_importance(coefs, scores), {"importance": 6}, ("asset", "model", "feature"))


@query("eval_sample", with_sql(*FEAT, "ranked AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY md5('42|' || asset || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), ts) AS _k FROM fx)",
    select=f"SELECT asset, ts, {rnd('lag1', 'lag1')} FROM ranked WHERE _k <= 20"))
def eval_sample(spark, sf):
    return shown(X.evaluation_sample(rows(spark, sf)), {"lag1": 6}, ("asset", "ts"))
