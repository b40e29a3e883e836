"""Selection, leakage and diagnostic queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tideline.functions.layout import Series
from tideline.functions.safe import rounded
from tideline.operators import diagnostics as D
from tideline.operators import selection as S
from tideline.operators import unitroot as U
from tideline.operators.align import returns
from tideline.operators.features import Module, features
from workloads.fixtures import PREDS, W, frame, predictions_reg, priority_bars, rnd, roll, with_sql
from workloads.registry import query
from workloads.windows import REGIME, SLOPE, SLOPE2, TARGET, VOL5, shown

FEATS = ("lag1", "lag5", "momentum_5", "momentum_10", "mean_reversion_5", "vol_cluster_5", "volatility_5d", "future_vol")
TARGETS = ("y", "regime_code")


def _future(c):
    return [{}, {"future_vol": F.lead("vol5", 4).over(c.w)}]


FUTURE = Module("future", _future, lambda cfg: 6, ("close",), lambda cfg: 5)


def feature_rows(spark, sf):
    df = features(priority_bars(spark, sf), ["lagged", "performance", "statistical", "targets", "regimes", FUTURE])
    return df.select("asset", "ts", *FEATS, F.col("target_vol5").alias("y"), "regime_code")


FEAT_SQL = (
    VOL5, TARGET, SLOPE, SLOPE2, REGIME,
    f"f0 AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS pc, lag(ret, 35) OVER ({W}) AS r35 FROM t)",
    f"""feat AS (SELECT f0.asset, f0.ts, lag(ret, 31) OVER w AS lag1, lag(ret, 35) OVER w AS lag5, close / lag(close, 5) OVER w - 1 AS momentum_5,
       close / lag(close, 10) OVER w - 1 AS momentum_10, (close - ({roll('avg', 'close', 5, w='PARTITION BY f0.asset ORDER BY f0.ts')})) / ({roll('stddev_samp', 'close', 5, w='PARTITION BY f0.asset ORDER BY f0.ts')}) AS mean_reversion_5,
       {roll('stddev_samp', 'pc', 5, w='PARTITION BY f0.asset ORDER BY f0.ts')} AS vol_cluster_5, ({roll('stddev_samp', 'r35', 5, 2, w='PARTITION BY f0.asset ORDER BY f0.ts')}) * sqrt(252.0) AS volatility_5d,
       lead(vol5, 4) OVER w AS future_vol, y, CASE regime WHEN 'Bear' THEN 0 WHEN 'Sideways' THEN 1 WHEN 'Bull' THEN 2 END AS regime_code
       FROM f0 LEFT JOIN regime USING (asset, ts) WINDOW w AS (PARTITION BY f0.asset ORDER BY f0.ts))""",
)


def _corr_union(by: str = "asset") -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS feature, '{t}' AS target, corr({c}, {t}) AS corr, count(*) FILTER (WHERE {c} IS NOT NULL AND {t} IS NOT NULL) AS n FROM feat GROUP BY asset"
        for c in FEATS for t in TARGETS
    )


CORR = (*FEAT_SQL, f"ct AS ({_corr_union()})")


def corr_table(spark, sf):
    return S.target_correlations(feature_rows(spark, sf), FEATS, TARGETS)


@query("feature_target_corr", with_sql(*CORR, select=f"SELECT asset, feature, target, n, {rnd('abs(corr)', 'abs_corr')} FROM ct"))
def feature_target_corr(spark, sf):
    return shown(corr_table(spark, sf), {"abs_corr": 6}, ("asset", "feature", "target", "n"))


@query("corr_matrix", with_sql(*FEAT_SQL, "cm AS (" + " UNION ALL ".join(
    f"SELECT asset, '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS corr FROM feat GROUP BY asset" for a, b in combinations(FEATS, 2)) + ")",
    select=f"SELECT asset, feature_1, feature_2, {rnd('corr', 'corr')} FROM cm"))
def corr_matrix(spark, sf):
    return shown(S.correlation_matrix(feature_rows(spark, sf), FEATS, ["asset"]), {"corr": 6}, ("asset", "feature_1", "feature_2"))


@query("quality_flags", with_sql(*FEAT_SQL, "f2 AS (SELECT *, CASE WHEN dayofmonth(ts) = 13 THEN CAST('inf' AS DOUBLE) ELSE lag5 + momentum_5 END AS odd, lag1 * 3 - 1 AS twin FROM feat)",
    "cm AS (" + " UNION ALL ".join(f"SELECT corr({a}, {b}) AS c FROM f2" for a, b in combinations(("lag1", "lag5", "twin", "momentum_5", "CASE WHEN isfinite(odd) THEN odd END"), 2)) + ")",
    select="SELECT count(*) FILTER (WHERE abs(c) > 0.95) AS high_pairs, (SELECT count(*) FILTER (WHERE isinf(odd)) FROM f2) AS infinite, FALSE AS is_clean FROM cm"))
def quality_flags(spark, sf):
    df = feature_rows(spark, sf).withColumn("twin", F.col("lag1") * 3 - 1)
    df = df.withColumn("odd", F.when(F.dayofmonth("ts") == 13, F.lit(float("inf"))).otherwise(F.col("lag5") + F.col("momentum_5")))
    return S.quality_flags(df, ["lag1", "lag5", "twin", "momentum_5", "odd"])


@query("select_by_corr", with_sql(*CORR, select=f"SELECT asset, feature, {rnd('abs(corr)', 'abs_corr')} FROM ct WHERE target = 'y' AND abs(corr) >= 0.01"))
def select_by_corr(spark, sf):
    table = corr_table(spark, sf).filter(F.col("target") == "y")
    return shown(S.select_by_correlation(table), {"abs_corr": 6}, ("asset", "feature"))


@query("select_by_variance", with_sql(*FEAT_SQL, "vv AS (" + " UNION ALL ".join(f"SELECT asset, '{c}' AS feature, var_samp({c}) AS variance FROM feat GROUP BY asset" for c in FEATS) + ")",
    select=f"SELECT asset, feature, {rnd('variance', 'variance', 5)} FROM vv WHERE variance >= 0.01"))
def select_by_variance(spark, sf):
    return shown(S.select_by_variance(feature_rows(spark, sf), FEATS), {"variance": 5}, ("asset", "feature"))


@query("drop_corr_features", with_sql(*CORR,
    "h AS (SELECT asset, feature, abs(corr) AS a, coalesce(abs(corr) > 0.03, FALSE) AS high FROM ct WHERE target = 'y')",
    "o AS (SELECT *, count(*) FILTER (WHERE NOT high) OVER (PARTITION BY asset) AS kept, row_number() OVER (PARTITION BY asset ORDER BY high DESC, feature) AS k FROM h)",
    select=f"SELECT asset, feature, {rnd('a', 'abs_corr')}, high AND NOT (kept < 35 AND k <= 6) AS dropped FROM o"))
def drop_corr_features(spark, sf):
    table = corr_table(spark, sf).filter(F.col("target") == "y")
    return shown(S.kept_features(table, 0.03, least=35, restore=6), {"abs_corr": 6}, ("asset", "feature", "dropped"))


@query("kbest_corr", with_sql(*CORR, "k AS (SELECT asset, feature, abs(corr) AS a, row_number() OVER (PARTITION BY asset ORDER BY abs(corr) DESC NULLS LAST, feature) AS rank FROM ct WHERE target = 'y')",
    select=f"SELECT asset, feature, CAST(rank AS INTEGER) AS rank, {rnd('a', 'abs_corr')} FROM k WHERE rank <= 5"))
def kbest_corr(spark, sf):
    table = corr_table(spark, sf).filter(F.col("target") == "y")
    return shown(S.top_k(table, "abs_corr", 5), {"abs_corr": 6}, ("asset", "feature", "rank"))


@query("kbest_f", with_sql(*CORR, "fs AS (SELECT asset, feature, corr * corr * (n - 2) / (1 - corr * corr) AS f FROM ct WHERE target = 'y')",
    "k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY f DESC NULLS LAST, feature) AS rank FROM fs)",
    select=f"SELECT asset, feature, CAST(rank AS INTEGER) AS rank, {rnd('f', 'f_score', 4)} FROM k WHERE rank <= 5"))
def kbest_f(spark, sf):
    table = S.f_scores(corr_table(spark, sf).filter(F.col("target") == "y"))
    return shown(S.top_k(table, "f_score", 5), {"f_score": 4}, ("asset", "feature", "rank"))


_MI = ("lag1", "momentum_5", "volatility_5d", "future_vol")
_DEC = "[" + ", ".join(f"{i}/10.0" for i in range(1, 10)) + "]"


@query("kbest_mi", with_sql(*FEAT_SQL,
    "lg AS (" + " UNION ALL ".join(f"SELECT asset, '{c}' AS feature, {c} AS x, y FROM feat WHERE y IS NOT NULL AND {c} IS NOT NULL" for c in _MI) + ")",
    f"xe AS (SELECT asset, feature, quantile_cont(x, {_DEC}) AS e FROM lg GROUP BY 1, 2)",
    f"ye AS (SELECT asset, quantile_cont(y, {_DEC}) AS e FROM feat WHERE y IS NOT NULL GROUP BY 1)",
    "cells AS (SELECT lg.asset, lg.feature, len(list_filter(xe.e, lambda q: q < x)) AS bx, len(list_filter(ye.e, lambda q: q < y)) AS bys, count(*) AS k FROM lg JOIN xe USING (asset, feature) JOIN ye ON ye.asset = lg.asset GROUP BY ALL)",
    "pr AS (SELECT *, sum(k) OVER (PARTITION BY asset, feature) AS n, sum(k) OVER (PARTITION BY asset, feature, bx) AS nx, sum(k) OVER (PARTITION BY asset, feature, bys) AS ny FROM cells)",
    "mi AS (SELECT asset, feature, sum(k / n * ln(k * n / (nx * ny))) AS mi FROM pr GROUP BY 1, 2)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY mi DESC, feature) AS rank FROM mi)",
    select=f"SELECT asset, feature, CAST(rank AS INTEGER) AS rank, {rnd('mi', 'mi')} FROM rk WHERE rank <= 3"))
def kbest_mi(spark, sf):
    table = S.mutual_information(feature_rows(spark, sf), _MI, "y")
    return shown(S.top_k(table, "mi", 3), {"mi": 6}, ("asset", "feature", "rank"))


LEAK = (*CORR,
    """lk AS (SELECT asset, feature, max(abs(corr)) AS max_corr, max(abs(corr)) FILTER (WHERE target = 'y') AS vol_corr,
       coalesce(bool_or(abs(corr) > 0.7), FALSE) AS dropped FROM ct GROUP BY 1, 2)""",
    """lr AS (SELECT *, regexp_matches(lower(feature), 'target|regime|future') OR (contains(lower(feature), 'vol') AND coalesce(vol_corr > 0.7, FALSE)) AS suspicious,
       coalesce(vol_corr > 0.5, FALSE) AS listed FROM lk)""",
    "st AS (SELECT CASE WHEN count(*) FILTER (WHERE listed) > 5 THEN 'FAIL' WHEN count(*) FILTER (WHERE listed) + count(*) FILTER (WHERE suspicious) > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM lr)",
    "rc AS (SELECT lr.* FROM lr JOIN st ON TRUE WHERE NOT listed OR status <> 'WARNING')",
)


@query("leakage_report", with_sql(*LEAK, select=f"SELECT asset, feature, {rnd('max_corr', 'max_corr')}, dropped, suspicious, listed, (SELECT status FROM st) AS status, "
    "(SELECT CASE WHEN count(*) FILTER (WHERE listed) > 5 THEN 'FAIL' WHEN count(*) FILTER (WHERE listed) + count(*) FILTER (WHERE suspicious) > 0 THEN 'WARNING' ELSE 'PASS' END FROM rc) AS status_after FROM lr"))
def leakage_report(spark, sf):
    report = S.leakage_table(corr_table(spark, sf), "y")
    report = report.withColumn("status", S.leakage_status(report).select("status").scalar()).withColumn(
        "status_after", S.leakage_recheck(report).select("status").scalar()
    )
    return shown(report, {"max_corr": 6}, ("asset", "feature", "dropped", "suspicious", "listed", "status", "status_after"))


# ---- diagnostics ----------------------------------------------------------------------

RESIDUALS = Series(keys=("asset", "model"))
RES = (*PREDS, "res AS (SELECT asset, model, ts, y_true - y_pred AS e FROM preds)")


def residuals(spark, sf):
    return predictions_reg(spark, sf).select("asset", "model", "ts", (F.col("y_true") - F.col("y_pred")).alias("e"))


_MOM = ("mm AS (SELECT asset, model, avg(e) AS m, count(*) AS n FROM res GROUP BY 1, 2)",
        "ms AS (SELECT asset, model, any_value(m) AS m, any_value(n) AS n, sum((e - m) ** 2) / any_value(n) AS m2, sum((e - m) ** 3) / any_value(n) AS m3, sum((e - m) ** 4) / any_value(n) AS m4 FROM res JOIN mm USING (asset, model) GROUP BY 1, 2)")


@query("residual_stats", with_sql(*RES, *_MOM, select=f"""SELECT asset, model, {rnd('m', 'mean')}, {rnd('sqrt(m2 * n / (n - 1))', 'std')},
  {rnd('m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2)', 'skew')}, {rnd('((n + 1) * (m4 / m2 ** 2 - 3) + 6) * (n - 1.0) / ((n - 2.0) * (n - 3))', 'kurtosis')} FROM ms"""))
def residual_stats(spark, sf):
    return shown(D.residual_stats(residuals(spark, sf), "e", ["asset", "model"]), {c: 6 for c in ("mean", "std", "skew", "kurtosis")}, ("asset", "model"))


_RW = "PARTITION BY asset, model ORDER BY ts"
_AC = "ac AS (SELECT asset, model, any_value(ms_n) AS n, sum(d * d) AS c0, sum(e * e) AS sq, sum((d - l1) ** 2) AS dw, " + ", ".join(f"sum(d * l{k}) AS c{k}" for k in range(1, 11)) + " FROM lg GROUP BY 1, 2)"
_LGR = (
    "dm AS (SELECT asset, model, ts, e, e - m AS d, n AS ms_n FROM res JOIN mm USING (asset, model))",
    "lg AS (SELECT *, " + ", ".join(f"lag(d, {k}) OVER ({_RW}) AS l{k}" for k in range(1, 11)) + " FROM dm)",
    _AC,
)
_LB = "n * (n + 2.0) * (" + " + ".join(f"(c{k} / c0) ** 2 / (n - {k})" for k in range(1, 11)) + ")"
_JB = "ac.n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4)"
_TAIL = " + ".join(f"(q / 2) ** {i} / {f}" for i, f in ((1, 1), (2, 2), (3, 6), (4, 24)))


@query("residual_tests", with_sql(*RES, *_MOM, *_LGR,
    f"tt AS (SELECT ac.asset, ac.model, ac.n, {_LB.replace('n *', 'ac.n *', 1).replace('(n ', '(ac.n ')} AS q, {_JB} AS jb, dw / sq AS dwst, c1 / c0 AS a1, c5 / c0 AS a5 FROM ac JOIN ms USING (asset, model))",
    select=f"""SELECT asset, model, n, {rnd('q', 'ljung_box', 4)}, {rnd(f'exp(-q / 2) * (1 + {_TAIL})', 'ljung_box_p')}, {rnd('jb', 'jarque_bera', 4)}, {rnd('exp(-jb / 2)', 'jarque_bera_p')},
  {rnd('dwst', 'durbin_watson')}, {rnd('a1', 'acf_1')}, {rnd('a5', 'acf_5')} FROM tt"""))
def residual_tests(spark, sf):
    out = D.residual_tests(residuals(spark, sf), "e", RESIDUALS)
    digits = {"ljung_box": 4, "ljung_box_p": 6, "jarque_bera": 4, "jarque_bera_p": 6, "durbin_watson": 6, "acf_1": 6, "acf_5": 6}
    return shown(out, digits, ("asset", "model", "n"))


@query("acf", with_sql("lgs AS (SELECT *, " + ", ".join(f"lag(ret, {k}) OVER ({W}) AS l{k}" for k in range(1, 11)) + " FROM r)",
    select=" UNION ALL ".join(f"SELECT asset, CAST({k} AS INTEGER) AS lag, {rnd(f'corr(ret, l{k})', 'acf')} FROM lgs GROUP BY asset" for k in range(1, 11))))
def acf(spark, sf):
    rets = returns(priority_bars(spark, sf)).select("asset", "ts", "ret")
    return shown(D.autocorrelation(rets, "ret", Series()), {"acf": 6}, ("asset", "lag"))


def _stationary_sql(tag: str, src: str, x: str) -> tuple[str, ...]:
    """CTEs that end in st{tag}(asset, n, adf, kpss)."""
    lags = ", ".join(f"lag(e, {k}) OVER ({W}) AS l{k}" for k in range(1, 11))
    lr = "c0 + " + " + ".join(f"2 * (1 - {k} / 11.0) * c{k}" for k in range(1, 11))
    return (
        f"mu{tag} AS (SELECT asset, avg({x}) AS mu FROM {src} WHERE {x} IS NOT NULL GROUP BY asset)",
        f"dm{tag} AS (SELECT asset, ts, {x} - mu AS e FROM {src} JOIN mu{tag} USING (asset) WHERE {x} IS NOT NULL)",
        f"lg{tag} AS (SELECT *, {lags}, sum(e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum FROM dm{tag})",
        f"ag{tag} AS (SELECT asset, count(*) AS n, sum(e * e) AS c0, " + ", ".join(f"sum(e * l{k}) AS c{k}" for k in range(1, 11))
        + f", sum(cum * cum) AS ss, regr_slope(e - l1, l1) AS b, regr_sxx(e - l1, l1) AS sxx, regr_syy(e - l1, l1) AS syy, count(l1) AS m FROM lg{tag} GROUP BY asset)",
        f"st{tag} AS (SELECT asset, n, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) AS adf, ss / (n * ({lr})) AS kpss FROM ag{tag})",
    )


_VERDICT = "CASE WHEN adf < -2.8621 AND kpss < 0.463 THEN 'stationary' WHEN NOT adf < -2.8621 AND NOT kpss < 0.463 THEN 'non_stationary' ELSE 'inconclusive' END"
CUMCLOSE = f"cc AS (SELECT asset, ts, ret, sum(ret + 0.01) OVER ({W} ROWS UNBOUNDED PRECEDING) AS path, sum(close / 1e5 - 1.5) OVER ({W} ROWS UNBOUNDED PRECEDING) AS walk FROM r)"


def walks(spark, sf):
    from tideline.functions.layout import running_sum

    bars = priority_bars(spark, sf).select("asset", "ts", (F.col("close") / 1e5 - 1.5).alias("level"))
    return running_sum(bars, {"level": "walk"}).select("asset", "ts", "walk")


@query("stationarity", with_sql(CUMCLOSE, *_stationary_sql("a", "cc", "ret"), *_stationary_sql("b", "cc", "walk"),
    select=" UNION ALL ".join(f"SELECT asset, '{n}' AS series, n, {rnd('adf', 'adf', 4)}, {rnd('kpss', 'kpss', 5)}, {_VERDICT} AS conclusion FROM st{t}" for t, n in (("a", "ret"), ("b", "walk")))))
def stationarity(spark, sf):
    both = returns(priority_bars(spark, sf)).select("asset", "ts", "ret").join(walks(spark, sf), ["asset", "ts"])
    long = both.unpivot(["asset", "ts"], ["ret", "walk"], "series", "x")
    out = D.stationarity(long, "x", Series(keys=("asset", "series")))
    return shown(out, {"adf": 4, "kpss": 5}, ("asset", "series", "n", "conclusion"))


_ADF = (
    f"ad AS (SELECT asset, walk - lag(walk) OVER ({W}) AS d, lag(walk) OVER ({W}) AS b, lag(walk) OVER ({W}) - lag(walk, 2) OVER ({W}) AS e FROM cc)",
    "am AS (SELECT asset, count(*) AS n, var_pop(b) AS bb, var_pop(e) AS ee, covar_pop(b, e) AS be, covar_pop(b, d) AS bd, covar_pop(e, d) AS ed, var_pop(d) AS dd FROM ad WHERE e IS NOT NULL GROUP BY asset)",
    "af AS (SELECT *, bd / bb AS c0, (ee * bd - be * ed) / (bb * ee - be * be) AS c1, (bb * ed - be * bd) / (bb * ee - be * be) AS c2 FROM am)",
    "ar AS (SELECT *, n * (dd - c0 * bd) AS s0, n * (dd - c1 * bd - c2 * ed) AS s1 FROM af)",
    "aa AS (SELECT *, CASE WHEN n * ln(s1 / n) + 6 < n * ln(s0 / n) + 4 THEN 1 ELSE 0 END AS lag FROM ar)",
)


@query("adf_lags", with_sql(CUMCLOSE, *_ADF, select="SELECT asset, n, CAST(lag AS BIGINT) AS lag, "
    + rnd("CASE WHEN lag = 0 THEN c0 / sqrt(s0 / (n - 2) / (n * bb)) ELSE c1 / sqrt(s1 / (n - 3) * ee / (n * (bb * ee - be * be))) END", "adf", 5) + " FROM aa"))
def adf_lags(spark, sf):
    """Dickey-Fuller t with a lagged difference where AIC asks for it."""
    return shown(U.augmented_dickey_fuller(walks(spark, sf), "walk", most=1), {"adf": 5}, ("asset", "n", "lag"))


@query("differencing", with_sql(CUMCLOSE, f"df AS (SELECT asset, ts, walk AS d0, walk - lag(walk) OVER ({W}) AS d1, walk - 2 * lag(walk) OVER ({W}) + lag(walk, 2) OVER ({W}) AS d2 FROM cc)",
    *_stationary_sql("a", "df", "d0"), *_stationary_sql("b", "df", "d1"), *_stationary_sql("c", "df", "d2"),
    select="""SELECT asset, CASE WHEN (a.adf < -2.8621 AND a.kpss < 0.463) OR coalesce(b.n < 50, TRUE) THEN 0 WHEN (b.adf < -2.8621 AND b.kpss < 0.463) OR coalesce(c.n < 50, TRUE) THEN 1 ELSE 2 END AS d
  FROM sta a LEFT JOIN stb b USING (asset) LEFT JOIN stc c USING (asset)"""))
def differencing(spark, sf):
    return D.choose_differencing(walks(spark, sf), "walk")


_DECOMP = (
    f"tr AS (SELECT asset, ts, rn, rn % 12 AS phase, close / 1e5 AS x, CASE WHEN rn >= 6 AND rn < n - 6 THEN (sum(close / 1e5) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(close / 1e5, 6) OVER ({W}) + lead(close / 1e5, 6) OVER ({W})) / 2) / 12 END AS trend FROM r)",
    "ph AS (SELECT asset, phase, avg(x - trend) AS pm FROM tr GROUP BY 1, 2)",
    "ce AS (SELECT asset, avg(pm) AS pc FROM ph GROUP BY 1)",
    "dc AS (SELECT tr.asset, ts, phase, x, trend, pm - pc AS seasonal, x - trend - (pm - pc) AS residual FROM tr JOIN ph USING (asset, phase) JOIN ce ON ce.asset = tr.asset)",
)


def decomposed(spark, sf):
    bars = priority_bars(spark, sf).select("asset", "ts", (F.col("close") / 1e5).alias("x"))
    return D.decompose(bars, "x", 12)


@query("seasonal_decompose", with_sql(*_DECOMP, select=f"SELECT asset, ts, phase, {rnd('trend', 'trend')}, {rnd('seasonal', 'seasonal')}, {rnd('residual', 'residual')} FROM dc"))
def seasonal_decompose(spark, sf):
    return shown(decomposed(spark, sf), {c: 6 for c in ("trend", "seasonal", "residual")}, ("asset", "ts", "phase"))


@query("seasonal_strength", with_sql(*_DECOMP, select=f"SELECT asset, {rnd('var_pop(seasonal) / (var_pop(seasonal) + var_pop(residual))', 'seasonal_strength')}, {rnd('1 - var_pop(residual) / var_pop(x)', 'trend_strength')} FROM dc GROUP BY asset"))
def seasonal_strength(spark, sf):
    return shown(D.seasonal_strength(decomposed(spark, sf), "x"), {"seasonal_strength": 6, "trend_strength": 6}, ("asset",))


def _t_sql(z: float) -> str:
    g = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z}::DOUBLE + " + " + ".join(f"({c}::DOUBLE) / (n - 1) ** {i}" for i, c in enumerate(g, 1)) + ")"


_Z = {90: -1.2815515655446004, 95: -1.6448536269514722, 99: -2.3263478740408408}


@query("param_var", with_sql("s AS (SELECT asset, avg(ret) AS mean, stddev_pop(ret) AS std, count(ret) AS n FROM r GROUP BY asset)",
    select=f"SELECT asset, n, {rnd('mean', 'mean')}, {rnd('std', 'std')}, " + ", ".join(rnd(f"mean + {_t_sql(z)} * std", f"var_{k}") for k, z in _Z.items()) + " FROM s"))
def param_var(spark, sf):
    out = D.value_at_risk(returns(priority_bars(spark, sf)), "ret")
    return shown(out, {"mean": 6, "std": 6, "var_90": 6, "var_95": 6, "var_99": 6}, ("asset", "n"))


@query("hetero_test", with_sql(*PREDS, "bp AS (SELECT asset, model, regr_r2((y_true - y_pred) ** 2, y_pred) AS r2, count(*) AS n FROM preds GROUP BY 1, 2)",
    select=f"SELECT asset, model, n, {rnd('r2', 'r2')}, {rnd('n * r2', 'lm', 4)} FROM bp"))
def hetero_test(spark, sf):
    from tideline.models.linear import breusch_pagan

    rows = predictions_reg(spark, sf).withColumn("e", F.col("y_true") - F.col("y_pred"))
    return shown(breusch_pagan(rows, "e", ["y_pred"], ["asset", "model"]), {"r2": 6, "lm": 4}, ("asset", "model", "n"))
