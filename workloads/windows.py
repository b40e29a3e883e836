"""Window queries: features, indicators and targets on the priority bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.safe import rounded
from tideline.operators.features import features
from workloads.fixtures import (
    W,
    frame,
    priority_bars,
    rnd,
    roll,
    roll_corr,
    with_sql,
)
from workloads.registry import query

TS = 30


def shown(df: DataFrame, cols: dict[str, int], keep=("asset", "ts")) -> DataFrame:
    return df.select(*keep, *[rounded(c, d).alias(c) for c, d in cols.items()])


def _feature_query(name: str, modules: list[str], cols: dict[str, int], *ctes: str, exprs: dict[str, str], src: str = "r"):
    select = "SELECT asset, ts, " + ", ".join(rnd(exprs[c], c, d) for c, d in cols.items()) + f" FROM {src}"

    @query(name, with_sql(*ctes, select=select))
    def run(spark, sf):
        return shown(features(priority_bars(spark, sf), modules), cols)


def _int_query(name: str, modules: list[str], exprs: dict[str, str]):
    select = "SELECT asset, ts, " + ", ".join(f"CAST({e} AS INTEGER) AS {c}" for c, e in exprs.items()) + " FROM r"

    @query(name, with_sql(select=select))
    def run(spark, sf):
        return features(priority_bars(spark, sf), modules).select("asset", "ts", *[F.col(c).cast("int") for c in exprs])


SHIFTED = f"""s AS (SELECT *, lag(close, {TS}) OVER ({W}) AS p, lag(ret, {TS}) OVER ({W}) AS rs,
  lag(high, {TS}) OVER ({W}) AS h, lag(low, {TS}) OVER ({W}) AS l FROM r)"""
MEANS = f"s2 AS (SELECT *, {roll('avg', 'p', 10, 1)} AS ma10, {roll('avg', 'p', 50, 1)} AS ma50, {roll('avg', 'p', 20, 1)} AS bm, {roll('stddev_samp', 'p', 20, 1)} AS bs FROM s)"
MA_LAGS = f"s3 AS (SELECT *, lag(ma10, {TS}) OVER ({W}) AS ms, lag(ma50, {TS}) OVER ({W}) AS ml FROM s2)"

_feature_query("ma_shifted", ["technical"], {"ma10": 6, "ma50": 6, "ma_ratio": 6}, SHIFTED, MEANS, src="s2",
               exprs={"ma10": "ma10", "ma50": "ma50", "ma_ratio": "ma10 / ma50"})
_feature_query("roc", ["technical"], {"roc20": 6}, SHIFTED, src="s", exprs={"roc20": f"p / lag(p, {TS}) OVER ({W}) - 1"})
_feature_query("rolling_std", ["technical", "cached"], {"rolling_std30": 6, "volatility": 6}, SHIFTED,
               f"v AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS pc FROM s)", src="v",
               exprs={"rolling_std30": roll("stddev_samp", "rs", 30, 15), "volatility": roll('stddev_samp', 'pc', 20)})
_feature_query("ma_corr", ["technical"], {"corr_ma10": 6, "corr_ma50": 6}, SHIFTED, MEANS, MA_LAGS,
               f"s4 AS (SELECT *, {roll_corr('rs', 'ms', 10)} AS c10, {roll_corr('rs', 'ml', 50)} AS c50 FROM s3)", src="s4",
               exprs={"corr_ma10": "c10", "corr_ma50": "c50"})
_RSI = """CASE WHEN lo > 0 THEN 100 - 100 / (1 + g / lo) WHEN g > 0 THEN 100.0 END"""
_feature_query("rsi_simple", ["cached"], {"rsi_simple": 6},
               f"d AS (SELECT *, close - lag(close) OVER ({W}) AS d FROM r)",
               f"gl AS (SELECT *, {roll('avg', 'coalesce(greatest(d, 0), 0)', 14)} AS g, {roll('avg', 'coalesce(greatest(-d, 0), 0)', 14)} AS lo FROM d)",
               src="gl", exprs={"rsi_simple": _RSI})
_feature_query("rsi_shifted", ["technical"], {"rsi": 6}, SHIFTED,
               f"d AS (SELECT *, p - lag(p) OVER ({W}) AS d FROM s)",
               f"gl AS (SELECT *, avg(coalesce(greatest(d, 0), 0)) OVER {frame(14)} AS g, avg(coalesce(greatest(-d, 0), 0)) OVER {frame(14)} AS lo FROM d)",
               src="gl", exprs={"rsi": _RSI})
_FOLD = "list_reduce(list(p) FILTER (p IS NOT NULL) OVER (" + W + " ROWS UNBOUNDED PRECEDING), lambda a, v: a * (1 - {a}) + v * {a})"
_feature_query("macd", ["technical"], {"macd": 4}, SHIFTED,
               f"e AS (SELECT asset, ts, {_FOLD.format(a='2.0/13.0')} AS f, {_FOLD.format(a='2.0/27.0')} AS g FROM s)", src="e",
               exprs={"macd": "f - g"})
_feature_query("atr", ["technical"], {"atr": 4}, SHIFTED,
               f"t AS (SELECT *, greatest(h - l, abs(h - lag(p) OVER ({W})), abs(l - lag(p) OVER ({W}))) AS tr FROM s)", src="t",
               exprs={"atr": roll("avg", "tr", 14, 1)})
_feature_query("bollinger", ["technical"], {"bollinger_upper": 4, "bollinger_lower": 4}, SHIFTED, MEANS, src="s2",
               exprs={"bollinger_upper": "bm + 2 * bs", "bollinger_lower": "bm - 2 * bs"})

_VS = "s AS (SELECT *, " + ", ".join(f"lag(ret, {k + TS}) OVER ({W}) AS r{k}" for k in (5, 10, 20)) + " FROM r)"
_feature_query("vol_w", ["statistical"], {f"volatility_{k}d": 6 for k in (5, 10, 20)}, _VS, src="s",
               exprs={f"volatility_{k}d": f"({roll('stddev_samp', f'r{k}', k, k // 2)}) * sqrt(252.0)" for k in (5, 10, 20)})


def _moment_sql(kind: str, x: str, k: int) -> str:
    """Adjusted moments from centred power sums over the frame's values as a list."""
    v = f"list({x}) FILTER ({x} IS NOT NULL) OVER {frame(k)}"
    n = f"len({v})"
    power = lambda p: f"list_sum(list_transform({v}, lambda z: (z - list_avg({v})) ** {p}))"
    return v, n, power


def _moments_cte(name: str, src: str, ks=(5, 10, 20)) -> list[str]:
    lists = f"{name}_l AS (SELECT *, " + ", ".join(f"list(r{k}) FILTER (r{k} IS NOT NULL) OVER {frame(k)} AS v{k}" for k in ks) + f" FROM {src})"
    power = lambda k, p: f"list_sum(list_transform(v{k}, lambda z: (z - list_avg(v{k})) ** {p}))"
    sums = f"{name} AS (SELECT *, " + ", ".join(
        f"len(v{k}) AS n{k}, {power(k, 2)} AS a{k}, {power(k, 3)} AS b{k}, {power(k, 4)} AS c{k}" for k in ks
    ) + f" FROM {name}_l)"
    return [lists, sums]


def _skew(k):
    g1 = f"(b{k} / n{k}) / (a{k} / n{k}) ** 1.5"
    return f"CASE WHEN n{k} >= greatest(3, {k // 2}) AND a{k} > 0 THEN {g1} * sqrt(n{k} * (n{k} - 1.0)) / (n{k} - 2) END"


def _kurt(k):
    g2 = f"((c{k} / n{k}) / (a{k} / n{k}) ** 2 - 3)"
    return f"CASE WHEN n{k} >= greatest(4, {k // 2}) AND a{k} > 0 THEN ((n{k} + 1) * {g2} + 6) * (n{k} - 1.0) / ((n{k} - 2.0) * (n{k} - 3)) END"


_feature_query("skew_w", ["statistical"], {f"skew_{k}d": 5 for k in (5, 10, 20)}, _VS, *_moments_cte("m", "s"), src="m",
               exprs={f"skew_{k}d": _skew(k) for k in (5, 10, 20)})
_feature_query("kurt_w", ["statistical"], {f"kurt_{k}d": 5 for k in (5, 10, 20)}, _VS, *_moments_cte("m", "s"), src="m",
               exprs={f"kurt_{k}d": _kurt(k) for k in (5, 10, 20)})
_feature_query("lag_returns", ["lagged"], {f"lag{k}": 6 for k in (1, 2, 3, 5, 10)},
               exprs={f"lag{k}": f"lag(ret, {TS + k}) OVER ({W})" for k in (1, 2, 3, 5, 10)})
_NL = {"ret_abs": "abs(rs)", "ret_sq": "rs * rs"}
for _k in (5, 10, 20):
    _NL[f"ret_abs_mean_{_k}"] = roll("avg", "abs(rs)", _k, _k // 2)
    _NL[f"ret_sq_mean_{_k}"] = roll("avg", "rs * rs", _k, _k // 2)
_feature_query("nonlinear", ["nonlinear"], {c: 6 for c in _NL}, SHIFTED, src="s", exprs=_NL)
_feature_query("momentum", ["performance"], {f"momentum_{k}": 6 for k in (5, 10, 20)},
               exprs={f"momentum_{k}": f"close / lag(close, {k}) OVER ({W}) - 1" for k in (5, 10, 20)})
_PC = f"pc AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS pc, volume / lag(volume) OVER ({W}) - 1 AS vc FROM r)"
_feature_query("vol_cluster", ["performance"], {"vol_cluster_5": 6, "vol_cluster_10": 6}, _PC, src="pc",
               exprs={f"vol_cluster_{k}": roll("stddev_samp", "pc", k) for k in (5, 10)})
_feature_query("mean_reversion", ["performance"], {"mean_reversion_5": 6, "mean_reversion_10": 6},
               exprs={f"mean_reversion_{k}": f"(close - ({roll('avg', 'close', k)})) / nullif({roll('stddev_samp', 'close', k)}, 0)" for k in (5, 10)})
_feature_query("trend_strength", ["performance"], {"trend_strength_5": 4, "trend_strength_10": 4},
               exprs={f"trend_strength_{k}": f"CASE WHEN count(close) OVER {frame(k)} >= {k} THEN regr_slope(close, rn) OVER {frame(k)} END" for k in (5, 10)})
_feature_query("price_impact", ["performance"], {"price_impact": 6}, _PC, src="pc", exprs={"price_impact": "pc / nullif(vc, 0)"})
_feature_query("volume_price_trend", ["performance"], {"volume_price_trend": 6}, _PC, src="pc",
               exprs={"volume_price_trend": f"CASE WHEN count(pc) OVER {frame(5)} >= 5 AND min(volume) OVER {frame(5)} < max(volume) OVER {frame(5)} THEN corr(volume, pc) OVER {frame(5)} END"})
_feature_query("log_return", ["cached"], {"log_returns": 6}, exprs={"log_returns": "ret"})
_feature_query("pct_change", ["cached"], {"returns": 6}, exprs={"returns": f"close / lag(close) OVER ({W}) - 1"})
_feature_query("sma", ["cached"], {"sma_20": 4, "sma_50": 4},
               exprs={"sma_20": roll("avg", "close", 20), "sma_50": roll("avg", "close", 50)})
_int_query("calendar_features", ["calendar"],
           {"day_of_week": "isodow(ts) - 1", "month_of_year": "month(ts)", "quarter": "quarter(ts)", "day_of_year": "dayofyear(ts)"})

# ---- labels and targets ---------------------------------------------------------------

_feature_query("realised_vol", ["realised"], {"realised_vol": 5}, "s AS (SELECT *, ret * 100 AS r100 FROM r)", src="s",
               exprs={"realised_vol": f"({roll('stddev_samp', 'r100', 5, 2)}) * sqrt(252.0)"})
_feature_query("proxy_vol", ["realised"], {"proxy_vol": 6}, exprs={"proxy_vol": f"({roll('stddev_samp', 'ret', 20, 10)}) * sqrt(252.0)"})
VOL5 = f"v AS (SELECT *, ({roll('stddev_samp', 'ret', 5)}) * sqrt(252.0) AS vol5 FROM r)"
TARGET = f"t AS (SELECT *, lead(vol5, 5) OVER ({W}) AS y FROM v)"
_feature_query("target_vol5", ["targets"], {"target_vol5": 6}, VOL5, TARGET, src="t", exprs={"target_vol5": "y"})
_feature_query("log_target", ["targets"], {"target_vol5_log": 6}, VOL5, TARGET, src="t",
               exprs={"target_vol5_log": "CASE WHEN y IS NOT NULL THEN ln(greatest(y, 0) + 1e-6) END"})
_feature_query("target_next", ["targets"], {"next_return": 6, "next_close": 2},
               exprs={"next_return": f"lead(close) OVER ({W}) / close - 1", "next_close": f"lead(close) OVER ({W})"})
_SIMPLE = {"target_volatility": f"lead(sd5, 5) OVER ({W})", "target_return": f"lead(pc, 5) OVER ({W})"}


@query("target_simple", with_sql(
    f"a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS pc FROM r)",
    f"b AS (SELECT *, {roll('stddev_samp', 'pc', 5)} AS sd5 FROM a)",
    select="SELECT asset, ts, " + ", ".join(rnd(e, c) for c, e in _SIMPLE.items())
    + f", CASE WHEN lead(pc, 5) OVER ({W}) > 0 THEN 1 ELSE 0 END AS target_direction FROM b"))
def target_simple(spark, sf):
    df = features(priority_bars(spark, sf), ["simple_targets"])
    return shown(df, {c: 6 for c in _SIMPLE}, ("asset", "ts", "target_direction"))


@query("updown_label", with_sql(select=f"""SELECT asset, ts, CASE WHEN lead(ret, 5) OVER ({W}) > 0 THEN 1 ELSE 0 END AS up_5,
  CASE WHEN lead(ret, 10) OVER ({W}) > 0 THEN 1 ELSE 0 END AS up_10 FROM r"""))
def updown_label(spark, sf):
    return features(priority_bars(spark, sf), ["simple_targets"]).select("asset", "ts", "up_5", "up_10")


_LP = {f"return_t_{n}": f"lag(pc, {n}) OVER ({W})" for n in (1, 2, 3, 5, 10)}
_LP |= {f"price_t_{n}": f"lag(close, {n}) OVER ({W}) / last_close - 1" for n in (1, 2, 3, 5, 10)}
_LP |= {f"ma_{k}": f"({roll('avg', 'close', k)}) / close - 1" for k in (30, 60)}


@query("lag_prices", with_sql(
    f"a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS pc, arg_max(close, ts) OVER (PARTITION BY asset) AS last_close FROM r)",
    "b AS (SELECT asset, ts, " + ", ".join(f"{e} AS {c}" for c, e in _LP.items()) + " FROM a)",
    select="SELECT asset, ts, " + ", ".join(rnd(c, c) for c in _LP) + " FROM b WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _LP)))
def lag_prices_query(spark, sf):
    from tideline.operators.features import lag_prices

    return shown(lag_prices(priority_bars(spark, sf)), {c: 6 for c in _LP})


def _regime_sql(x: str, up: str, down: str, name: str, guard: str = "ret") -> str:
    return f"CASE WHEN {guard} IS NULL THEN NULL WHEN {x} > {up} THEN 'Bull' WHEN {x} < {down} THEN 'Bear' ELSE 'Sideways' END AS {name}"


SLOPE = f"cum AS (SELECT *, sum(ret) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum FROM r WHERE ret IS NOT NULL)"
SLOPE2 = f"slope AS (SELECT *, CASE WHEN count(*) OVER {frame(60)} >= 30 THEN regr_slope(cum, rn) OVER {frame(60)} END AS slope FROM cum)"
REGIME = f"regime AS (SELECT asset, ts, rn, {_regime_sql('slope', '0.1 / 60', '-0.1 / 60', 'regime')} FROM slope)"


@query("regime_slope", with_sql(SLOPE, SLOPE2, REGIME, select="SELECT r.asset, r.ts, regime FROM r LEFT JOIN regime USING (asset, ts)"))
def regime_slope(spark, sf):
    return features(priority_bars(spark, sf), ["regimes"]).select("asset", "ts", "regime")


@query("regime_code", with_sql(SLOPE, SLOPE2, REGIME, select="""SELECT r.asset, r.ts,
  CASE regime WHEN 'Bear' THEN 0 WHEN 'Sideways' THEN 1 WHEN 'Bull' THEN 2 END AS regime_code FROM r LEFT JOIN regime USING (asset, ts)"""))
def regime_code_query(spark, sf):
    return features(priority_bars(spark, sf), ["regimes"]).select("asset", "ts", "regime_code")


@query("regime_threshold", with_sql(
    f"s AS (SELECT *, CASE WHEN count(ret) OVER {frame(60)} >= 30 THEN sum(ret) OVER {frame(60)} END AS total, {roll('sum', 'ret', 60)} AS strict FROM r)",
    select=f"SELECT asset, ts, {_regime_sql('total', '0.1', '-0.1', 'regime_threshold')}, {_regime_sql('strict', '0.1', '-0.1', 'regime_strict', 'strict')} FROM s"))
def regime_threshold(spark, sf):
    return features(priority_bars(spark, sf), ["regimes"]).select("asset", "ts", "regime_threshold", "regime_strict")


@query("regime_volq", with_sql(
    f"s AS (SELECT *, ({roll('stddev_samp', 'ret', 20)}) * sqrt(252.0) AS vol FROM r)",
    f"q AS (SELECT *, CASE WHEN count(vol) OVER {frame(60)} >= 30 THEN quantile_cont(vol, 0.33) OVER {frame(60)} END AS q33, "
    f"CASE WHEN count(vol) OVER {frame(60)} >= 30 THEN quantile_cont(vol, 0.67) OVER {frame(60)} END AS q67 FROM s)",
    select="""SELECT asset, ts, CASE WHEN vol <= q33 THEN 'Bull' WHEN vol >= q67 THEN 'Bear'
  WHEN vol > q33 AND vol < q67 THEN 'Sideways' END AS regime_by_vol FROM q"""))
def regime_volq(spark, sf):
    return features(priority_bars(spark, sf), ["regimes"]).select("asset", "ts", "regime_by_vol")


@query("regime_quantile_label", with_sql(VOL5, TARGET,
    "q AS (SELECT asset, quantile_cont(vol5, 0.33) AS q33, quantile_cont(vol5, 0.67) AS q67 FROM v GROUP BY asset)",
    select="SELECT asset, ts, CASE WHEN y <= q33 THEN 0 WHEN y <= q67 THEN 1 WHEN y IS NOT NULL THEN 2 END AS label FROM t JOIN q USING (asset)"))
def regime_quantile_label(spark, sf):
    from tideline.operators.labels import quantile_labels

    df = features(priority_bars(spark, sf), ["targets"])
    return quantile_labels(df, "target_vol5", "vol5").select("asset", "ts", "label")


@query("vol_quartile", with_sql(VOL5,
    "q AS (SELECT asset, quantile_cont(vol5, 0.25) AS q1, quantile_cont(vol5, 0.5) AS q2, quantile_cont(vol5, 0.75) AS q3 FROM v GROUP BY asset)",
    select="SELECT asset, ts, CASE WHEN vol5 <= q1 THEN 'Q1' WHEN vol5 <= q2 THEN 'Q2' WHEN vol5 <= q3 THEN 'Q3' WHEN vol5 IS NOT NULL THEN 'Q4' END AS quartile FROM v JOIN q USING (asset)"))
def vol_quartile(spark, sf):
    from tideline.operators.labels import quartile_labels

    return quartile_labels(features(priority_bars(spark, sf), ["targets"]), "vol5").select("asset", "ts", "quartile")


@query("vol_to_class", with_sql(VOL5,
    "q AS (SELECT asset, median(vol5) AS thr, stddev_pop(vol5) AS sc FROM v GROUP BY asset)",
    "p AS (SELECT asset, ts, 1.0 / (1.0 + exp((vol5 - thr) / (sc + 1e-9))) AS prob FROM v JOIN q USING (asset))",
    select=f"SELECT asset, ts, {rnd('prob', 'prob')}, CASE WHEN prob < 0.33 THEN 0 WHEN prob < 0.67 THEN 1 WHEN prob IS NOT NULL THEN 2 ELSE 1 END AS vol_class FROM p"))
def vol_to_class(spark, sf):
    from tideline.operators.labels import volatility_classes

    df = volatility_classes(features(priority_bars(spark, sf), ["targets"]), "vol5")
    return shown(df, {"prob": 6}, ("asset", "ts", "vol_class"))


@query("seq_window", with_sql(
    f"s AS (SELECT asset, ts, rn, list(close) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x, lead(close) OVER ({W}) / close - 1 AS y FROM r)",
    select=f"""SELECT asset, ts, rn, list_aggregate(list_transform(x, lambda v: printf('%.2f', v)), 'string_agg', '|') AS x_seq, {rnd('y', 'y')} FROM s WHERE len(x) = 10"""))
def seq_window(spark, sf):
    from tideline.operators.features import sequences

    df = sequences(priority_bars(spark, sf), 10)
    nxt = features(priority_bars(spark, sf), ["targets"]).select("asset", "ts", "next_return")
    text = F.array_join(F.transform("x_seq", lambda v: F.format_string("%.2f", v)), "|")
    return df.drop("y").join(nxt, ["asset", "ts"]).select("asset", "ts", "rn", text.alias("x_seq"), rounded("next_return").alias("y"))


@query("seq_features", with_sql(
    f"s AS (SELECT asset, ts, rn, flatten(list([close, CAST(volume AS DOUBLE)]) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS x, lead(close) OVER ({W}) AS y FROM r)",
    select="SELECT asset, ts, rn, list_aggregate(list_transform(x, lambda v: printf('%.2f', v)), 'string_agg', '|') AS x_seq, y FROM s WHERE len(x) = 10"))
def seq_features(spark, sf):
    from tideline.operators.features import sequences

    df = sequences(priority_bars(spark, sf), 5, ["close", "volume"], F.lead("close", 1))
    text = F.array_join(F.transform("x_seq", lambda v: F.format_string("%.2f", v)), "|")
    return df.select("asset", "ts", "rn", text.alias("x_seq"), "y")


@query("shift", with_sql(select=f"SELECT asset, ts, lag(close, 30) OVER ({W}) AS close_30, {rnd(f'lag(ret, 30) OVER ({W})', 'ret_30')} FROM r"))
def shift(spark, sf):
    from tideline.functions.layout import over_series
    from tideline.operators.align import returns

    bars = priority_bars(spark, sf)
    df = over_series(returns(bars), lambda d, w: d.withColumns({"close_30": F.lag("price", 30).over(w), "ret_30": F.lag("ret", 30).over(w)}), lookback=30)
    return df.select("asset", "ts", "close_30", rounded("ret_30").alias("ret_30"))


@query("row_position", with_sql(select="SELECT asset, ts, rn, n FROM r"))
def row_position(spark, sf):
    from tideline.functions.layout import with_position

    return with_position(priority_bars(spark, sf)).select("asset", "ts", "rn", "n")


@query("cumsum", with_sql(select=f"SELECT asset, ts, {rnd(f'CASE WHEN ret IS NOT NULL THEN sum(ret) OVER ({W} ROWS UNBOUNDED PRECEDING) END', 'cum')} FROM r"))
def cumsum(spark, sf):
    from tideline.functions.layout import running_sum
    from tideline.operators.align import returns

    return shown(running_sum(returns(priority_bars(spark, sf)), {"ret": "cum"}), {"cum": 6})


@query("ewm", with_sql(SHIFTED, f"e AS (SELECT asset, ts, {_FOLD.format(a='2.0/13.0')} AS f, {_FOLD.format(a='2.0/27.0')} AS g FROM s)",
                       select=f"SELECT asset, ts, {rnd('f', 'ewm_12', 4)}, {rnd('g', 'ewm_26', 4)} FROM e"))
def ewm(spark, sf):
    from tideline.config import FeatureSettings
    from tideline.functions.layout import over_series
    from tideline.operators.features import Context, _merge, ewm_lookback, ewm_stages

    def build(rows, w):
        c = Context(w, FeatureSettings())
        rows = rows.withColumn("p", F.lag("close", TS).over(w))
        for stage in _merge([ewm_stages(c, "p", 12, TS, "ewm_12"), ewm_stages(c, "p", 26, TS, "ewm_26")]):
            rows = rows.withColumns(stage)
        return rows

    return shown(over_series(priority_bars(spark, sf), build, lookback=TS + ewm_lookback(26)), {"ewm_12": 4, "ewm_26": 4})


@query("flagship", with_sql(VOL5, TARGET, SLOPE, SLOPE2, REGIME, f"vw AS (SELECT *, lag(ret, {20 + TS}) OVER ({W}) AS r20 FROM t)",
    f"vv AS (SELECT *, ({roll('stddev_samp', 'r20', 20, 10)}) * sqrt(252.0) AS v20 FROM vw)",
    select=f"SELECT vv.asset, vv.ts, {rnd('ret', 'ret')}, {rnd('v20', 'volatility_20d')}, {rnd('y', 'target_vol5')}, regime FROM vv LEFT JOIN regime USING (asset, ts)"))
def flagship(spark, sf):
    df = features(priority_bars(spark, sf), ["statistical", "targets", "regimes", "cached"])
    return shown(df.withColumnRenamed("log_returns", "ret"), {"ret": 6, "volatility_20d": 6, "target_vol5": 6}, ("asset", "ts", "regime"))
