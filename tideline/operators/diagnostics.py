"""Residual and series diagnostics from lagged products and partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.layout import DAILY, Series, over_series, running_sum, with_position
from tideline.functions.skew import join_stats
from tideline.functions.safe import adjusted_kurtosis, adjusted_skew, chi2_tail_even, corr, t_quantile

# Published 5% critical values (Dickey-Fuller with constant, KPSS level).
ADF_5 = -2.8621
KPSS_5 = 0.463


def residual_stats(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, adjusted skew and excess kurtosis."""
    n = F.count(x)
    return df.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        adjusted_skew(F.skewness(x), n).alias("skew"),
        adjusted_kurtosis(F.kurtosis(x), n).alias("kurtosis"),
    )


def _demeaned(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    rows = df.filter(F.col(x).isNotNull())
    means = rows.groupBy(*keys).agg(F.avg(x).alias("_mu"))
    return join_stats(rows, means, keys).withColumn("_e", F.col(x) - F.col("_mu"))


def _lagged(df: DataFrame, x: str, lags: int, series: Series) -> DataFrame:
    return over_series(df, lambda d, w: d.withColumns({f"_l{k}": F.lag(x, k).over(w) for k in range(1, lags + 1)}), series, lags)


def residual_tests(df: DataFrame, x: str, series: Series, lags: int = 10) -> DataFrame:
    """Ljung-Box (10 lags), Jarque-Bera, Durbin-Watson and autocorrelation at 1 and 5."""
    keys = list(series.keys)
    rows = _lagged(_demeaned(df, x, keys), "_e", lags, series)
    aggs = [F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_e") * F.col("_e")).alias("_c0"),
        F.sum(F.col(x) * F.col(x)).alias("_sq"),
        F.sum(F.pow(F.col("_e") - F.col("_l1"), F.lit(2))).alias("_dw"),
        F.skewness(x).alias("_s"),
        F.kurtosis(x).alias("_k"),
        *aggs,
    )
    n = F.col("n").cast("double")
    r = lambda k: F.try_divide(F.col(f"_c{k}"), F.col("_c0"))
    q = n * (n + 2) * sum((r(k) * r(k) / (n - k) for k in range(2, lags + 1)), r(1) * r(1) / (n - 1))
    jb = n / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)
    out = out.withColumn("ljung_box", q).withColumn("jarque_bera", jb)
    return out.select(
        *keys,
        "n",
        "ljung_box",
        chi2_tail_even("ljung_box", lags).alias("ljung_box_p"),
        "jarque_bera",
        F.exp(-F.col("jarque_bera") / 2).alias("jarque_bera_p"),
        F.try_divide(F.col("_dw"), F.col("_sq")).alias("durbin_watson"),
        r(1).alias("acf_1"),
        r(5).alias("acf_5"),
    )


def autocorrelation(df: DataFrame, x: str, series: Series, lags: int = 10) -> DataFrame:
    """(keys, lag, acf): correlation of the series with itself k rows back."""
    keys = list(series.keys)
    rows = _lagged(df, x, lags, series)
    wide = rows.groupBy(*keys).agg(*[corr(x, f"_l{k}").alias(f"_r{k}") for k in range(1, lags + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_r{k}").alias("acf")) for k in range(1, lags + 1)])
    return wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def stationarity(df: DataFrame, x: str, series: Series = DAILY, lags: int = 10) -> DataFrame:
    """Dickey-Fuller t (no lag terms) and KPSS level statistic against their 5% values.

    The KPSS variance uses Bartlett weights over a fixed number of lags.
    """
    keys = list(series.keys)
    rows = _lagged(_demeaned(df, x, keys), "_e", lags, series)
    rows = running_sum(rows, {"_e": "_cum"}, series)
    d, back = F.col("_e") - F.col("_l1"), F.col("_l1")
    dy, y1 = F.when(back.isNotNull(), d), back
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_e") * F.col("_e")).alias("_c0"),
        *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
        F.sum(F.col("_cum") * F.col("_cum")).alias("_ss"),
        F.regr_slope(dy, y1).alias("_b"),
        F.regr_sxx(dy, y1).alias("_sxx"),
        F.regr_syy(dy, y1).alias("_syy"),
        F.regr_count(dy, y1).alias("_m"),
    )
    n = F.col("n").cast("double")
    long_run = F.col("_c0") + sum((2.0 * (1 - k / (lags + 1)) * F.col(f"_c{k}") for k in range(2, lags + 1)), 2.0 * (1 - 1 / (lags + 1)) * F.col("_c1"))
    kpss = F.try_divide(F.col("_ss"), n * long_run)
    sse = F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx")
    adf = F.try_divide(F.col("_b"), F.sqrt(F.try_divide(sse / (F.col("_m") - 2), F.col("_sxx"))))
    out = out.withColumn("adf", adf).withColumn("kpss", kpss)
    a, k = F.col("adf") < ADF_5, F.col("kpss") < KPSS_5
    verdict = F.when(a & k, "stationary").when(~a & ~k, "non_stationary").otherwise("inconclusive")
    return out.select(*keys, "n", "adf", "kpss", verdict.alias("conclusion"), (a & k).alias("is_stationary"))


def differences(df: DataFrame, x: str, series: Series = DAILY) -> DataFrame:
    """Adds d0, d1, d2: the series and its first two differences."""

    def build(rows, w):
        lag = lambda k: F.lag(x, k).over(w)
        return rows.withColumns({"d0": F.col(x), "d1": F.col(x) - lag(1), "d2": F.col(x) - 2 * lag(1) + lag(2)})

    return over_series(df, build, series, 2).drop("_rn", "_n")


def choose_differencing(df: DataFrame, x: str, series: Series = DAILY, most: int = 2, least: int = 50) -> DataFrame:
    """(keys, d): fewest differences that make the series stationary, stopping when short."""
    keys = list(series.keys)
    orders = [f"d{d}" for d in range(most + 1)]
    diffs = differences(df.select(*keys, series.time, x), x, series).select(*keys, series.time, *orders)
    long = diffs.unpivot([*keys, series.time], orders, "_order", "_x").filter(F.col("_x").isNotNull())
    per_order = replace(series, keys=(*keys, "_order"))
    tested = stationarity(long, "_x", per_order)
    of = lambda d, c: F.max(F.when(F.col("_order") == f"d{d}", F.col(c)))
    cells = [of(d, c).alias(f"_{c}{d}") for d in range(most + 1) for c in ("is_stationary", "n")]
    pick = F.lit(most)
    for d in reversed(range(most)):
        short = F.coalesce(F.col(f"_n{d + 1}") < least, F.lit(True))
        pick = F.when(F.col(f"_is_stationary{d}") | short, F.lit(d)).otherwise(pick)
    return tested.groupBy(*keys).agg(*cells).select(*keys, pick.alias("d"))


def decompose(df: DataFrame, x: str, period: int, series: Series = DAILY) -> DataFrame:
    """Additive trend (centred mean, half weights at the ends for an even period), seasonal
    (mean of the detrended values per phase, centred) and residual. Edges have no trend."""
    keys, half = list(series.keys), period // 2

    def build(rows, w):
        frame = w.rowsBetween(-half, half)
        full = F.count(x).over(frame) == 2 * half + 1
        if period % 2:
            trend = F.avg(x).over(frame)
        else:
            inner = F.sum(x).over(w.rowsBetween(-half + 1, half - 1))
            trend = (inner + (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2) / period
        return rows.withColumn("trend", F.when(full, trend)).withColumn("phase", F.col("_rn") % period)

    rows = over_series(df, build, series, half, half).withColumn("_d", F.col(x) - F.col("trend"))
    phases = rows.groupBy(*keys, "phase").agg(F.avg("_d").alias("_pm"))
    centre = phases.groupBy(*keys).agg(F.avg("_pm").alias("_pc"))
    table = phases.join(centre, keys).select(*keys, "phase", (F.col("_pm") - F.col("_pc")).alias("seasonal"))
    out = join_stats(rows, table, [*keys, "phase"]).withColumn("residual", F.col("_d") - F.col("seasonal"))
    return out.select(*keys, series.time, x, "phase", "trend", "seasonal", "residual")


def seasonal_strength(parts: DataFrame, x: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Seasonal over seasonal plus residual variance, and one minus residual over total."""
    s, r, t = F.var_pop("seasonal"), F.var_pop("residual"), F.var_pop(x)
    zero = F.lit(0.0)
    return parts.groupBy(*keys).agg(
        F.coalesce(F.try_divide(s, s + r), zero).alias("seasonal_strength"),
        F.coalesce(1 - F.try_divide(r, t), zero).alias("trend_strength"),
    )


def value_at_risk(df: DataFrame, x: str, keys: Sequence[str] = ("asset",), levels: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """Parametric value at risk: mean plus t quantile times population deviation."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))
    cols = [(F.col("mean") + t_quantile(c, F.col("n") - 1) * F.col("std")).alias(f"var_{round(c * 100)}") for c in levels]
    return stats.select(*keys, "mean", "std", "n", *cols)
