"""Feature modules: functions that return Column expressions in stages.

A module lists stages of named columns; stage k may read the columns of the stages before
it (window functions do not nest). All modules share one window, so a run of any number of
modules is one shuffle and one sort. Names starting with ``_`` are helpers and dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.config import FeatureSettings
from tideline.functions.layout import DAILY, Series, over_series
from tideline.functions.skew import join_stats
from tideline.functions.safe import (
    ANNUAL,
    adjusted_kurtosis,
    adjusted_skew,
    last_rows,
    ratio,
    rolling,
    rolling_corr,
    safe_log,
    so_far,
)

Stages = list[dict[str, Column]]


@dataclass(frozen=True)
class Context:
    w: WindowSpec
    cfg: FeatureSettings
    series: Series = DAILY

    def shift(self, x: str, n: int) -> Column:
        return F.lag(x, n).over(self.w) if n else F.col(x)


@dataclass(frozen=True)
class Module:
    """A pluggable feature module; ``build(ctx)`` gives stages, ``needs`` its input columns."""

    name: str
    build: Callable[[Context], Stages]
    lookback: Callable[[FeatureSettings], int]
    needs: tuple[str, ...] = ("close",)
    lookahead: Callable[[FeatureSettings], int] = lambda cfg: 0


def price_column(df: DataFrame) -> Column:
    """Adjusted close where the table has that column, else close."""
    return F.col("adj_close") if "adj_close" in df.columns else F.col("close")


def log_return(c: Context) -> Column:
    return safe_log(ratio("price", F.lag("price", 1).over(c.w)))


def pct_change(x: str, n: int, w: WindowSpec) -> Column:
    """x over its value n rows back, minus one (x without gaps; fill first where it has)."""
    return ratio(x, F.lag(x, n).over(w)) - 1


# ---- single technical columns -------------------------------------------------------


def rsi_stages(c: Context, price: str, period: int, min_rows: int, out: str) -> Stages:
    """RSI from simple means of gains and losses; NULL where both are zero.

    A missing difference counts as no move (``greatest`` skips NULL).
    """
    d = f"_d_{out}"
    delta = F.col(price) - F.lag(price, 1).over(c.w)
    up, down = F.greatest(F.col(d), F.lit(0.0)), F.greatest(-F.col(d), F.lit(0.0))
    gain, loss = f"_g_{out}", f"_l_{out}"
    strength = (
        F.when(F.col(loss) > 0, 100 - F.try_divide(F.lit(100.0), 1 + ratio(gain, loss)))
        .when(F.col(gain) > 0, F.lit(100.0))
    )
    return [
        {d: delta},
        {f"_u_{out}": up, f"_w_{out}": down},
        {gain: rolling(F.avg, f"_u_{out}", c.w, period, min_rows), loss: rolling(F.avg, f"_w_{out}", c.w, period, min_rows)},
        {out: strength},
    ]


_BLOCK = 128


def ewm_stages(c: Context, x: str, span: int, first_row: int, out: str) -> Stages:
    """Exponential mean, adjust=False, as sums over blocks of 128 positions.

    A value g rows after the one before it keeps d^g / (alpha + d^g) of the old mean, so a row without a value carries
    the mean and older values still lose weight. Inside a block the mean is a running sum of values over their running
    product of kept shares; the state entering a block is built from the ends of the blocks before it until their
    weight is below 1e-16. A run without values that is longer than the look-back has no mean at its end. Values before position ``first_row`` are left out, and the first value has weight one.
    """
    alpha = 2.0 / (span + 1.0)
    d = 1.0 - alpha
    value = F.when(F.col("_rn") >= first_row, F.col(x))
    if d == 0.0:
        return [{out: F.last(value, ignorenulls=True).over(so_far(c.w))}]
    back = 1
    while d ** (_BLOCK * back) > 1e-16:
        back += 1
    blk = F.floor(F.col("_rn") / _BLOCK)
    in_block = so_far(Window.partitionBy(*c.series.keys, "_chunk", blk).orderBy(c.series.time))
    at_end = F.col("_rn") % _BLOCK == _BLOCK - 1
    here = F.when(value.isNotNull(), F.col("_rn"))
    gap, share, near, far = f"_g_{out}", f"_k_{out}", f"_b_{out}", f"_a_{out}"
    part, whole, carry, mark = f"_s_{out}", f"_f_{out}", f"_c_{out}", f"_m_{out}"
    old = F.pow(F.lit(d), F.col(gap))
    ends = F.coalesce(F.col(part), F.lit(0.0))
    for i in range(1, back + 1):
        ends = ends + F.coalesce(F.lag(part, _BLOCK * i).over(c.w) * F.exp(F.col(far) - F.lag(far, _BLOCK * i).over(c.w)), F.lit(0.0))
    recent = c.w.rowsBetween(-_BLOCK, -1)
    state = F.coalesce(F.col(part), F.lit(0.0)) + F.coalesce(F.col(carry) * F.exp(F.col(far) - F.col(mark)), F.lit(0.0))
    return [
        {gap: F.col("_rn") - F.last(here, ignorenulls=True).over(c.w.rowsBetween(Window.unboundedPreceding, -1))},
        # logarithm of the kept share; rows without a value keep all
        # (below e^-300 none is kept)
        {share: F.when(value.isNotNull() & F.col(gap).isNotNull(), F.greatest(F.col(gap) * math.log(d) - F.log(alpha + old), F.lit(-300.0))).otherwise(F.lit(0.0))},
        {near: F.sum(share).over(in_block), far: F.sum(share).over(so_far(c.w))},
        {part: F.exp(F.col(near)) * F.sum(value * F.coalesce(alpha / (alpha + old), F.lit(1.0)) * F.exp(-F.col(near))).over(in_block)},
        {whole: F.when(at_end, ends), mark: F.when(at_end, F.col(far))},
        {carry: F.last(whole, ignorenulls=True).over(recent), mark: F.last(mark, ignorenulls=True).over(recent)},
        {out: F.when(value.isNotNull(), state)},
        {out: F.last(out, ignorenulls=True).over(so_far(c.w))},
    ]


def ewm_lookback(span: int) -> int:
    d, back = 1.0 - 2.0 / (span + 1.0), 1
    while d ** (_BLOCK * back) > 1e-16:
        back += 1
    return _BLOCK * (back + 2)


def _merge(parts: Iterable[Stages]) -> Stages:
    merged: Stages = []
    for stages in parts:
        for i, stage in enumerate(stages):
            if i == len(merged):
                merged.append({})
            merged[i].update(stage)
    return merged


def _later(stages: Stages, by: int) -> Stages:
    return [{} for _ in range(by)] + stages


# ---- modules -------------------------------------------------------------------------


def technical(c: Context) -> Stages:
    """RSI, MACD, ATR, Bollinger bands, moving averages, ROC, rolling std, MA correlation."""
    cfg, w, ts = c.cfg, c.w, c.cfg.separation
    s, l = cfg.ma_short, cfg.ma_long
    base: Stages = [
        {
            "_p": c.shift("price", ts),
            "_r": c.shift("ret", ts),
            "_h": c.shift("high", ts),
            "_lo_p": c.shift("low", ts),
            "_cl": c.shift("close", ts),
        }
    ]
    prev = F.lag("_cl", 1).over(w)
    range_ = F.greatest(
        F.col("_h") - F.col("_lo_p"), F.abs(F.col("_h") - prev), F.abs(F.col("_lo_p") - prev)
    )
    n = cfg.bollinger_period
    means: Stages = [
        {
            "_tr": range_,
            f"ma{s}": rolling(F.avg, "_p", w, s, 1),
            f"ma{l}": rolling(F.avg, "_p", w, l, 1),
            "_bm": rolling(F.avg, "_p", w, n, 1),
            "_bs": rolling(F.stddev_samp, "_p", w, n, 1),
            "roc20": pct_change("_p", ts, w) if ts else F.lit(0.0),
            "rolling_std30": rolling(F.stddev_samp, "_r", w, 30, 15),
        },
        {
            "atr": rolling(F.avg, "_tr", w, cfg.atr_period, 1),
            "bollinger_upper": F.col("_bm") + F.col("_bs") * cfg.bollinger_std,
            "bollinger_lower": F.col("_bm") - F.col("_bs") * cfg.bollinger_std,
            "ma_ratio": ratio(f"ma{s}", f"ma{l}"),
            "_ms": c.shift(f"ma{s}", ts),
            "_ml": c.shift(f"ma{l}", ts),
        },
        {
            f"corr_ma{s}": rolling_corr("_r", "_ms", w, s),
            f"corr_ma{l}": rolling_corr("_r", "_ml", w, l),
        },
    ]
    macd = _merge([ewm_stages(c, "_p", cfg.macd_fast, ts, "_fast"), ewm_stages(c, "_p", cfg.macd_slow, ts, "_slow")])
    macd.append({"macd": F.col("_fast") - F.col("_slow")})
    parts = [means, rsi_stages(c, "_p", cfg.rsi_period, 1, "rsi"), macd]
    return _merge([base, *[_later(p, 1) for p in parts]])


def _technical_lookback(cfg: FeatureSettings) -> int:
    return 2 * cfg.separation + 2 * cfg.ma_long + 40 + ewm_lookback(cfg.macd_slow)


def statistical(c: Context) -> Stages:
    """Annualised volatility, skew and excess kurtosis of returns shifted by window + separation."""
    # Frames are re-read for every row, so each aggregate costs its frame length per row: one
    # count and four plain sums of powers serve all three columns. Returns lie about zero, so
    # powers about zero lose no digits; a spread below 1e-12 of the square counts as none.
    first, powers, sums, central, out = {}, {}, {}, {}, {}
    for k in c.cfg.volatility_windows:
        x, frame = f"_x{k}", last_rows(c.w, k)
        first[x] = c.shift("ret", k + c.cfg.separation)
        powers |= {f"{x}_{p}": F.col(x) ** p for p in (2, 3, 4)}
        sums[f"_n{x}"] = F.count(x).over(frame)
        mean = lambda p, x=x, frame=frame: F.avg(x if p == 1 else f"{x}_{p}").over(frame)
        sums |= {f"_e{p}{x}": mean(p) for p in (1, 2, 3, 4)}
        n, e1, e2, e3, e4 = (F.col(f"{name}{x}") for name in ("_n", "_e1", "_e2", "_e3", "_e4"))
        spread = e2 - e1 * e1
        central |= {
            f"_m2{x}": F.when(spread > e2 * 1e-12, spread).when(e2.isNotNull(), 0.0),
            f"_m3{x}": e3 - 3 * e1 * e2 + 2 * e1**3,
            f"_m4{x}": e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1**4,
        }
        m2, m3, m4 = (F.col(f"_m{p}{x}") for p in (2, 3, 4))
        enough = n >= k // 2
        out[f"volatility_{k}d"] = F.when(enough & (n > 1), F.sqrt(F.try_divide(m2 * n, n - 1)) * ANNUAL)
        skewed = enough & (m2 > 0)
        out[f"skew_{k}d"] = F.when(skewed, adjusted_skew(F.try_divide(m3, m2**1.5), n))
        out[f"kurt_{k}d"] = F.when(skewed, adjusted_kurtosis(F.try_divide(m4, m2 * m2) - 3, n))
    return [first, powers, sums, central, out]


def calendar(c: Context) -> Stages:
    """Monday-based weekday, month, quarter and day of the year."""
    t = F.col(c.series.time)
    return [
        {
            "day_of_week": F.weekday(t),
            "month_of_year": F.month(t),
            "quarter": F.quarter(t),
            "day_of_year": F.dayofyear(t),
        }
    ]


def lagged(c: Context) -> Stages:
    """Returns lagged by separation + n."""
    return [{f"lag{n}": c.shift("ret", c.cfg.separation + n) for n in c.cfg.lags}]


def nonlinear(c: Context) -> Stages:
    """Absolute and squared shifted returns with their rolling means."""
    means = {}
    for k in (5, 10, 20):
        means[f"ret_abs_mean_{k}"] = rolling(F.avg, "ret_abs", c.w, k, max(1, k // 2))
        means[f"ret_sq_mean_{k}"] = rolling(F.avg, "ret_sq", c.w, k, max(1, k // 2))
    shifted = c.shift("ret", c.cfg.separation)
    return [{"ret_abs": F.abs(shifted), "ret_sq": shifted * shifted}, means]


def performance(c: Context) -> Stages:
    """Momentum, volatility clustering, mean reversion, trend and volume columns (unshifted)."""
    w = c.w
    first = {f"momentum_{k}": pct_change("price", k, w) for k in (5, 10, 20)}
    first |= {"_pc": pct_change("price", 1, w), "_vc": pct_change("volume", 1, w)}
    for k in (5, 10):
        mean, std = rolling(F.avg, "price", w, k), rolling(F.stddev_samp, "price", w, k)
        first[f"mean_reversion_{k}"] = ratio(F.col("price") - mean, std)
        full = F.count("price").over(last_rows(w, k)) >= k
        slope = F.regr_slope(F.col("price"), F.col("_rn").cast("double")).over(last_rows(w, k))
        first[f"trend_strength_{k}"] = F.when(full, slope)
    second = {f"vol_cluster_{k}": rolling(F.stddev_samp, "_pc", w, k) for k in (5, 10)}
    second["price_impact"] = ratio("_pc", "_vc")
    enough = F.count(F.when(F.col("_pc").isNotNull(), F.col("volume"))).over(last_rows(w, 5)) >= 5
    second["volume_price_trend"] = F.when(enough, rolling_corr("volume", "_pc", w, 5))
    return [first, second]


def realised(c: Context) -> Stages:
    """Five-row annualised deviation of percent log returns, and a 20-row market proxy."""
    return [
        {
            "_r100": F.col("ret") * 100,
            "proxy_vol": rolling(F.stddev_samp, "ret", c.w, 20, 10) * ANNUAL,
        },
        {"realised_vol": rolling(F.stddev_samp, "_r100", c.w, 5, 2) * ANNUAL},
    ]


def targets(c: Context) -> Stages:
    """Volatility of the next five rows (plain and logged), next return and next close."""
    vol = rolling(F.stddev_samp, "ret", c.w, 5) * ANNUAL
    ahead = F.lead("vol5", 5).over(c.w)
    return [
        {"vol5": vol, "next_close": F.lead("price", 1).over(c.w)},
        {"target_vol5": ahead, "next_return": ratio("next_close", "price") - 1},
        {"target_vol5_log": log_volatility("target_vol5", c.cfg.log_epsilon)},
    ]


def simple_targets(c: Context) -> Stages:
    """Volatility, return and direction five rows ahead; a missing future counts as not up."""
    h = 5
    return [
        {"_pc": pct_change("close", 1, c.w)},
        {"_sd5": rolling(F.stddev_samp, "_pc", c.w, 5)},
        {
            "target_volatility": F.lead("_sd5", h).over(c.w),
            "target_return": F.lead("_pc", h).over(c.w),
            "target_direction": F.coalesce(F.lead("_pc", h).over(c.w) > 0, F.lit(False)).cast("int"),
            "up_5": F.coalesce(F.lead("ret", 5).over(c.w) > 0, F.lit(False)).cast("int"),
            "up_10": F.coalesce(F.lead("ret", 10).over(c.w) > 0, F.lit(False)).cast("int"),
        },
    ]


def regimes(c: Context) -> Stages:
    """Bull/Bear/Sideways by slope of cumulative returns, by their sum, and by volatility rank.

    The slope is unchanged by a constant, so the running sum may start at the chunk. A row
    without a return has no label.
    """
    cfg, k = c.cfg, max(5, c.cfg.regime_window)
    least = max(5, k // 2)
    frame = last_rows(c.w, k)
    enough = F.count("ret").over(frame) >= least

    def label(x: str, up: float, down: float) -> Column:
        side = F.when(F.col(x) > up, "Bull").when(F.col(x) < down, "Bear").otherwise("Sideways")
        return F.when(F.col("ret").isNotNull(), side)

    strict = F.when(F.col("_sum_all") > cfg.bull_threshold, "Bull").when(F.col("_sum_all") < cfg.bear_threshold, "Bear")
    strict = strict.when(F.col("_sum_all").isNotNull(), "Sideways")
    least_v = max(10, k // 2)
    enough_v = F.count("_vol").over(frame) >= least_v
    by_vol = F.when(F.col("_vol") <= F.col("_q33"), "Bull").when(F.col("_vol") >= F.col("_q67"), "Bear")
    by_vol = by_vol.when((F.col("_vol") > F.col("_q33")) & (F.col("_vol") < F.col("_q67")), "Sideways")
    return [
        {
            "_cum": F.when(F.col("ret").isNotNull(), F.sum("ret").over(so_far(c.w))),
            "_sum": F.when(enough, F.sum("ret").over(frame)),
            "_sum_all": rolling(F.sum, "ret", c.w, k),
            "_vol": rolling(F.stddev_samp, "ret", c.w, 20) * ANNUAL,
        },
        {
            "_slope": F.when(enough, F.regr_slope(F.col("_cum"), F.col("_rn").cast("double")).over(frame)),
            "_q33": F.when(enough_v, F.percentile(F.col("_vol"), F.lit(0.33)).over(frame)),
            "_q67": F.when(enough_v, F.percentile(F.col("_vol"), F.lit(0.67)).over(frame)),
        },
        {
            "regime": label("_slope", cfg.bull_threshold / k, cfg.bear_threshold / k),
            "regime_threshold": label("_sum", cfg.bull_threshold, cfg.bear_threshold),
            "regime_strict": strict,
            "regime_by_vol": by_vol,
        },
        {"regime_code": regime_code("regime")},
    ]


def log_volatility(x: str, epsilon: float = 1e-6) -> Column:
    return F.when(F.col(x).isNotNull(), F.log(F.greatest(F.col(x), F.lit(0.0)) + epsilon))


def regime_code(x: str) -> Column:
    """Bear 0, Sideways 1, Bull 2."""
    c = F.col(x)
    return F.when(c == "Bear", 0).when(c == "Sideways", 1).when(c == "Bull", 2)


def cached_indicators(c: Context) -> Stages:
    """The columns kept beside cached bars: returns, volatility, SMA 20/50, simple RSI."""
    w = c.w
    rsi = rsi_stages(c, "close", 14, 14, "rsi_simple")
    return _merge(
        [
            [
                {"returns": pct_change("close", 1, w), "log_returns": safe_log(ratio("close", F.lag("close", 1).over(w)))},
                {
                    "volatility": rolling(F.stddev_samp, "returns", w, 20),
                    "sma_20": rolling(F.avg, "close", w, 20),
                    "sma_50": rolling(F.avg, "close", w, 50),
                },
            ],
            rsi,
        ]
    )


MODULES: dict[str, Module] = {
    m.name: m
    for m in (
        Module("technical", technical, _technical_lookback, ("close", "high", "low")),
        Module("statistical", statistical, lambda cfg: cfg.separation + 2 * max(cfg.volatility_windows) + 1),
        Module("calendar", calendar, lambda cfg: 0, ()),
        Module("lagged", lagged, lambda cfg: cfg.separation + max(cfg.lags) + 1),
        Module("nonlinear", nonlinear, lambda cfg: cfg.separation + 21),
        Module("performance", performance, lambda cfg: 21, ("close", "volume")),
        Module("cached", cached_indicators, lambda cfg: 51),
        Module("realised", realised, lambda cfg: 21),
        Module("targets", targets, lambda cfg: 6, ("close",), lambda cfg: 5),
        Module("simple_targets", simple_targets, lambda cfg: 6, ("close",), lambda cfg: 10),
        Module("regimes", regimes, lambda cfg: 2 * max(5, cfg.regime_window) + 21),
    )
}
DEFAULT_MODULES = ("technical", "statistical", "calendar", "lagged", "nonlinear", "performance")


def add_module(module: Module) -> None:
    MODULES[module.name] = module


def remove_module(name: str) -> None:
    MODULES.pop(name, None)


def list_modules() -> list[str]:
    return list(MODULES)


def check_columns(df: DataFrame, needed: Iterable[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def features(
    bars: DataFrame,
    modules: Iterable[str | Module] | None = None,
    cfg: FeatureSettings | None = None,
    series: Series = DAILY,
    extra: Iterable[str] = (),
) -> DataFrame:
    """(keys, time, extra columns, feature columns) of the chosen modules in one window pass.

    With ``only_price_lags`` set and no modules named, only the lag columns are built.
    """
    cfg = cfg or FeatureSettings()
    if modules is None:
        modules = ("lagged",) if cfg.only_price_lags else DEFAULT_MODULES
    chosen = [m if isinstance(m, Module) else MODULES[m] for m in modules]
    check_columns(bars, {c for m in chosen for c in m.needs} | {*series.keys, series.time})
    lookback = max([m.lookback(cfg) for m in chosen]) + 1
    lookahead = max(m.lookahead(cfg) for m in chosen)
    produced: list[str] = []

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        ctx = Context(w, cfg, series)
        rows = rows.withColumn("price", price_column(rows)).withColumn("ret", log_return(ctx))
        for stage in _merge(m.build(ctx) for m in chosen):
            rows = rows.withColumns(stage)
            produced.extend(n for n in stage if not n.startswith("_") and n not in produced)
        return rows

    out = over_series(bars, build, series, lookback, lookahead)
    keep = [*series.keys, series.time, *[x for x in extra if x not in produced], *produced]
    return out.select(*dict.fromkeys(keep))


def lag_prices(
    bars: DataFrame, lags: Iterable[int] = (1, 2, 3, 5, 10), averages: Iterable[int] = (30, 60), series: Series = DAILY
) -> DataFrame:
    """Lagged returns, lagged prices over the last price of the series, and MA over price.

    The last price is one partial-aggregated row per series. Rows lacking any column are
    dropped; a lag or average not shorter than the series is left NULL without dropping.
    """
    lags, averages = list(lags), list(averages)
    last = bars.groupBy(*series.keys).agg(F.max_by("close", series.time).alias("_last"))

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_pc", pct_change("close", 1, w))
        cols = {f"return_t_{n}": F.lag("_pc", n).over(w) for n in lags}
        cols |= {f"_price_{n}": F.lag("close", n).over(w) for n in lags}
        cols |= {f"ma_{k}": ratio(rolling(F.avg, "close", w, k), "close") - 1 for k in averages}
        return rows.withColumns(cols)

    out = join_stats(over_series(bars, build, series, max(lags + averages) + 2), last, series.keys)
    out = out.withColumns({f"price_t_{n}": ratio(f"_price_{n}", "_last") - 1 for n in lags})
    names = {f"return_t_{n}": n for n in lags} | {f"price_t_{n}": n for n in lags} | {f"ma_{k}": k for k in averages}
    for name, span in names.items():
        out = out.filter(F.col(name).isNotNull() | (F.col("_n") <= span))
    return out.select(*series.keys, series.time, *names)


def sequences(
    bars: DataFrame, length: int, cols: Iterable[str] = ("close",), target: Column | None = None, series: Series = DAILY, lookahead: int = 1
) -> DataFrame:
    """``x_seq``: the ``length`` rows before each row, row by row; ``y``: target of that row.

    ``target`` is a window function such as a lead of at most ``lookahead`` rows.
    """
    cols = list(cols)
    item = F.col(cols[0]).cast("double") if len(cols) == 1 else F.array(*[F.col(c).cast("double") for c in cols])

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        seen = F.collect_list(item).over(w.rowsBetween(-length, -1))
        y = F.lit(None).cast("double") if target is None else target.over(w)
        return rows.withColumns({"x_seq": seen, "y": y})

    out = over_series(bars, build, series, length + 1, lookahead).filter(F.size("x_seq") == length)
    flat = F.col("x_seq") if len(cols) == 1 else F.flatten("x_seq")
    return out.select(*series.keys, series.time, F.col("_rn").alias("rn"), flat.alias("x_seq"), "y")
