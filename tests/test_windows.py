"""Window features against pandas on a small series with hard stretches."""

import numpy as np
import pandas as pd
import pytest
from conftest import collect, same

from tideline.config import FeatureSettings
from tideline.operators.features import Module, add_module, features, list_modules, remove_module

CFG = FeatureSettings(separation=3, ma_short=4, ma_long=8)


@pytest.fixture(scope="module")
def got(small_df):
    return collect(features(small_df, ["technical", "statistical", "nonlinear", "performance", "cached", "targets"], CFG, extra=["close"]))


def by_asset(pdf, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby("asset")], ignore_index=True)


def log_ret(g):
    r = g.close / g.close.shift(1)
    return np.log(r.where((r > 0) & np.isfinite(r)))


def test_moving_averages_and_bands(got, small_bars):
    same(got.ma4, by_asset(small_bars, lambda g: g.close.shift(3).rolling(4, min_periods=1).mean()))
    mid = by_asset(small_bars, lambda g: g.close.shift(3).rolling(20, min_periods=1).mean())
    std = by_asset(small_bars, lambda g: g.close.shift(3).rolling(20, min_periods=1).std())
    same(got.bollinger_upper, mid + 2 * std, 1e-7)


def test_exponential_means(got, small_bars):
    macd = lambda g: g.close.shift(3).ewm(span=12, adjust=False).mean() - g.close.shift(3).ewm(span=26, adjust=False).mean()
    same(got.macd, by_asset(small_bars, macd), 1e-8)


def test_rsi(got, small_bars):
    def rsi(g, price, least):
        d = price.diff()
        gain = d.where(d > 0, 0).rolling(14, min_periods=least).mean()
        loss = (-d.where(d < 0, 0)).rolling(14, min_periods=least).mean()
        gain, loss = gain.round(12), loss.round(12)
        return (100 - 100 / (1 + gain / loss)).where((loss > 0) | (gain > 0))

    same(got.rsi, by_asset(small_bars, lambda g: rsi(g, g.close.shift(3), 1)), 1e-6)
    same(got.rsi_simple, by_asset(small_bars, lambda g: rsi(g, g.close, 14)), 1e-6)


def test_volatility_skew_kurtosis(got, small_bars):
    a = small_bars[small_bars.asset == "A"]
    mine = got[got.asset == "A"]
    r = log_ret(a.reset_index(drop=True)).shift(13)
    same(mine.volatility_10d, r.rolling(10, min_periods=5).std() * np.sqrt(252), 1e-9)
    same(mine.skew_10d, r.rolling(10, min_periods=5).skew(), 1e-6)
    same(mine.kurt_10d, r.rolling(10, min_periods=5).kurt(), 1e-6)


def test_constant_stretch_and_zero_price_give_null(got):
    b = got[got.asset == "B"].reset_index(drop=True)
    assert b.mean_reversion_5.iloc[16:21].isna().all()
    c = got[got.asset == "C"].reset_index(drop=True)
    assert c.log_returns.iloc[20:22].isna().all()
    assert not np.isinf(got.select_dtypes(float)).any().any()


def test_trend_and_correlation(got, small_bars):
    slope = lambda g: g.close.rolling(5).apply(lambda x: np.polyfit(range(5), x, 1)[0])
    same(got.trend_strength_5, by_asset(small_bars, slope), 1e-6)
    a = small_bars[small_bars.asset == "A"].reset_index(drop=True)
    want = a.volume.rolling(5).corr(a.close.pct_change())
    same(got[got.asset == "A"].volume_price_trend, want, 1e-7)


def test_target_is_future_volatility(got, small_bars):
    want = by_asset(small_bars, lambda g: (log_ret(g).rolling(5, min_periods=5).std() * np.sqrt(252)).shift(-5))
    same(got.target_vol5, want, 1e-9)


def test_module_registry(small_df):
    from pyspark.sql import functions as F

    add_module(Module("gap", lambda c: [{"gap": F.col("open") - F.lag("close", 1).over(c.w)}], lambda cfg: 1, ("open", "close")))
    assert "gap" in list_modules()
    assert features(small_df, ["gap"]).columns == ["asset", "ts", "gap"]
    remove_module("gap")
    assert "gap" not in list_modules()
    with pytest.raises(ValueError):
        features(small_df.drop("high"), ["technical"])
    assert features(small_df, cfg=FeatureSettings(only_price_lags=True)).columns[2:] == ["lag1", "lag2", "lag3", "lag5", "lag10"]


def test_ewm_with_gaps_against_pandas(spark):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from tideline.config import FeatureSettings
    from tideline.functions.layout import Series, over_series
    from tideline.operators.features import Context, ewm_lookback, ewm_stages

    rng = np.random.default_rng(2)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 1500)))
    x[rng.random(1500) < 0.1] = np.nan
    x[[0, 1, 400, 401, 402, 403]] = np.nan
    x[600:900] = np.nan
    pdf = pd.DataFrame({"asset": "A", "ts": pd.date_range("2001-01-01", periods=1500), "x": x})
    df = spark.createDataFrame(pdf, "asset string, ts timestamp_ntz, x double").withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    series = Series(bucket_days=16, chunk_rows=300)
    for span in (1, 2, 12, 26):

        def build(rows, w, span=span):
            for stage in ewm_stages(Context(w, FeatureSettings(), series), "x", span, 0, "e"):
                rows = rows.withColumns(stage)
            return rows

        got = over_series(df, build, series, ewm_lookback(span) if span > 1 else 400).toPandas().sort_values("ts")["e"].to_numpy(dtype=float)
        want = pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-9)
