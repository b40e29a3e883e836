import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

BAR_SCHEMA = "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


@pytest.fixture(scope="session")
def spark():
    from tideline.session import local_session

    session = local_session(8, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_bars(rows: dict[str, int], seed: int = 7) -> pd.DataFrame:
    """Random walks per asset on irregular days."""
    rng = np.random.default_rng(seed)
    parts = []
    for asset, n in rows.items():
        days = np.cumsum(rng.integers(1, 4, n))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        high, low = close * (1 + rng.uniform(0, 0.02, n)), close * (1 - rng.uniform(0, 0.02, n))
        parts.append(pd.DataFrame({
            "asset": asset, "ts": pd.Timestamp("2001-01-01") + pd.to_timedelta(days, unit="D"),
            "open": np.r_[close[0], close[:-1]], "high": high, "low": low, "close": close,
            "volume": rng.integers(1, 1000, n),
        }))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def long_bars():
    return make_bars({"HOT": 900, "MID": 300, "ONE": 1})


@pytest.fixture(scope="session")
def long_df(spark, long_bars):
    return spark.createDataFrame(long_bars, BAR_SCHEMA).persist()


@pytest.fixture(scope="session")
def small_bars():
    """Three assets of 40 rows with a constant stretch and a zero price, and a one-row asset."""
    pdf = make_bars({"A": 40, "B": 40, "C": 40, "D": 1}, seed=3)
    b = pdf.index[pdf.asset == "B"]
    pdf.loc[b[10:22], ["open", "high", "low", "close"]] = 50.0
    c = pdf.index[pdf.asset == "C"]
    pdf.loc[c[20], "close"] = 0.0
    return pdf


@pytest.fixture(scope="session")
def small_df(spark, small_bars):
    return spark.createDataFrame(small_bars, BAR_SCHEMA).persist()


def collect(df, by=("asset", "ts")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all(), f"null positions differ: {np.flatnonzero(np.isnan(a) != np.isnan(b))[:5]}"
    np.testing.assert_allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=tol, atol=tol)
