"""Unit-root tests with lag terms, for whole series or the train rows of folds.

One moments row per series (or fold) holds the level, its difference and the lagged differences of all orders; every order
is a sub-matrix of it, so the choice of the order by AIC reads the rows once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.layout import DAILY, Series, over_series
from tideline.models.linear import fold_moments, moments
from tideline.session import materialise

# The published response surface of the Dickey-Fuller t with a constant: where each polynomial holds,
# its coefficients by rising power, and the ends beyond which the chance is 0 or 1.
SURFACE_SPLIT, SURFACE_LOW, SURFACE_HIGH = -1.61, -18.83, 2.74
SURFACE_SMALL = (2.1659, 1.4412, 0.038269)
SURFACE_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def chance(t: float) -> float:
    """How likely a Dickey-Fuller t of at most this is where the series has a unit root."""
    if not math.isfinite(t):
        return math.nan
    if t >= SURFACE_HIGH or t <= SURFACE_LOW:
        return 1.0 if t >= SURFACE_HIGH else 0.0
    powers = SURFACE_SMALL if t <= SURFACE_SPLIT else SURFACE_LARGE
    return 0.5 * (1.0 + math.erf(sum(c * t**i for i, c in enumerate(powers)) / math.sqrt(2.0)))


def _lagged_differences(rows: DataFrame, x: str, order: int, most: int, series: Series) -> DataFrame:
    """Adds _back (level before), _d (difference) and _d1.. (earlier differences) of x differenced ``order`` times."""

    def build(r: DataFrame, w) -> DataFrame:
        def level(k: int) -> Column:
            signs = [math.comb(order, i) * (-1) ** i for i in range(order + 1)]
            return sum((s * F.lag(x, k + i).over(w) for i, s in enumerate(signs) if i), F.lag(x, k).over(w) if k else F.col(x).cast("double"))

        lags = {f"_d{i}": level(i) - level(i + 1) for i in range(1, most + 1)}
        return r.withColumns({"_back": level(1), "_d": level(0) - level(1)} | lags)

    return over_series(rows, build, series, most + order + 1).drop("_rn", "_n")


def _tested(most: int):
    def run(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
        out = []
        for rows, flat in zip(n, cov, strict=True):
            c = np.reshape(np.asarray(flat, float), (most + 2, most + 2))
            best = (math.inf, None, math.nan)
            for p in range(most + 1):
                use, left = list(range(p + 1)), rows - p - 2
                a, v = c[np.ix_(use, use)], c[use, -1]
                if left < 1 or np.linalg.matrix_rank(a, hermitian=True) <= p:
                    continue
                inverse = np.linalg.inv(a)
                coefs = inverse @ v
                sse = max(float(c[-1, -1] - coefs @ v) * rows, 1e-300)
                aic = rows * math.log(sse / rows) + 2 * (p + 2)
                if aic < best[0]:
                    best = (aic, p, float(coefs[0] / math.sqrt(sse / left * inverse[0, 0] / rows)))
            out.append((best[1], best[2], chance(best[2])))
        return pd.DataFrame(out, columns=["lag", "adf", "p_value"]).astype({"lag": "Int64"})

    return F.pandas_udf(run, "lag long, adf double, p_value double")("n", "means", "cov")


def _columns(most: int) -> list[str]:
    return ["_back", *(f"_d{i}" for i in range(1, most + 1))]


def augmented_dickey_fuller(df: DataFrame, x: str, series: Series = DAILY, most: int = 4) -> DataFrame:
    """(keys, n, lag, adf, p_value) with a constant and up to ``most`` lagged differences, as many as AIC chooses over the
    same rows. A series without variation has no statistic."""
    keys = list(series.keys)
    rows = _lagged_differences(df.select(*keys, series.time, x).na.drop(), x, 0, most, series)
    table = moments(rows, _columns(most), "_d", keys).withColumn("_t", _tested(most))
    return table.select(*keys, "n", "_t.lag", "_t.adf", "_t.p_value")


def fold_differencing(rows: DataFrame, folds: DataFrame, x: str = "y", series: Series = DAILY, most_lag: int = 4, most: int = 1, limit: float = 0.05) -> DataFrame:
    """(keys, fold, d): the fewest differences, at most ``most``, after which the fold's train rows show no unit root.

    ``rows`` have positions ``rn``; the rows of all folds are read once per order.
    """
    keys = list(series.keys)
    on = [*keys, "fold"]
    out = folds.select(*on)
    pick = F.lit(most)
    for order in range(most):
        laid = materialise(_lagged_differences(rows.select(*keys, series.time, "rn", x).na.drop(), x, order, most_lag, series), "lagged")
        table = fold_moments(laid, folds, _columns(most_lag), "_d", keys).withColumn("_t", _tested(most_lag))
        out = out.join(table.select(*on, F.col("_t.p_value").alias(f"_p{order}")), on, "left")
    for order in reversed(range(most)):
        # no statistic: too few rows or no variation, where differencing cannot help
        still = F.coalesce((F.col(f"_p{order}") < limit) | F.isnan(f"_p{order}"), F.lit(True))
        pick = F.when(still, F.lit(order)).otherwise(pick)
    return out.select(*on, pick.alias("d"))


def by_differencing(folds: DataFrame, orders: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    return folds.join(orders.filter(F.col("d") == d).select(*keys, "fold"), [*keys, "fold"], "left_semi")
