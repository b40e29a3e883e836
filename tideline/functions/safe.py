"""Null-safe column expressions shared by every operator.

Missing is SQL NULL, never NaN. ANSI mode raises on x/0, so every quotient here is a
``try_divide`` and every rolling result carries its own minimum row count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ANNUAL = math.sqrt(252.0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def safe_log(x: str | Column) -> Column:
    return F.when(col(x) > 0, F.log(col(x)))


def finite(x: str | Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def is_inf(x: str | Column) -> Column:
    return F.coalesce(F.abs(col(x).cast("double")) == F.lit(float("inf")), F.lit(False))


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)


def last_rows(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-(k - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg, x: str | Column, w: WindowSpec, k: int, min_rows: int | None = None) -> Column:
    """agg(x) over the last k rows, NULL below min_rows non-null values (k by default)."""
    frame = last_rows(w, k)
    need = k if min_rows is None else max(1, min_rows)
    value = agg(col(x)).over(frame)
    if need == 1:
        return value  # aggregates of no value are NULL already
    return F.when(F.count(col(x)).over(frame) >= need, value)


def rolling_corr(x: str | Column, y: str | Column, w: WindowSpec, k: int) -> Column:
    """Correlation over the last k rows; rows lacking either value are left out."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    frame = last_rows(w, k)
    return F.try_divide(
        F.covar_samp(a, b).over(frame),
        F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame),
    )


def corr(x: str | Column, y: str | Column) -> Column:
    """Aggregate correlation, NULL where either side has no variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Bias-adjusted skewness from the population value g1 of n rows."""
    n = n.cast("double")
    return F.when(n >= 3, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-adjusted excess kurtosis from the population excess g2 of n rows."""
    n = n.cast("double")
    return F.when(n >= 4, F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3)))


# Lower-tail standard normal quantiles by confidence level.
NORMAL_LOWER = {0.90: -1.2815515655446004, 0.95: -1.6448536269514722, 0.99: -2.3263478740408408}


def t_quantile(confidence: float, dof: str | Column) -> Column:
    """Lower-tail Student-t quantile at 1-confidence, by expansion about the normal one.

    Four terms in 1/dof; the error is below 1e-6 from about 30 degrees of freedom.
    """
    z = NORMAL_LOWER[confidence]
    v = col(dof).cast("double")
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return F.when(v > 0, F.lit(z) + g1 / v + g2 / v**2 + g3 / v**3 + g4 / v**4)


def chi2_tail_even(x: str | Column, dof: int) -> Column:
    """Upper tail of chi-squared with an even number of degrees of freedom (closed form)."""
    half = col(x) / 2
    terms = sum((F.pow(half, F.lit(i)) / math.factorial(i) for i in range(1, dof // 2)), F.lit(1.0))
    return F.exp(-half) * terms
