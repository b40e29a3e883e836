"""Labels that need whole-series quantiles, and target clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.layout import DAILY, Series, over_series
from tideline.functions.ranks import exact_quantiles
from tideline.functions.safe import last_rows
from tideline.functions.skew import join_stats


def cut_three(x: str, low: str, high: str) -> Column:
    """0, 1, 2 by right-closed cut points."""
    c = F.col(x)
    return F.when(c <= F.col(low), 0).when(c <= F.col(high), 1).when(c.isNotNull(), 2)


def quantile_labels(
    df: DataFrame, value: str, reference: str | None = None, keys: Sequence[str] = ("asset",), out: str = "label"
) -> DataFrame:
    """Three classes of ``value`` cut at the 33% and 67% quantiles of ``reference``."""
    edges = exact_quantiles(df, keys, reference or value, {"_q33": 0.33, "_q67": 0.67}).drop("n")
    return join_stats(df, edges, keys, "left").withColumn(out, cut_three(value, "_q33", "_q67")).drop("_q33", "_q67")


def quartile_labels(df: DataFrame, value: str, keys: Sequence[str] = ("asset",), out: str = "quartile", least: int = 4) -> DataFrame:
    """Q1..Q4 by quartile edges; groups of under ``least`` values, which have no quartiles, split at their mean."""
    edges = exact_quantiles(df, keys, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).withColumnRenamed("n", "_k")
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    c = F.col(value)
    by_edge = F.when(c <= F.col("_q1"), "Q1").when(c <= F.col("_q2"), "Q2").when(c <= F.col("_q3"), "Q3").otherwise("Q4")
    by_mean = F.when(c <= F.col("_mean"), "Q1").otherwise("Q4")
    label = F.when(c.isNotNull(), F.when(F.col("_k") < least, by_mean).otherwise(by_edge))
    small = edges.join(means, list(keys))
    return join_stats(df, small, keys, "left").withColumn(out, label).drop("_q1", "_q2", "_q3", "_k", "_mean")


def volatility_regimes(df: DataFrame, vol: str, window: int = 60, series: Series = DAILY, out: str = "regime") -> DataFrame:
    """Bull at or below the rolling 33% quantile of volatility, Bear at or above the 67% one.

    Rows without a volatility must be left out; the frame has ``window`` rows.
    """
    least = max(10, window // 2)

    def build(rows, w):
        frame = last_rows(w, window)
        enough = F.count(vol).over(frame) >= least
        quantile = lambda p: F.when(enough, F.percentile(F.col(vol), F.lit(p)).over(frame))
        return rows.withColumns({"_q33": quantile(0.33), "_q67": quantile(0.67)})

    v, lo, hi = F.col(vol), F.col("_q33"), F.col("_q67")
    label = F.when(v <= lo, "Bull").when(v >= hi, "Bear").when((v > lo) & (v < hi), "Sideways")
    laid = over_series(df, build, series, window)
    return laid.withColumn(out, label).drop("_q33", "_q67", "_rn", "_n")


def logistic_probability(value: str, threshold: str, scale: str) -> Column:
    """High where value is below threshold: 1 / (1 + exp((v - threshold) / scale))."""
    s = F.greatest(F.lit(1e-9), F.when(F.col(scale) > 0, F.col(scale)).otherwise(F.lit(1e-3))) + 1e-9
    return 1.0 / (1.0 + F.exp((F.col(value) - F.col(threshold)) / s))


def volatility_classes(df: DataFrame, value: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """``prob`` by the logistic map about the group's median and ``vol_class`` 0/1/2; NULL gives 1."""
    middle = exact_quantiles(df, keys, value, {"_thr": 0.5}).drop("n")
    scale = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_scale"))
    out = join_stats(df, middle.join(scale, list(keys)), keys, "left")
    out = out.withColumn("prob", logistic_probability(value, "_thr", "_scale"))
    cls = F.when(F.col("prob") < 0.33, 0).when(F.col("prob") < 0.67, 1).when(F.col("prob").isNotNull(), 2)
    return out.withColumn("vol_class", F.coalesce(cls, F.lit(1))).drop("_thr", "_scale")


def clip_target(x: str, bound: float = 100.0) -> Column:
    return F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.lit(bound)), F.lit(-bound)))


def align_targets(df: DataFrame, targets: Sequence[str], keys: Sequence[str] = ("asset",), least: int = 100) -> DataFrame:
    """Rows with all targets, for series that keep at least ``least`` rows.

    The count is a partial aggregate joined back, not a window over the whole series.
    """
    rows = df.na.drop(subset=list(targets))
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= least)
    return join_stats(rows, enough.select(*keys), keys, "left_semi")


def left_out(before: DataFrame, after: DataFrame, reason: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """(keys, rows, reason) of the series that a step removed whole."""
    gone = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).join(after.select(*keys).distinct(), list(keys), "left_anti")
    return gone.withColumn("reason", F.lit(reason))


def drop_degenerate(df: DataFrame, target: str, label: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Series whose target has no variance or whose label has a single class are left out."""
    stats = df.groupBy(*keys).agg(F.stddev_samp(target).alias("_sd"), F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    good = stats.filter((F.col("_sd") > 0) & (F.col("_lo") < F.col("_hi")))
    return join_stats(df, good.select(*keys), keys, "left_semi")
