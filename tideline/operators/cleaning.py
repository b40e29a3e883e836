"""Missing and infinite values, validation and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.layout import DAILY, Series, backward_fill, forward_fill
from tideline.functions.ranks import exact_quantiles
from tideline.functions.safe import finite, is_inf
from tideline.functions.skew import join_stats
from tideline.session import materialise


def unpivot(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form with double values; NULL values stay as rows."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keep), list(cols), name, value)


def column_quantiles(df: DataFrame, cols: Sequence[str], keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row per group with columns ``{prob}_{col}``, exact, over finite values."""
    long = unpivot(df, keys, cols).withColumn("value", finite("value"))
    table = exact_quantiles(long, [*keys, "feature"], "value", probs)
    wide = [F.max(F.when(F.col("feature") == c, F.col(p))).alias(f"{p}_{c}") for c in cols for p in probs]
    return table.groupBy(*keys).agg(*wide)


def _with_medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return join_stats(df, column_quantiles(df, cols, keys, {"_med": 0.5}), keys, "left")


def infinite_to_median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Infinite values become the group's median of finite values, else 0; NULL stays."""
    fixed = {c: F.when(is_inf(c), F.coalesce(F.col(f"_med_{c}"), F.lit(0.0))).otherwise(F.col(c)) for c in cols}
    return _with_medians(df, cols, keys).withColumns(fixed).select(*df.columns)


def fill_missing(df: DataFrame, cols: Sequence[str], series: Series = DAILY) -> DataFrame:
    """Forward fill, then the median of the filled column, then 0."""
    filled = forward_fill(df, list(cols), series)
    fixed = {c: F.coalesce(F.col(c), F.col(f"_med_{c}"), F.lit(0.0)) for c in cols}
    return _with_medians(filled, cols, series.keys).withColumns(fixed).select(*df.columns)


def impute_for_training(
    df: DataFrame, cols: Sequence[str], target: str, text: Sequence[str] = (), series: Series = DAILY
) -> DataFrame:
    """Features: median for NULL and infinite; text: most frequent (smallest on ties); target:
    infinite to median, then forward and backward fill; rows without target are dropped."""
    keys = list(series.keys)
    out = _with_medians(df, [*cols, target], keys)
    fixed = {c: F.coalesce(finite(c), F.col(f"_med_{c}"), F.lit(0.0)) for c in cols}
    fixed[target] = F.when(is_inf(target), F.coalesce(F.col(f"_med_{target}"), F.lit(0.0))).otherwise(F.col(target))
    out = out.withColumns(fixed).select(*df.columns)
    for c in text:
        counts = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_k"))
        # most rows first, then smallest text: min over (-count, text)
        modes = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_k")).alias("k"), F.col(c).alias("v")))["v"].alias("_mode"))
        out = join_stats(out, modes, keys, "left").withColumn(c, F.coalesce(F.col(c), F.col("_mode"), F.lit("Unknown"))).drop("_mode")
    # each fill reads its input twice
    out = materialise(forward_fill(materialise(out, "imputed"), [target], series), "carried")
    out = backward_fill(out, [target], series)
    return out.filter(F.col(target).isNotNull())


def validate_bars(bars: DataFrame, least: int = 100, share: float = 0.05) -> DataFrame:
    """Per asset: rows, close outliers beyond 1.5 IQR, validity flag and issue codes (``few:n``, ``wild:n``)."""
    edges = exact_quantiles(bars, ["asset"], "close", {"_q1": 0.25, "_q3": 0.75}).drop("n")
    iqr = F.col("_q3") - F.col("_q1")
    out = (F.col("close") < F.col("_q1") - 1.5 * iqr) | (F.col("close") > F.col("_q3") + 1.5 * iqr)
    stats = (
        join_stats(bars, edges, ["asset"], "left")
        .groupBy("asset")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(out).alias("outliers"))
    )
    few = F.when(F.col("rows") < least, F.format_string("few:%d", "rows"))
    wild = F.when(F.col("outliers") > F.col("rows") * share, F.format_string("wild:%d", "outliers"))
    issues = F.filter(F.array(few, wild), lambda x: x.isNotNull())
    return stats.withColumn("issues", F.array_join(issues, " ")).withColumn("is_valid", F.col("issues") == "")


def quality_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature: infinite and NULL counts, and 3 IQR outliers after median repair (kept)."""
    long = unpivot(df, [], cols)
    counts = long.groupBy("feature").agg(
        F.count_if(is_inf("value")).alias("infinite"), F.count_if(F.col("value").isNull()).alias("missing")
    )
    mids = exact_quantiles(long.withColumn("value", finite("value")), ["feature"], "value", {"_med": 0.5}).drop("n")
    mids = materialise(mids, "medians")  # a row per feature, used three times
    fixed = join_stats(long, mids, ["feature"], "left", salt=["value"]).withColumn("value", F.coalesce(finite("value"), F.col("_med"))).drop("_med")
    edges = exact_quantiles(fixed, ["feature"], "value", {"_q1": 0.25, "_q3": 0.75}).drop("n")
    edges = materialise(edges, "edges")
    iqr = F.col("_q3") - F.col("_q1")
    out = (F.col("value") < F.col("_q1") - 3 * iqr) | (F.col("value") > F.col("_q3") + 3 * iqr)
    outliers = join_stats(fixed, edges, ["feature"], salt=["value"]).groupBy("feature").agg(F.count_if(out).alias("outliers"))
    return counts.join(outliers, "feature", "left").na.fill(0, ["outliers"])


def null_share(cols: Sequence[str]) -> Column:
    """Aggregate share of NULL cells over ``cols``."""
    cells = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    return cells / (F.count(F.lit(1)) * len(cols))


def drop_sparse(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",), most: float = 0.5) -> DataFrame:
    """Series with more than ``most`` of their cells NULL are left out."""
    good = df.groupBy(*keys).agg(null_share(cols).alias("_share")).filter(F.col("_share") <= most)
    return join_stats(df, good.select(*keys), keys, "left_semi")


def group_zscore(df: DataFrame, x: str, out: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """(x - mean) / sample deviation of the group; x itself where it does not vary."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    z = F.when(F.col("_sd") > 0, F.try_divide(F.col(x) - F.col("_mu"), F.col("_sd"))).otherwise(F.col(x))
    return join_stats(df, stats, keys, "left").withColumn(out, z).drop("_mu", "_sd")


def scale_extreme(
    df: DataFrame, cols: Sequence[str], share: float = 0.7, limit: float = 10.0, keys: Sequence[str] = ("asset",)
) -> DataFrame:
    """Standardise with the first ``share`` of rows, only for series of extreme scale.

    Needs ``rn`` and ``n`` (position and length). Extreme: the mean of column means is
    beyond ``limit``, or the mean of column deviations above it. Population deviation.
    """
    first = F.col("rn") < F.floor(F.col("n") * share)
    aggs = []
    for c in cols:
        part = F.when(first, F.col(c))
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
        aggs += [F.avg(part).alias(f"_tm_{c}"), F.stddev_pop(part).alias(f"_ts_{c}")]
    mean = lambda prefix: sum((F.col(f"{prefix}_{c}") for c in cols[1:]), F.col(f"{prefix}_{cols[0]}")) / len(cols)
    stats = df.groupBy(*keys).agg(*aggs).withColumn("_extreme", (F.abs(mean("_m")) > limit) | (mean("_s") > limit))
    scaled = {
        c: F.when(
            F.col("_extreme"),
            (F.col(c) - F.col(f"_tm_{c}")) / F.when(F.col(f"_ts_{c}") > 0, F.col(f"_ts_{c}")).otherwise(F.lit(1.0)),
        ).otherwise(F.col(c))
        for c in cols
    }
    return join_stats(df, stats, keys).withColumns(scaled).select(*df.columns, F.col("_extreme").alias("scaled"))


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count, mean, deviation, minimum and maximum per column."""
    return unpivot(df, [], cols).groupBy("feature").agg(
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def fit_scaler(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",)) -> DataFrame:
    """One row per group: mean and population deviation of every column."""
    aggs = [f(c).alias(f"{p}_{c}") for c in cols for f, p in ((F.avg, "mean"), (F.stddev_pop, "scale"))]
    return df.groupBy(*keys).agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",)) -> DataFrame:
    scale = lambda c: F.when(F.col(f"scale_{c}") > 0, F.col(f"scale_{c}")).otherwise(F.lit(1.0))
    scaled = {c: (F.col(c) - F.col(f"mean_{c}")) / scale(c) for c in cols}
    return join_stats(df, stats, keys).withColumns(scaled).select(*df.columns)
