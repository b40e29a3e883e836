"""Contributions of features to predictions, in one long table, and their statistics.

The table is (asset, model, ts, feature, contribution); keys are few, rows many, so all
statistics are partial aggregates and all rolling work goes through the chunked layout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.layout import Series, over_series, with_position
from tideline.functions.skew import join_stats
from tideline.functions.safe import last_rows
from tideline.operators.selection import correlation_matrix, top_k

MODEL_KEYS = ("asset", "model")
CONTRIBUTIONS = Series(keys=("asset", "model", "feature"))


def linear_contributions(rows: DataFrame, coefficients: Mapping[str, Mapping[str, float]], keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Exact additive contributions coef * (x - mean) of linear models, long.

    ``coefficients``: model -> feature -> coefficient. Means are per group.
    """
    names = sorted({f for c in coefficients.values() for f in c})
    means = rows.groupBy(*keys).agg(*[F.avg(f).alias(f"_m_{f}") for f in names])
    cells = [
        F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), (F.lit(float(b)) * (F.col(f) - F.col(f"_m_{f}"))).alias("contribution"))
        for m, c in coefficients.items()
        for f, b in c.items()
    ]
    joined = join_stats(rows, means, keys)
    long = joined.select(*keys, "ts", F.explode(F.array(*cells)).alias("_c")).select(*keys, "ts", "_c.*")
    return long.filter(F.col("contribution").isNotNull())


def importance(contribs: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contribs.groupBy(*keys, "feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def importance_stats(table: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Top feature and its importance, mean and population deviation over features."""
    return table.groupBy(*keys).agg(
        F.max_by("feature", "importance").alias("top_feature"),
        F.max("importance").alias("top_importance"),
        F.avg("importance").alias("mean_importance"),
        F.stddev_pop("importance").alias("std_importance"),
    )


def importance_wide(table: DataFrame, assets: Sequence[str], models: Sequence[str], name) -> DataFrame:
    """Feature by (asset, model), for the configured assets and models."""
    cells = [
        F.avg(F.when((F.col("asset") == a) & (F.col("model") == m), F.col("importance"))).alias(name(a, m))
        for a in assets
        for m in models
    ]
    return table.groupBy("feature").agg(*cells)


def top_features(table: DataFrame, n: int, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    return top_k(table, "importance", n, keys)


def contributions_wide(contribs: DataFrame, features: Sequence[str], keys: Sequence[str] = MODEL_KEYS, absolute: bool = False) -> DataFrame:
    c = F.abs("contribution") if absolute else F.col("contribution")
    return contribs.groupBy(*keys, "ts").agg(*[F.max(F.when(F.col("feature") == f, c)).alias(f) for f in features])


def interactions(contribs: DataFrame, features: Sequence[str], keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Correlation of contributions and of their absolute values per pair of features."""
    plain = correlation_matrix(contributions_wide(contribs, features, keys), features, keys)
    sized = correlation_matrix(contributions_wide(contribs, features, keys, True), features, keys)
    on = [*keys, "feature_1", "feature_2"]
    both = plain.join(sized.withColumnRenamed("corr", "abs_value_corr"), on)
    return both.withColumn("strength", F.abs("corr"))


def top_interactions(pairs: DataFrame, k: int, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("strength").desc_nulls_last(), "feature_1", "feature_2")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def temporal_stats(contribs: DataFrame, series: Series = CONTRIBUTIONS) -> DataFrame:
    """Mean, population deviation, linear trend per row, and deviation over mean size."""
    keys = list(series.keys)
    placed = with_position(contribs, series)
    c = F.col("contribution")
    return placed.groupBy(*keys).agg(
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"),
        F.regr_slope(c, F.col("rn").cast("double")).alias("trend"),
        F.try_divide(F.stddev_pop(c), F.avg(F.abs(c))).alias("volatility"),
    )


def rolling_stats(contribs: DataFrame, window: int = 30, series: Series = CONTRIBUTIONS) -> DataFrame:
    """Rolling mean, deviation, maximum and minimum of each feature's contributions."""

    def build(rows, w):
        frame = last_rows(w, window)
        names = {"rolling_mean": F.avg, "rolling_std": F.stddev_samp, "rolling_max": F.max, "rolling_min": F.min}
        return rows.withColumns({n: f("contribution").over(frame) for n, f in names.items()})

    return over_series(contribs, build, series, window)


def change_points(
    contribs: DataFrame, window: int = 30, deviations: float = 2.0, keys: Sequence[str] = MODEL_KEYS
) -> DataFrame:
    """Rows whose rolling mean importance moves to the next row by over two deviations."""
    series = Series(keys=tuple(keys))
    size = contribs.groupBy(*keys, "ts").agg(F.avg(F.abs("contribution")).alias("size"))
    limit = size.groupBy(*keys).agg((F.stddev_pop("size") * deviations).alias("threshold"))

    def build(rows, w):
        rows = rows.withColumn("rolling", F.avg("size").over(last_rows(w, window)))
        return rows.withColumn("step", F.lead("rolling", 1).over(w) - F.col("rolling"))

    moved = join_stats(over_series(size, build, series, window, 1), limit, keys)
    return moved.filter(F.abs("step") > F.col("threshold")).select(*keys, "ts", F.col("_rn").alias("position"), "rolling", "step", "threshold")


def dependence(contribs: DataFrame, top: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Value beside contribution for the features of ``top`` (needs a value column)."""
    return join_stats(contribs, top.select(*keys, "feature"), [*keys, "feature"], "left_semi")


def with_values(contribs: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature values joined to contributions that carry none."""
    from tideline.operators.cleaning import unpivot

    long = unpivot(rows, ["asset", "ts"], features)
    return contribs.join(long, ["asset", "ts", "feature"], "left")


def explain_row(contribs: DataFrame, where: Column, base: Column | None = None, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Contributions of chosen rows by size, with their total and the base value.

    A row has one contribution per feature, so its window is bounded by the feature list.
    """
    rows = contribs.filter(where)
    w = Window.partitionBy(*keys, "ts")
    out = rows.withColumn("total", F.sum("contribution").over(w))
    out = out.withColumn("rank", F.row_number().over(w.orderBy(F.abs("contribution").desc(), "feature")))
    return out.withColumn("base_value", base if base is not None else F.lit(0.0))


def evaluation_sample(rows: DataFrame, n: int = 20, keys: Sequence[str] = ("asset",), time: str = "ts", seed: int = 42) -> DataFrame:
    """At most n rows per group, fixed by a hash of their keys; the operator is the sample.

    Rank limits are applied per partition before the shuffle.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *keys, F.date_format(time, "yyyy-MM-dd HH:mm:ss")).cast("binary"))
    w = Window.partitionBy(*keys).orderBy(digest, time)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def coverage(table: DataFrame, universe: DataFrame) -> DataFrame:
    """Every asset of the universe with whether it has results and how many models."""
    counts = table.groupBy("asset").agg(F.count_distinct("model").alias("model_count"))
    return universe.join(counts, "asset", "left").select(
        "asset", F.col("model_count").isNotNull().alias("has_data"), F.coalesce("model_count", F.lit(0)).alias("model_count")
    )


def model_coverage(table: DataFrame) -> DataFrame:
    return table.groupBy("model").agg(F.count_distinct("asset").alias("asset_count"))


def coefficient_importance(coefs: DataFrame, scores: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """0.7 times the absolute coefficient plus 0.3 times the absolute selection score."""
    on = [k for k in (*keys, "feature") if k in scores.columns and k in coefs.columns]
    size = F.abs("coefficient")
    value = F.when(F.col("score").isNotNull(), 0.7 * size + 0.3 * F.abs("score")).otherwise(size)
    return coefs.join(scores, on, "left").withColumn("importance", value)
