"""Report tables: market tags, pivots, summaries, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.safe import col


def market_of(asset: str | Column, us_assets: Sequence[str]) -> Column:
    return F.when(col(asset).isin(*us_assets), "US").otherwise("AU")


# Metric names, and those of which more is better.
MAXIMISE = ("r2", "accuracy", "f1", "precision", "recall")
METRICS = ("mse", "rmse", "mae", "r2", "accuracy", "f1", "precision", "recall")


def unify_metrics(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """One column per metric from whichever spellings the table has."""
    cols, used = {}, set()
    for name, spellings in aliases.items():
        have = [c for c in spellings if c in df.columns]
        used |= set(have)
        cols[name] = F.coalesce(*[F.col(c) for c in have]) if have else F.lit(None).cast("double")
    rest = [c for c in df.columns if c not in used]
    return df.select(*rest, *[c.alias(n) for n, c in cols.items()])


def infinite_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from tideline.functions.safe import is_inf

    return df.withColumns({c: F.when(~is_inf(c), F.col(c)) for c in cols})


def best_models(results: DataFrame, task: str, metric: str) -> DataFrame:
    """All rows of a task, best metric value first."""
    return results.filter(F.col("task") == task).orderBy(F.col(metric).desc_nulls_last(), "asset", "model")


def best_model(results: DataFrame, metric: str, keys: Sequence[str] = ("asset", "task")) -> DataFrame:
    """Best model per asset and task; larger is better for scores, smaller for errors."""
    sign = -1.0 if metric.lower() in MAXIMISE else 1.0
    pick = F.min(F.struct((F.col(metric) * sign).alias("s"), F.col("model").alias("m")))
    return results.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(pick.alias("_p")).select(
        *keys, F.col("_p.m").alias("model"), (F.col("_p.s") * sign).alias(metric)
    )


def ranking(results: DataFrame, by: str, metric: str) -> DataFrame:
    return results.groupBy(by).agg(F.avg(metric).alias(metric)).orderBy(metric, by)


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence[str], metric: str, name=lambda v: v) -> DataFrame:
    """Mean metric by row and configured column values."""
    return df.groupBy(row).agg(*[F.avg(F.when(F.col(column) == v, F.col(metric))).alias(name(v)) for v in values])


def metric_means(results: DataFrame, by: str, cols: Sequence[str] = METRICS) -> DataFrame:
    return results.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def consistency(results: DataFrame, metric: str = "r2", by: str = "model") -> DataFrame:
    return results.groupBy(by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def performance_summary(results: DataFrame) -> DataFrame:
    """Per (task, metric): best value with its model and asset, mean, deviation, counts."""
    long = results.unpivot(["task", "model", "asset"], ["r2", "mse", "accuracy", "f1"], "metric", "value")
    long = long.filter(F.col("value").isNotNull())
    key = F.when(F.col("metric") == "mse", F.col("value")).otherwise(-F.col("value"))
    best = F.min(F.struct(key.alias("k"), F.col("model").alias("model"), F.col("asset").alias("asset"), F.col("value").alias("value")))
    return long.groupBy("task", "metric").agg(
        best.alias("_b"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count_distinct("asset").alias("assets"),
        F.count_distinct("model").alias("models"),
    ).select("task", "metric", F.col("_b.model").alias("best_model"), F.col("_b.asset").alias("best_asset"), F.col("_b.value").alias("best_value"), "mean", "std", "assets", "models")


#: Digits of the texts: six for errors, four for scores and shares, two for seconds.
DIGITS = {"mse": 6, "rmse": 6, "mae": 6, "mape": 6, "baseline_mse": 6, "r2": 4, "accuracy": 4, "f1": 4, "precision": 4, "recall": 4, "fit_time_s": 2, "pred_time_s": 2}
_SCORES = ("accuracy", "f1", "precision", "recall")


def comparison_table(results: DataFrame) -> DataFrame:
    """"mean ± deviation" texts per asset, model and task; times where the table has them."""
    have = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in results.columns else F.lit(0.0)
    text = lambda c: F.format_string(f"%.{DIGITS[c]}f ± %.{DIGITS[c]}f", have(c), have(f"{c}_std"))
    clf = F.col("task") == "classification"
    cols = []
    for c in DIGITS:
        if c in results.columns:
            cols.append((text(c) if c.endswith("_s") else F.when(clf if c in _SCORES else ~clf, text(c))).alias(f"{c}_text"))
    return results.select("asset", "model", "task", *cols)


def best_rows(results: DataFrame) -> DataFrame:
    """One row: counts, lowest-RMSE regression row and highest-F1 classification row."""
    pick = lambda f, c, t: f(F.when((F.col("task") == t) & F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("model").alias("m"), F.col("asset").alias("a"))))
    out = results.agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.count_distinct("asset").alias("assets"),
        F.count_distinct("model").alias("models"),
        pick(F.min, "rmse", "regression").alias("_r"),
        pick(F.max, "f1", "classification").alias("_c"),
    )
    names = lambda c, p: [F.col(f"{c}.m").alias(f"{p}_model"), F.col(f"{c}.a").alias(f"{p}_asset"), F.col(f"{c}.v").alias(f"{p}_value")]
    return out.select("evaluations", "assets", "models", *names("_r", "regression"), *names("_c", "classification"))


def key_findings(summary: DataFrame) -> DataFrame:
    """The best model of each task by its main metric: task, model, asset, metric, value."""
    main = F.when(F.col("task") == "classification", "accuracy").otherwise("r2")
    return summary.filter(F.col("metric") == main).select("task", F.col("best_model").alias("model"), F.col("best_asset").alias("asset"), "metric", F.col("best_value").alias("value"))


def export_summary(results: DataFrame) -> DataFrame:
    """Per asset: number of stored models, model types and tasks."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return results.groupBy("asset").agg(F.count(F.lit(1)).alias("models"), joined("model").alias("model_types"), joined("task").alias("tasks"))


def store_summary(results: DataFrame, predictions: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: distinct assets and models, stored predictions and features."""
    key = lambda *cols: F.count_distinct(F.struct(*cols))
    preds = predictions.select("asset", "model").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return results.agg(
        F.count_distinct("asset").alias("assets"), key("asset", "model", "task").alias("models")
    ).withColumn("predictions", preds).withColumn("features", F.lit(len(features)).cast("bigint"))


def compare_runs(metrics: DataFrame, run_ids: Sequence[str], metric: str) -> DataFrame:
    """One column per run of a metric, by asset, model and task."""
    chosen = metrics.filter(F.col("run_id").isin(*run_ids))
    cells = [F.max(F.when(F.col("run_id") == r, F.col(metric))).alias(r) for r in run_ids]
    return chosen.groupBy("asset", "model", "task").agg(*cells)
