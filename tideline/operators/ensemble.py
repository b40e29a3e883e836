"""Ensembles over a predictions table, aligned by key and not by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_KEYS = ("asset", "fold", "ts")


def align_models(preds: DataFrame, models: Sequence[str], keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """One row per (asset, fold, ts) with a column per model; NULL where a model lacks it."""
    cells = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    return preds.groupBy(*keys).agg(F.max("y_true").alias("y_true"), *cells)


def weighted_mean(preds: DataFrame, weights: Mapping[str, float], keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """Weighted mean of the models, for rows that all of them predict; equal weights where
    the given ones do not sum to more than zero."""
    total = sum(weights.values())
    share = {m: (w / total if total > 0 else 1.0 / len(weights)) for m, w in weights.items()}
    wide = align_models(preds, list(weights), keys).na.drop(subset=list(weights))
    mean = sum((F.col(m) * s for m, s in share.items()), F.lit(0.0))
    return wide.select(*keys, F.lit("ensemble").alias("model"), "y_true", mean.alias("y_pred"))


def majority_vote(preds: DataFrame, keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """Most frequent label per row over the models, the smallest label on ties."""
    counts = preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("_k"))
    pick = F.min(F.struct((-F.col("_k")).alias("k"), F.col("y_pred").alias("v")))["v"]
    return counts.groupBy(*keys, "y_true").agg(pick.alias("y_pred")).withColumn("model", F.lit("ensemble"))
