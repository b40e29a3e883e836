"""Validation overview of a series table and its folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.safe import is_inf
from tideline.operators.folds import split_info


def validation_summary(rows: DataFrame, folds: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Fold sizes with missing and infinite counts per series, and whether it can be used."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    infinite = sum((F.count_if(is_inf(c)) for c in cols[1:]), F.count_if(is_inf(cols[0])))
    quality = rows.groupBy(*keys).agg(missing.alias("missing"), infinite.alias("infinite"))
    both = quality.join(split_info(folds, keys), list(keys), "left").na.fill(0, ["n_splits", "total_samples"])
    return both.withColumn("is_valid", (F.col("infinite") == 0) & (F.col("n_splits") > 0))
