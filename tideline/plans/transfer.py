"""Cross-asset transfer: models fitted on a source are scored on targets.

A model is fitted on its source alone. The configured source models are a small table that every task holds; a task
multiplies its rows by all models at once and sends error sums per (source, target), so no (row, source) pair is
ever produced and a hot target is summed where its rows are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.models.linear import fit_linear, predict_linear


def source_means(rows: DataFrame, target: str, sources: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("asset").isin(*sources)).groupBy("asset").agg(F.avg(target).alias("value"))


def _score(rows: DataFrame, features: Sequence[str], target: str, models: list[tuple[str, list[float], float]], name: str) -> DataFrame:
    """(source, target, metrics); ``models``: source, coefficients, intercept of each configured source."""
    sources = [m[0] for m in models]
    coefs, base = np.reshape([m[1] for m in models], (len(models), len(features))), np.array([m[2] for m in models])

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            assets = batch.column(0).dictionary_encode()
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.zeros((len(y), 0)), *(batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(features)))])
            error = x @ coefs.T + base - y[:, None]
            code = assets.indices.to_numpy()
            for k, asset in enumerate(assets.dictionary.to_pylist()):
                mine = error[code == k]
                yield pa.RecordBatch.from_pydict({"source": sources, "target": [asset] * len(sources), "se": (mine * mine).sum(0), "ae": np.abs(mine).sum(0)})

    clean = rows.select(F.col("asset"), F.col(target).cast("double"), *[F.col(f).cast("double") for f in features]).na.drop()
    spread = clean.groupBy(F.col("asset").alias("target")).agg(F.var_pop(target).alias("_v"), F.count(F.lit(1)).alias("n"))
    if not models:
        return spread.selectExpr("cast(null as string) source", "target", f"'{name}' model", "'regression' task", "_v mse", "_v rmse", "_v mae", "_v r2", "n").limit(0)
    errors = clean.mapInArrow(sums, "source string, target string, se double, ae double").groupBy("source", "target").agg(F.sum("se").alias("_se"), F.sum("ae").alias("_ae"))
    mse = F.col("_se") / F.col("n")
    return errors.join(spread, "target").select(
        "source", "target", F.lit(name).alias("model"), F.lit("regression").alias("task"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), (F.col("_ae") / F.col("n")).alias("mae"), (1 - F.try_divide(mse, "_v")).alias("r2"), "n"
    )


def score_constants(rows: DataFrame, constants: DataFrame, sources: Sequence[str], target: str, name: str = "mean") -> DataFrame:
    """Every target predicted by the constant of every source."""
    known = constants.filter(F.col("asset").isin(*sources)).collect()  # a row per configured source
    return _score(rows, [], target, [(r["asset"], [], r["value"]) for r in known], name)


def transfer_matrix(rows: DataFrame, features: Sequence[str], target: str, sources: Sequence[str]) -> DataFrame:
    """Linear models fitted per source and scored on every asset: (source, target, metrics)."""
    clean = rows.na.drop(subset=[*features, target])
    fitted = fit_linear(clean.filter(F.col("asset").isin(*sources)), features, target, ["asset"])
    known = fitted.select("asset", "coefs", "intercept").collect()  # a row per configured source
    return _score(clean, features, target, [(r["asset"], r["coefs"], r["intercept"]) for r in known], "linear")


def transfer_pool(rows: DataFrame, features: Sequence[str], target: str, sources: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One linear model on the pooled source assets, metrics on each target asset."""
    from tideline.operators.metrics import regression_metrics

    clean = rows.na.drop(subset=[*features, target])
    model = fit_linear(clean.filter(F.col("asset").isin(*sources)), features, target, [])
    scored = predict_linear(clean.filter(F.col("asset").isin(*targets)), model, features, [])
    preds = scored.withColumn("y_true", F.col(target))
    return regression_metrics(preds, ["asset"]).withColumn("sources", F.lit(",".join(sources)))
