"""Walk-forward evaluation of several models, and the uniform comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import WindowSettings
from tideline.functions.layout import DAILY, Series
from tideline.operators.features import log_volatility, sequences
from tideline.operators.folds import drop_bad_folds, fold_frames, held_out, lengths, scale_sequences, sliding_splits
from tideline.operators.metrics import leaderboard, rank_ic, regression_metrics
from tideline.plans.registry import CLASSIFICATION, REGRESSION, model_job, predict_folds
from tideline.session import materialise

PREDICTIONS = ("asset", "model", "fold", "ts", "y_true", "y_pred")


def expected_sizes(rows: DataFrame, folds: DataFrame, features: Sequence[str], models: Sequence[str], task: str = REGRESSION, target: str = "y") -> DataFrame:
    """(asset, fold, model, test_size): test rows that a model has to predict."""
    test = held_out(rows.filter(F.col(target).isNotNull()), folds)
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    sizes = test.groupBy("asset", "fold").agg(F.count(F.lit(1)).alias("_all"), F.count_if(whole).alias("_whole"))
    cells = [F.struct(F.lit(m).alias("model"), F.col("_whole" if model_job(m, task).whole_rows else "_all").alias("test_size")) for m in models]
    return sizes.select("asset", "fold", F.explode(F.array(*cells)).alias("_c")).select("asset", "fold", "_c.*")


def fit_predict_folds(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    models: Sequence[str],
    log_epsilon: float | None = None,
    task: str = REGRESSION,
    target: str = "y",
    classes: int = 3,
) -> DataFrame:
    """Predictions of every model on every fold; folds with unusable predictions, or too few, are dropped.

    ``log_epsilon``: set where the target is a logged volatility. The volatility model works
    on returns and not on the target, so its forecast is logged the same way. Predictions are
    written before they are tested, so no model is fitted twice. A classification has ``classes`` labels in ``target``.
    """
    parts = []
    for name in models:
        preds = predict_folds(name, task, rows, folds, features, target, classes if task == CLASSIFICATION else 0)
        preds = preds.withColumns({"model": F.lit(name), "y_true": F.col("y_true").cast("double"), "y_pred": F.col("y_pred").cast("double")}).select(*PREDICTIONS)
        if log_epsilon is not None and task == REGRESSION and model_job(name).of_returns:
            preds = preds.withColumn("y_pred", log_volatility("y_pred", log_epsilon))
        parts.append(preds)
    written = materialise(reduce(DataFrame.unionByName, parts), "predictions")
    return drop_bad_folds(written, expected=expected_sizes(rows, folds, features, models, task, target))


def uniform_eval(
    bars: DataFrame,
    targets: DataFrame,
    cfg: WindowSettings | None = None,
    models: Sequence[str] = ("linear", "ridge"),
    series: Series = DAILY,
) -> DataFrame:
    """Leaderboard of models that all see the same folds and scaled look-back windows.

    ``models``: those of the registry that predict from frames. ``targets``: (asset, ts, y).
    """
    cfg = cfg or WindowSettings()
    rows = sequences(bars, cfg.lookback, series=series).drop("y").join(targets.select("asset", "ts", "y"), ["asset", "ts"])
    folds = sliding_splits(lengths(bars), cfg.train, cfg.val, cfg.step)
    frames = fold_frames(rows.filter(F.col("y").isNotNull()), folds)
    scaled = scale_sequences(frames, "x_seq", cfg.lookback, kind=cfg.scaling)
    names = [f"x{i}" for i in range(cfg.lookback)]
    flat = scaled.select("asset", "fold", "role", "ts", "y", *[F.col("x_flat")[i].alias(n) for i, n in enumerate(names)])
    flat = materialise(flat, "sequences")  # read once per model and role
    parts = [model_job(name).on_frames(flat, names, "y", 0).withColumn("model", F.lit(name)).select(*PREDICTIONS) for name in models]
    preds = materialise(reduce(DataFrame.unionByName, parts), "predictions")
    on = ["asset", "model", "fold"]
    return leaderboard(regression_metrics(preds, on).join(rank_ic(preds, on), on))
