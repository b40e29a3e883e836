"""One registry of models by name and task, for the walk-forward evaluation, the uniform comparison and the whole run.

A job predicts from plain rows and folds, from frames whose features are prepared per fold, or either way:

* ``on_rows(rows, folds, features, target, classes)``: rows (asset, ts, rn, ret, y, features);
* ``on_frames(frames, features, target, classes, **more)``: rows of every fold with ``fold`` and ``role``.

Both return (asset, fold, ts, y_true, y_pred). Classifiers of ``classes`` labels 0, 1, ...
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.skew import join_stats
from tideline.models.garch import garch_folds
from tideline.models.linear import arx_folds, linear_folds, linear_frames
from tideline.models.trees import tree_folds, tree_frames
from tideline.operators.folds import fold_frames
from tideline.operators.labels import volatility_classes
from tideline.operators.metrics import last_train_value, naive_predictions

REGRESSION, CLASSIFICATION = "regression", "classification"


@dataclass(frozen=True)
class ModelJob:
    on_rows: Callable[..., DataFrame] | None = None
    on_frames: Callable[..., DataFrame] | None = None
    #: Only rows that have all features are predicted.
    whole_rows: bool = False
    #: ``on_frames`` takes a folder ``explained`` for the contributions of features.
    explains: bool = False
    #: Forecasts volatility from returns, whatever the target's scale.
    of_returns: bool = False


REGISTRY: dict[tuple[str, str], ModelJob] = {}
ALIASES = {"arima": "arx", "xgboost": "gbt", "boosting": "gbt", "random_forest": "forest"}


def register(name: str, task: str, job: ModelJob) -> None:
    REGISTRY[name, task] = job


def model_job(name: str, task: str = REGRESSION) -> ModelJob:
    key = ALIASES.get(name.lower(), name.lower()), task
    if key not in REGISTRY:
        raise ValueError(f"unknown model {name!r} of {task}; available: {sorted(n for n, t in REGISTRY if t == task)}")
    return REGISTRY[key]


def predict_folds(name: str, task: str, rows: DataFrame, folds: DataFrame, features, target: str, classes: int) -> DataFrame:
    job = model_job(name, task)
    if job.on_rows is not None:
        return job.on_rows(rows, folds, features, target, classes)
    return job.on_frames(fold_frames(rows, folds), features, target, classes)


def last_class(frames: DataFrame, features, target: str, classes: int = 0) -> DataFrame:
    """Test rows predicted by the last train label of their fold."""
    last = last_train_value(frames, target)
    test = join_stats(frames.filter((F.col("role") == "test") & F.col(target).isNotNull()), last, ["asset", "fold"])
    return test.select("asset", "fold", "ts", F.col(target).cast("double").alias("y_true"), F.col("last_value").cast("double").alias("y_pred"))


def by_volatility(forecast: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A classifier from forecasts of volatility: classes by the logistic map of a fold's forecasts about their median,
    calm ones highest. Labels are 0, 1 and 2; of two, the upper."""

    def run(rows: DataFrame, folds: DataFrame, features, target: str, classes: int) -> DataFrame:
        preds = forecast(rows, folds, features).select("asset", "fold", "ts", "y_pred")
        classed = volatility_classes(preds, "y_pred", ("asset", "fold"))
        label = F.col("vol_class") if classes > 2 else (F.col("prob") >= 0.5).cast("int")
        truth = rows.filter(F.col(target).isNotNull()).select("asset", "ts", F.col(target).cast("double").alias("y_true"))
        return classed.join(truth, ["asset", "ts"]).select("asset", "fold", "ts", "y_true", label.cast("double").alias("y_pred"))

    return run


def _task(classes: int) -> str:
    return CLASSIFICATION if classes else REGRESSION


def _trees(kind: str) -> ModelJob:
    return ModelJob(
        lambda rows, folds, features, target, classes: tree_folds(rows, folds, features, target, kind, _task(classes), classes),
        lambda frames, features, target, classes, **more: tree_frames(frames, features, target, kind, _task(classes), classes, **more),
        whole_rows=True,
        explains=True,
    )


def _arx(rows: DataFrame, folds: DataFrame, features, *_) -> DataFrame:
    return arx_folds(rows, folds, features)


def _garch(rows: DataFrame, folds: DataFrame, *_) -> DataFrame:
    return garch_folds(rows, folds)


register("naive", REGRESSION, ModelJob(on_frames=lambda frames, features, target, classes: naive_predictions(frames, target)))
register("linear", REGRESSION, ModelJob(
    lambda rows, folds, features, target, classes: linear_folds(rows, folds, features, target),
    lambda frames, features, target, classes: linear_frames(frames, features, target),
    whole_rows=True,
))
register("ridge", REGRESSION, ModelJob(
    lambda rows, folds, features, target, classes: linear_folds(rows, folds, features, target, name="ridge", ridge=0.1),
    lambda frames, features, target, classes: linear_frames(frames, features, target, name="ridge", ridge=0.1),
    whole_rows=True,
))
register("arx", REGRESSION, ModelJob(_arx, whole_rows=True))
register("garch", REGRESSION, ModelJob(_garch, of_returns=True))
register("last", CLASSIFICATION, ModelJob(on_frames=last_class))
register("arx", CLASSIFICATION, ModelJob(by_volatility(_arx), whole_rows=True))
register("garch", CLASSIFICATION, ModelJob(by_volatility(_garch)))
for _kind in ("gbt", "forest"):
    for _t in (REGRESSION, CLASSIFICATION):
        register(_kind, _t, _trees(_kind))
