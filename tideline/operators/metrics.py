"""Regression and classification metrics over a predictions table, and their summaries.

A predictions table is long: keys (asset, model, fold, ...), ts, y_true, y_pred, y_prob.
Every metric is a partial aggregate over its keys, so one hot key is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.ranks import average_ranks, ordered_totals
from tideline.functions.safe import corr, finite
from tideline.functions.skew import join_stats

FOLD_KEYS = ("asset", "model", "fold")


def _err() -> Column:
    return F.col("y_true") - F.col("y_pred")


def mse() -> Column:
    return F.avg(_err() * _err())


def mae() -> Column:
    return F.avg(F.abs(_err()))


def mape(eps: float = 1e-8, scale: float = 1.0) -> Column:
    return F.avg(F.abs(_err()) / F.greatest(F.abs(F.col("y_true")), F.lit(eps))) * scale


def smape(eps: float = 1e-8) -> Column:
    return F.avg(F.abs(_err()) / (F.abs(F.col("y_true")) + F.abs(F.col("y_pred")) + eps)) * 2.0


def r2() -> Column:
    """1 - SS_res / SS_tot, NULL where y does not vary (variance is merged stably)."""
    total = F.var_pop("y_true") * F.count("y_true")
    return 1 - F.try_divide(F.sum(_err() * _err()), total)


def volatility_ratio(eps: float = 1e-8) -> Column:
    return F.stddev_pop("y_pred") / (F.stddev_pop("y_true") + eps)


def regression_metrics(preds: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    return preds.groupBy(*keys).agg(
        mse().alias("mse"),
        F.sqrt(mse()).alias("rmse"),
        mae().alias("mae"),
        mape().alias("mape"),
        smape().alias("smape"),
        r2().alias("r2"),
        volatility_ratio().alias("vol_ratio"),
        F.count(F.lit(1)).alias("test_size"),
    )


def direction_accuracy(preds: DataFrame, keys: Sequence[str] = FOLD_KEYS, time: str = "ts") -> DataFrame:
    """Share of equal signs of successive differences; one window per fold, of bounded size."""
    w = Window.partitionBy(*keys).orderBy(time)
    steps = preds.select(
        *keys,
        F.signum(F.col("y_true") - F.lag("y_true", 1).over(w)).alias("_a"),
        F.signum(F.col("y_pred") - F.lag("y_pred", 1).over(w)).alias("_b"),
    )
    return steps.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).groupBy(*keys).agg(
        F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("direction_accuracy")
    )


def rank_ic(preds: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """Correlation of the average ranks of y_true and y_pred within a fold.

    A fold's validation block has a set number of rows, so a window per fold is bounded;
    groups without such a bound go through ``rank_ic_large``.
    """
    pairs = preds.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (
        F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1
    ) / 2
    ranked = pairs.select(*keys, rank("y_true").alias("_ra"), rank("y_pred").alias("_rb"))
    return ranked.groupBy(*keys).agg(corr("_ra", "_rb").alias("ic"))


def rank_ic_large(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``rank_ic`` for groups of any size, from exact distributed ranks."""
    keys = list(keys)
    pairs = preds.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).select(*keys, "y_true", "y_pred")
    a = average_ranks(pairs, keys, "y_true", "_ra")
    b = average_ranks(pairs, keys, "y_pred", "_rb")
    return pairs.join(a, [*keys, "y_true"]).join(b, [*keys, "y_pred"]).groupBy(*keys).agg(corr("_ra", "_rb").alias("ic"))


# ---- classification -------------------------------------------------------------------


def confusion(preds: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    return preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(preds: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """Support, precision, recall and F1 of every class present in y_true (0 where undefined)."""
    keys = list(keys)
    conf = confusion(preds, keys)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    actual = conf.groupBy(*keys, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("_tp"))
    guessed = conf.groupBy(*keys, F.col("y_pred").alias("label")).agg(F.sum("n").alias("_guessed"))
    zero = F.lit(0.0)
    both = actual.join(guessed, [*keys, "label"], "left")
    both = both.withColumn("recall", F.col("_tp") / F.col("support"))
    both = both.withColumn("precision", F.coalesce(F.try_divide(F.col("_tp"), F.col("_guessed")), zero))
    pr = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), pr), zero))


def classification_metrics(preds: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """Accuracy, support-weighted precision/recall/F1 and balanced accuracy."""
    per = class_scores(preds, keys)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return per.groupBy(*keys).agg(
        (F.sum("_tp") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1"),
        F.avg("recall").alias("balanced_accuracy"),
        F.sum("support").alias("test_size"),
    )


def _clipped(p: str, eps: float = 1e-15) -> Column:
    return F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))


def log_loss() -> Column:
    p = _clipped("y_prob")
    return -F.avg(F.when(F.col("y_true") == 1, F.log(p)).otherwise(F.log(1 - p)))


def binary_metrics(preds: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, F1, precision, recall of the positive class at a threshold, and log loss."""
    up, pos = F.col("y_prob") >= threshold, F.col("y_true") == 1
    counts = preds.groupBy(*keys).agg(
        F.count_if(up & pos).alias("tp"),
        F.count_if(up & ~pos).alias("fp"),
        F.count_if(~up & pos).alias("fn"),
        F.count_if(~up & ~pos).alias("tn"),
        log_loss().alias("log_loss"),
    )
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *keys,
        div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        div(tp, tp + fp).alias("precision"),
        div(tp, tp + fn).alias("recall"),
        "log_loss",
    )


def roc_auc(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve from exact tie-aware rank sums; NULL with one class."""
    pos, neg = (F.col("y_true") == 1).cast("bigint"), (F.col("y_true") != 1).cast("bigint")
    table = ordered_totals(preds, keys, "y_prob", {"pos": pos, "neg": neg})
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    return table.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("roc_auc"))


# The thresholds tried, 0.1 to 0.8.
THRESHOLDS = tuple(0.1 + 0.1 * i for i in range(8))


def tune_threshold(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold of best weighted F1 (the smallest on ties), from one pass of counts."""
    pos = F.col("y_true") == 1
    counts = [F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_q")]
    for i, t in enumerate(THRESHOLDS):
        up = F.col("y_prob") >= t
        counts += [F.count_if(up & pos).alias(f"_tp{i}"), F.count_if(up & ~pos).alias(f"_fp{i}")]
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double")), F.lit(0.0))
    tries = []
    p, q = F.col("_p"), F.col("_q")
    for i, t in enumerate(THRESHOLDS):
        tp, fp = F.col(f"_tp{i}"), F.col(f"_fp{i}")
        score = (f1(tp, fp, p - tp) * p + f1(q - fp, p - tp, fp) * q) / (p + q)
        tries.append(F.struct(F.round(score, 12).alias("f1"), F.lit(-t).alias("neg")))
    best = F.array_max(F.array(*tries))
    out = preds.groupBy(*keys).agg(*counts).withColumn("_best", best)
    return out.select(*keys, (-F.col("_best.neg")).alias("optimal_threshold"), F.col("_best.f1").alias("f1_optimized"))


# ---- baselines ------------------------------------------------------------------------


def last_train_value(frames: DataFrame, target: str = "y", keys: Sequence[str] = ("asset", "fold"), time: str = "ts") -> DataFrame:
    train = frames.filter((F.col("role") == "train") & F.col(target).isNotNull())
    return train.groupBy(*keys).agg(F.max_by(target, time).alias("last_value"))


def naive_predictions(frames: DataFrame, target: str = "y", keys: Sequence[str] = ("asset", "fold"), time: str = "ts") -> DataFrame:
    """Test rows predicted by the last train value of their fold."""
    last = last_train_value(frames, target, keys, time)
    test = frames.filter((F.col("role") == "test") & F.col(target).isNotNull())
    return join_stats(test, last, keys, salt=(time,)).select(*keys, time, F.col(target).alias("y_true"), F.col("last_value").alias("y_pred"))


def last_sign_predictions(frames: DataFrame, target: str = "y", keys: Sequence[str] = ("asset", "fold"), time: str = "ts") -> DataFrame:
    """Test rows predicted as 1 where the last train target is positive, else 0."""
    rows = naive_predictions(frames, target, keys, time)
    return rows.withColumn("y_pred", (F.col("y_pred") > 0).cast("int"))


# ---- summaries ------------------------------------------------------------------------


def fold_summary(metrics: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset", "model"), pop: bool = False) -> DataFrame:
    """Mean and deviation over folds (sample, or population); missing and infinite skipped."""
    std = F.stddev_pop if pop else F.stddev_samp
    out = [F.count(F.lit(1)).alias("n_splits")]
    for c in cols:
        out += [F.avg(finite(c)).alias(c), std(finite(c)).alias(f"{c}_std")]
    return metrics.groupBy(*keys).agg(*out)


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Per model: mean and deviation of mse, mae, ic, and mean fit and prediction time."""
    cols = []
    for c in ("mse", "mae", "ic"):
        cols += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    cols += [F.avg(c).alias(f"{c}_mean") for c in ("fit_time_s", "pred_time_s") if c in metrics.columns]
    return metrics.groupBy("model").agg(*cols)


def regime_metrics(preds: DataFrame, keys: Sequence[str] = ("asset", "model"), least: int = 10) -> DataFrame:
    """Errors per regime label, for regimes of at least ``least`` rows."""
    out = preds.filter(F.col("regime").isNotNull()).groupBy(*keys, "regime").agg(
        mse().alias("mse"), F.sqrt(mse()).alias("rmse"), mae().alias("mae"), mape().alias("mape"), F.count(F.lit(1)).alias("n")
    )
    return out.filter(F.col("n") >= least)


def class_imbalance(rows: DataFrame, label: str = "label", keys: Sequence[str] = ("asset",), limit: float = 5.0) -> DataFrame:
    """Largest over smallest class count, and whether it calls for balancing."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_k"))
    share = counts.groupBy(*keys).agg((F.max("_k") / F.min("_k")).alias("imbalance"))
    return share.withColumn("balance", F.col("imbalance") >= limit)


def class_weights(rows: DataFrame, label: str = "label", keys: Sequence[str] = ("asset",), limit: float = 5.0) -> DataFrame:
    """Row weights n / (classes * class count) for imbalanced groups, else 1."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_k"))
    totals = counts.groupBy(*keys).agg(
        F.sum("_k").alias("_all"), F.count(F.lit(1)).alias("_classes"), (F.max("_k") / F.min("_k")).alias("_ratio")
    )
    weight = F.when(F.col("_ratio") >= limit, F.col("_all") / (F.col("_classes") * F.col("_k"))).otherwise(F.lit(1.0))
    table = counts.join(totals, list(keys)).select(*keys, label, weight.alias("weight"))
    return join_stats(rows, table, [*keys, label])
