"""The whole run: bars to features, targets, folds, predictions, metrics and report tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import Settings
from tideline.functions.layout import DAILY, Series, fitted, forward_fill, with_position
from tideline.functions.safe import finite
from tideline.functions.skew import join_stats
from tideline.models.linear import linear_contribution_frames
from tideline.operators import align, cleaning, labels, selection
from tideline.operators.attribution import importance
from tideline.operators.ensemble import majority_vote, weighted_mean
from tideline.operators.features import DEFAULT_MODULES, features, log_volatility
from tideline.operators.folds import drop_bad_folds, fold_frames, fold_index, impute_frames, lengths, scale_folds, select_frames, unsplit, walk_forward_splits
from tideline.operators.metrics import classification_metrics, fold_summary, last_train_value, leaderboard, rank_ic, regime_metrics, regression_metrics
from tideline.operators.reports import comparison_table, performance_summary
from tideline.plans.registry import REGRESSION, model_job
from tideline.plans.transfer import transfer_matrix
from tideline.session import materialise
from tideline.sources.bars import preprocess
from tideline.sources.store import Attempt, ResultStore

ERRORS = ("mse", "rmse", "mae", "mape", "smape", "r2")
SCORES = ("accuracy", "f1", "precision", "recall")
KEYS = ("asset", "model", "task")
#: Not features: keys, targets and what targets are made of.
FIXED = ("asset", "ts", "vol5", "next_close", "next_return", "target_vol5", "target_vol5_log", "regime", "regime_code", "regime_threshold", "regime_strict", "regime_by_vol", "ret")


def feature_table(
    bars: DataFrame,
    settings: Settings,
    index_asset: str | None = None,
    proxy_asset: str | None = None,
    in_proxy_market: Column | None = None,
    series: Series = DAILY,
    pairs: align.Pairs = (),
    modules: Sequence[str] | None = None,
    least: int = 100,
) -> tuple[DataFrame, list[str], DataFrame]:
    """Features of every asset with target, regime and its code; the feature names; and the series left out, with reasons.

    Missing features are carried forward only: nothing is filled from rows that come later. ``pairs``: which correlations
    become columns, such as ``align.pairs_with(index, assets)``. The external index asset takes part as a joined column.
    ``least``: rows with a target that a series needs.
    """
    cfg = settings.features
    modules = modules or (("lagged",) if cfg.only_price_lags else DEFAULT_MODULES)
    base = features(bars, [*modules, "targets", "regimes"], cfg, series, extra=["ret"])
    names = [c for c in base.columns if c not in FIXED]
    target = "target_vol5_log" if cfg.use_log_target else "target_vol5"
    out = materialise(base.select("asset", "ts", *names, F.col(target).alias("y"), "ret", "regime_code", "regime"), "base")
    if pairs:
        partners = sorted({a for pair in pairs for a in pair})
        rets = align.returns(bars.filter(F.col("asset").isin(*partners)), series)
        corr = align.pair_columns(align.pair_correlations(rets, pairs, cfg.correlation_window, series=series), pairs)
        out = align.join_by_date(out, corr)
        names += [c for c in corr.columns if c != "ts"]
    if index_asset is not None:
        level = align.join_index(out.select("asset", "ts"), bars.filter(F.col("asset") == index_asset), series)
        out = materialise(out.join(level, ["asset", "ts"], "left"), "index")
        names += ["index_level", "index_change"]
    if proxy_asset is not None and in_proxy_market is not None:
        proxy = align.join_proxy(out.select("asset", "ts"), bars.filter(F.col("asset") == proxy_asset), in_proxy_market, series)
        out = out.join(proxy, ["asset", "ts"], "left")
        names += ["proxy_vol", "proxy_vol_change"]
    out = materialise(out.withColumns({c: finite(F.col(c).cast("double")) for c in names}), "joined")
    out = materialise(forward_fill(out, names, series).withColumn("y", labels.clip_target("y")), "carried")
    long = labels.align_targets(out, ["y", "regime_code"], least=least)
    varied = labels.drop_degenerate(long, "y", "regime_code")
    gone = labels.left_out(out, long, f"under {least} rows with a target").unionByName(labels.left_out(long, varied, "target or regime without variation"))
    return varied, names, gone


def prepared_frames(table: DataFrame, folds: DataFrame, names: Sequence[str], limit: float = 0.8, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Frames whose features are imputed, selected and scaled by the train rows of their fold, and the table of dropped
    features (asset, fold, feature). Nothing in it depends on test rows."""
    frames = materialise(impute_frames(fold_frames(table, folds), names), "frames")
    train = frames.filter(F.col("role") == "train")
    on = ("asset", "fold")
    corr = selection.target_correlations(train, names, ["y"], on)
    dropped = selection.kept_features(corr, limit, keep, on).filter("dropped").select(*on, "feature")
    dropped = materialise(dropped, "dropped")
    return scale_folds(select_frames(frames, dropped, names), names), dropped


def _explained(run: Attempt, name: str) -> str:
    return run.store.path(f"explained/{name}")


def predictions(
    run: Attempt, table: DataFrame, folds: DataFrame, frames: DataFrame, names: Sequence[str], models: Sequence[str], classifiers: Sequence[str], log_epsilon: float | None
) -> tuple[DataFrame, DataFrame]:
    """(asset, model, task, fold, ts, y_true, y_pred) of every model, and (model, task, seconds).

    Each model is a step of the run: its predictions are written when it has run, so none is fitted twice, also where a
    run is resumed. Seconds are those of fitting and predicting all folds, as Spark does the two together.
    """
    spark, parts, times = table.sparkSession, [], []
    columns = ("asset", "model", "task", "fold", "ts", "y_true", "y_pred")

    def fitted_by(name: str, task: str) -> DataFrame:
        job = model_job(name, task)
        target, classes = ("y", 0) if task == REGRESSION else ("regime_code", 3)
        if job.on_frames is not None:
            more = {"explained": _explained(run, name)} if job.explains and task == REGRESSION else {}
            preds = job.on_frames(frames, names, target, classes, **more)
        else:
            preds = job.on_rows(table, folds, [], target, classes)
        if job.of_returns and task == REGRESSION and log_epsilon is not None:
            preds = preds.withColumn("y_pred", log_volatility("y_pred", log_epsilon))
        tagged = preds.withColumns({"model": F.lit(name), "task": F.lit(task), "y_true": F.col("y_true").cast("double"), "y_pred": F.col("y_pred").cast("double")})
        return tagged.select(*columns)

    for task, chosen in (("regression", models), ("classification", classifiers)):
        for name in chosen:
            step = f"predictions_{task}_{name}"
            parts.append(run.step(step, lambda name=name, task=task: fitted_by(name, task), by=()).select(*columns))
            times.append((name, task, run.seconds[step]))
    both = reduce(DataFrame.unionByName, parts)
    for task, combine in (("regression", lambda p, m: weighted_mean(p, dict.fromkeys(m, 1.0))), ("classification", lambda p, m: majority_vote(p))):
        chosen = [n for n, t, _ in times if t == task and n not in ("naive", "last")]
        if len(chosen) > 1:
            voted = combine(both.filter((F.col("task") == task) & F.col("model").isin(*chosen)), chosen)
            both = both.unionByName(voted.withColumns({"task": F.lit(task), "model": F.lit("ensemble")}).select(*columns))
    return both, spark.createDataFrame(times, "model string, task string, seconds double")


def _digest(bars: DataFrame, config: dict) -> str:
    """Of the settings, and of all bars by a sum of their hashes."""
    rows = bars.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*bars.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([config, bars.columns, str(rows)], sort_keys=True).encode()).hexdigest()


def full_run(
    bars: DataFrame,
    settings: Settings,
    store: ResultStore,
    run_id: str,
    models: Sequence[str] = ("naive", "linear", "arx", "garch", "gbt", "forest"),
    classifiers: Sequence[str] = ("last", "gbt", "forest"),
    sources: Sequence[str] = (),
    export: bool = False,
    features_used: Sequence[str] | None = None,
    **context,
) -> dict[str, DataFrame]:
    """Run everything and write it below the store; returns the written tables.

    Every table is a step of an attempt, written and read back, which cuts the lineage at shared storage: the fits behind
    it are not repeated when executors are lost, nor when a run that broke off is called again with the same bars and
    settings. Readers see the tables of a run once all are written; a run that is repeated replaces them at once.
    ``sources``: assets whose linear models are scored on all others. ``features_used``: only these of the built features.
    """
    config = {"settings": settings.to_json(), "models": list(models), "classifiers": list(classifiers)}
    cfg = settings.features
    clean = preprocess(bars)
    chosen = {"sources": list(sources), "features_used": None if features_used is None else list(features_used), "context": {k: str(v) for k, v in sorted(context.items())}}
    run = store.attempt(run_id, _digest(clean, config | chosen))
    if not run.seconds:
        store.start_run(run_id, config)
    # buckets short enough that no chunk of a dense series grows beyond its size
    context["series"] = fitted(clean, context.get("series", DAILY))
    run.step("bar_checks", lambda: cleaning.validate_bars(clean), by=())
    if not run.done("excluded", "features"):
        table, names, gone = feature_table(clean, settings, **context)
        names = [n for n in names if features_used is None or n in features_used]
        run.step("excluded", lambda: gone, by=())
        run.step("features", lambda: with_position(table.select("asset", "ts", *names, "y", "ret", "regime_code", "regime"), context["series"]), by=("asset",))
    gone, table = run.load("excluded"), run.load("features")
    names = [c for c in table.columns if c not in (*FIXED, "y", "rn", "n")]
    sizes = lengths(table)
    folds = run.step("folds", lambda: walk_forward_splits(sizes, settings.splits), by=("asset",))
    short = unsplit(sizes, folds).select("asset", F.col("n").alias("rows"), F.lit("too short for a fold").alias("reason"))
    run.step("left_out", lambda: gone.unionByName(short), by=())
    if not run.done("dropped_features", "prepared"):
        frames, dropped = prepared_frames(table, folds, names, keep=cfg.keep_high_correlation)
        run.step("dropped_features", lambda: dropped, by=())
        run.step("prepared", lambda: frames, by=())
    frames = run.load("prepared")

    preds, times = predictions(run, table, folds, frames, names, models, classifiers, cfg.log_epsilon if cfg.use_log_target else None)
    expected = frames.filter(F.col("role") == "test").groupBy("asset", "fold").agg(F.count(F.lit(1)).alias("test_size"))
    preds = run.step("predictions", lambda: drop_bad_folds(preds, ("asset", "model", "task", "fold"), expected))
    reg, clf = preds.filter(F.col("task") == "regression"), preds.filter(F.col("task") == "classification")
    on = ["asset", "model", "task", "fold"]
    last = join_stats(frames.filter(F.col("role") == "test"), last_train_value(frames), ["asset", "fold"])
    base = regression_metrics(last.select("asset", "fold", F.col("y").alias("y_true"), F.col("last_value").alias("y_pred")), ["asset", "fold"])
    base = base.select("asset", "fold", *[F.col(c).alias(f"baseline_{c}") for c in ("mse", "mae", "r2")])
    errors = regression_metrics(reg, on).join(base, ["asset", "fold"], "left")
    per_fold = errors.unionByName(classification_metrics(clf, on), allowMissingColumns=True)
    per_fold = per_fold.join(times, ["model", "task"], "left").withColumnRenamed("seconds", "model_seconds")
    per_fold = run.step("fold_metrics", lambda: per_fold)
    summary = fold_summary(per_fold, [*ERRORS, *SCORES, "baseline_mse", "baseline_mae", "baseline_r2", "model_seconds"], KEYS)
    summary = run.step("metrics", lambda: summary)
    ranked = per_fold.filter(F.col("task") == "regression").join(rank_ic(reg, on), on, "left")
    board = run.step("ranking", lambda: leaderboard(ranked.withColumnRenamed("model_seconds", "fit_time_s")), by=())
    run.step("performance", lambda: performance_summary(summary), by=())
    run.step("comparison", lambda: comparison_table(summary), by=())
    run.step("fold_index", lambda: fold_index(frames), by=("asset",))
    regimes = reg.join(table.select("asset", "ts", "regime"), ["asset", "ts"], "left")
    run.step("regime_metrics", lambda: regime_metrics(regimes, KEYS, least=1))
    whole = selection.target_correlations(frames.filter(F.col("role") == "train"), names, ["y", "regime_code"])
    run.step("leakage", lambda: selection.leakage_table(whole, "y"), by=())
    written = ["bar_checks", "features", "folds", "left_out", "dropped_features", "predictions", "fold_metrics", "metrics", "performance", "comparison", "fold_index", "regime_metrics", "leakage"]
    explained = [m for m in models if model_job(m).explains]
    if explained or "linear" in models:
        columns = ("asset", "model", "fold", "ts", "feature", "value", "contribution")
        parts = [linear_contribution_frames(frames, names).select(*columns)] if "linear" in models else []
        parts += [run.store.spark.read.parquet(_explained(run, m)).withColumn("model", F.lit(m)).select(*columns) for m in explained]
        contributions = run.step("contributions", lambda: reduce(DataFrame.unionByName, parts).withColumn("task", F.lit("regression")))
        run.step("importance", lambda: importance(contributions, KEYS))
        written += ["contributions", "importance"]
    if sources:
        run.step("transfer", lambda: transfer_matrix(cleaning.fill_missing(table, names, context["series"]), names, "y", sources), by=())
        written.append("transfer")
    run.commit()
    store.save_leaderboard(board)
    if export:
        store.export_all(run_id, summary)
    view = store.view(run_id)
    return {n: view.load(n, run_id) for n in written} | {"leaderboard": store.load("leaderboard")}
