"""Tree ensembles with pyspark.ml: one fit per fold over all assets, or per parameter set.

Every fit is itself a distributed job, so a hot asset is spread over the cluster. The rows of the folds are written
once, partitioned by fold, so a fit reads its own files only; each fit writes its predictions to a table that is read
back whole. The driver submits one fit per fold number, however many assets there are. ``per_asset=True`` asks for a
model of each asset instead, which is one fit per (asset, fold) and meant for a few assets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.skew import join_stats
from tideline.models.contributions import tree_contributions
from tideline.operators.folds import fold_frames
from tideline.operators.metrics import regression_metrics
from tideline.session import shared_folder


def estimator(kind: str, task: str, classes: int = 2, seed: int = 42, **params):
    """Boosted trees (``gbt``) or a random forest (``forest``) for a task."""
    common = {"featuresCol": "features", "labelCol": "label", "seed": seed}
    if kind == "forest":
        cls = RandomForestRegressor if task == "regression" else RandomForestClassifier
        return cls(**{"numTrees": 100, "maxDepth": 5, **params}, **common)
    if task == "regression":
        return GBTRegressor(**{"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, **params}, **common)
    one = GBTClassifier(**{"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, **params}, **common)
    return one if classes == 2 else OneVsRest(classifier=one, featuresCol="features", labelCol="label")


def fit(train: DataFrame, features: Sequence[str], target: str, kind: str, task: str, classes: int = 2, weight: str | None = None, **params) -> PipelineModel:
    rows = train.na.drop(subset=[*features, target]).withColumn("label", F.col(target).cast("double"))
    est = estimator(kind, task, classes, **params)
    if weight is not None:
        est = est.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), est]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    out = model.transform(rows.na.drop(subset=[*features, target]))
    # probability of the last class (the positive one of two), where the model gives any
    prob = F.element_at(vector_to_array("probability"), -1) if "probability" in out.columns else F.lit(None).cast("double")
    out = out.withColumn("y_prob", prob)
    drop = [c for c in ("features", "rawPrediction", "probability") if c in out.columns]
    return out.withColumn("y_true", F.col(target)).withColumn("y_pred", F.col("prediction")).drop("prediction", *drop)


def balanced(train: DataFrame, target: str, ratio: float) -> tuple[DataFrame, str | None]:
    """``train`` with a weight per class where the largest class has at least ``ratio`` times the rows of the smallest."""
    counts = {r[0]: r[1] for r in train.groupBy(target).count().collect()}  # a row per class
    if len(counts) < 2 or max(counts.values()) < ratio * min(counts.values()):
        return train, None
    total, weight = sum(counts.values()), F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(target) == F.lit(value), total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("_weight", weight), "_weight"


def _written(frames: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[dict]]:
    """The rows as a table partitioned by the jobs' keys, and the keys. A rebalanced write splits large keys by size."""
    path = shared_folder(frames.sparkSession, "frames")
    frames.hint("rebalance", *(F.col(c) for c in by)).write.partitionBy(*by).parquet(path)
    table = frames.sparkSession.read.schema(frames.schema).parquet(path)
    return table, [r.asDict() for r in table.select(*by).distinct().orderBy(*by).collect()]


def tree_folds(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    target: str = "y",
    kind: str = "gbt",
    task: str = "regression",
    classes: int = 2,
    **options,
) -> DataFrame:
    """As ``tree_frames``, from rows and folds."""
    return tree_frames(fold_frames(rows, folds), features, target, kind, task, classes, **options)


def tree_frames(
    frames: DataFrame,
    features: Sequence[str],
    target: str = "y",
    kind: str = "gbt",
    task: str = "regression",
    classes: int = 2,
    threads: int = 4,
    per_asset: bool = False,
    imbalance: float = 5.0,
    explained: str | None = None,
    **params,
) -> DataFrame:
    """Walk-forward predictions of one tree model per fold over all assets, on prepared frames (fold, role).

    Each asset's mean train target of the fold is a feature, so the model tells assets apart. Classes are weighted where
    the largest train class is ``imbalance`` times the smallest or more. ``explained``: a folder for the contributions
    of each feature to each prediction (asset, fold, ts, feature, value, contribution, base), ``_level`` among them.
    """
    spark = frames.sparkSession
    frames = frames.select("asset", "fold", "role", "ts", target, *features).na.drop(subset=[target, *features])
    by, used = (["asset", "fold"] if per_asset else ["fold"]), list(features)
    if not per_asset:
        level = frames.filter(F.col("role") == "train").groupBy("asset", "fold").agg(F.avg(target).alias("_level"))
        frames, used = join_stats(frames, level, ["asset", "fold"]), [*used, "_level"]
    table, jobs = _written(frames, by)
    out = shared_folder(spark, "predictions")

    def one(job):
        number, chosen = job
        here = table
        for c, v in chosen.items():
            here = here.filter(F.col(c) == v)
        train, weight = here.filter(F.col("role") == "train"), None
        if task == "classification":
            train, weight = balanced(train, target, imbalance)
        model = fit(train, used, target, kind, task, classes, weight, **params)
        scored = predict(model, here.filter(F.col("role") == "test"), used, target)
        scored.select("asset", "fold", "ts", F.col("y_true").cast("double"), "y_pred", "y_prob").write.parquet(f"{out}/job={number}")
        if explained is not None:
            tree_contributions(model, here.filter(F.col("role") == "test"), used, ["asset", "fold", "ts"]).write.mode("overwrite").parquet(f"{explained}/job={number}")

    with ThreadPool(threads) as pool:
        pool.map(one, list(enumerate(jobs)))
    kinds = dict(frames.dtypes)
    schema = f"asset string, fold {kinds['fold']}, ts {kinds['ts']}, y_true double, y_pred double, y_prob double, job int"
    scored = spark.read.schema(schema).parquet(out) if jobs else spark.createDataFrame([], schema)
    return scored.select("asset", F.lit(kind).alias("model"), "fold", "ts", "y_true", "y_pred", "y_prob")


def grid_search(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    target: str,
    grid: dict[str, Sequence],
    kind: str = "gbt",
    threads: int = 4,
) -> DataFrame:
    """Cross-validated RMSE per parameter set over expanding time folds: mean, deviation, rank.

    All assets are pooled; each fold takes its own position range of every asset. A fit sends one row, its error.
    """
    spark = rows.sparkSession
    frames = fold_frames(rows, folds).select("asset", "fold", "role", "ts", target, *features)
    table, jobs = _written(frames, ["fold"])
    sets = [dict(zip(grid, values)) for values in product(*grid.values())]

    def one(job):
        params, chosen = job
        here = table.filter(F.col("fold") == chosen["fold"])
        model = fit(here.filter(F.col("role") == "train"), features, target, kind, "regression", **params)
        scored = predict(model, here.filter(F.col("role") == "test"), features, target)
        label = ", ".join(f"{k}={v}" for k, v in params.items())
        return label, chosen["fold"], regression_metrics(scored, []).select("rmse").first()[0]

    with ThreadPool(threads) as pool:
        errors = pool.map(one, [(s, f) for s in sets for f in jobs])
    per = spark.createDataFrame(errors, "params string, fold long, rmse double")
    out = per.groupBy("params").agg(F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"), F.count(F.lit(1)).alias("folds"))
    best = out.agg(F.min_by("params", "rmse_mean").alias("p")).scalar()
    return out.withColumn("is_best", F.col("params") == best)


#: Fits whose scores are entered in the ledger at once.
ENTRIES = 16


def halving_search(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    target: str,
    grid: dict[str, Sequence],
    kind: str = "gbt",
    task: str = "regression",
    classes: int = 2,
    keep: int = 3,
    threads: int = 4,
    ledger: str | None = None,
) -> DataFrame:
    """(params, folds, score, rank): parameter sets by successive halving over expanding time folds.

    Every set is scored on the first fold; of those left, the best ``keep``-th part by mean score goes on to the next fold,
    whose train rows hold all before, until one set is left or the folds end. The score is the RMSE, or the share of wrong
    classes. Fits run side by side, and scores are appended to the table ``ledger``: a search that is called again with
    the same folder repeats no fit. Sets that go further rank before those that do not.
    """
    from tideline.sources.store import exists

    spark = rows.sparkSession
    ledger = ledger or shared_folder(spark, "ledger")
    frames = fold_frames(rows, folds).select("asset", "fold", "role", "ts", target, *features)
    table, jobs = _written(frames, ["fold"])
    sets = {", ".join(f"{k}={v}" for k, v in zip(grid, values, strict=True)): dict(zip(grid, values, strict=True)) for values in product(*grid.values())}
    scores = {(r["params"], r["fold"]): r["score"] for r in spark.read.parquet(ledger).collect()} if exists(spark, ledger) else {}  # a row per fit

    def one(job):
        label, fold = job
        here = table.filter(F.col("fold") == fold)
        model = fit(here.filter(F.col("role") == "train"), features, target, kind, task, classes, **sets[label])
        scored = predict(model, here.filter(F.col("role") == "test"), features, target)
        wrong = F.avg((F.col("y_pred") != F.col("y_true")).cast("double"))
        score = scored.agg(wrong if task == "classification" else F.sqrt(F.avg((F.col("y_pred") - F.col("y_true")) ** 2))).first()[0]
        return label, fold, score

    def enter(found: list[tuple]) -> None:
        if found:
            spark.createDataFrame(found, "params string, fold long, score double").coalesce(1).write.mode("append").parquet(ledger)
            scores.update({(label, fold): score for label, fold, score in found})

    alive, done, ranked = list(sets), [], []
    with ThreadPool(threads) as pool:
        for fold in [j["fold"] for j in jobs]:
            held: list[tuple] = []
            for result in pool.imap_unordered(one, [(label, fold) for label in alive if (label, fold) not in scores]):
                held.append(result)
                if len(held) == ENTRIES:
                    enter(held)
                    held = []
            enter(held)
            done.append(fold)
            mean = {label: sum(scores[label, f] for f in done) / len(done) for label in alive}
            alive.sort(key=lambda label: (mean[label], label))
            left = 1 if fold == jobs[-1]["fold"] else max(1, len(alive) // keep)
            ranked = [(label, len(done), mean[label]) for label in alive[left:]] + ranked
            best, alive = (alive[0], len(done), mean[alive[0]]), alive[:left]
            if len(alive) == 1:
                break
    return spark.createDataFrame([(*r, i) for i, r in enumerate([best, *ranked], 1)], "params string, folds long, score double, rank long")


def feature_importances(model: PipelineModel, spark, features: Sequence[str]) -> DataFrame:
    """Split-based importances of a fitted tree model, one row per configured feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, map(float, values))), "feature string, importance double")


def permuted(rows: DataFrame, feature: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows whose ``feature`` comes from another row of the same series.

    Position rn takes the value at (a rn + c) mod n, a one-to-one map for a prime a that
    does not divide n: an equality join on position, spread over the cluster. Needs rn, n.
    """
    a = F.when(F.col("n") % 7919 != 0, 7919).otherwise(104729)
    there = (F.col("rn") * a + 1543) % F.col("n")
    source = rows.select(*keys, F.col("rn").alias("_from"), F.col(feature).alias("_other"))
    moved = rows.withColumn("_from", there).join(source, [*keys, "_from"], "left")
    return moved.withColumn(feature, F.col("_other")).drop("_from", "_other")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, rmse_increase): error with one feature permuted minus the plain error.

    ``rows`` must be complete; positions are renumbered by the caller.
    """
    base = regression_metrics(predict(model, rows, features, target), []).select(F.col("rmse").alias("_base"))
    parts = []
    for f in features:
        scored = predict(model, permuted(rows, f), features, target)
        parts.append(regression_metrics(scored, []).select(F.lit(f).alias("feature"), "rmse"))
    both = reduce(DataFrame.unionByName, parts).withColumn("_base", base.scalar())
    return both.select("feature", (F.col("rmse") - F.col("_base")).alias("rmse_increase"), F.col("_base").alias("rmse"))
