"""Additive contributions of features to the predictions of fitted trees, exact by row.

The value of a set of features is the prediction that a row gets when splits on other features send it both ways, each by
its share of the train rows (path-dependent expectation); contributions are the Shapley values of that game. A leaf's path
is an interval per feature on it and the share of train rows that stay inside, so a leaf contributes by which of its
intervals hold the row: a table with a row per such pattern, worked out once per leaf. Tasks look the patterns up for whole
Arrow batches. The leaves of a model are bounded by its trees and depth, and are broadcast; rows stay where they are.

Per row, the contributions and the base add up to the prediction: that of a regression, the margin of boosted classifiers,
or the probability of the last class of a forest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_folder

#: Features on a path up to which a leaf keeps a table of all patterns.
TABLE = 6


@dataclass(frozen=True)
class Leaf:
    """``features`` on its path, their intervals (low, high], the shares of train rows inside, and its weighted value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float

    def credits(self, inside: np.ndarray) -> np.ndarray:
        """Contributions (rows, features) for patterns (rows, features) of zeros and ones."""
        m = len(self.features)
        out = np.zeros(inside.shape)
        weights = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
        for f in range(m):
            # coefficient s: the sum over sets of s other features, inside for those and by share for the rest
            sets = np.zeros((len(inside), m))
            sets[:, 0] = 1.0
            for j in range(m):
                if j != f:
                    more = sets[:, :-1] * inside[:, j, None]
                    sets *= self.share[j]
                    sets[:, 1:] += more
            out[:, f] = self.value * (sets @ weights) * (inside[:, f] - self.share[f])
        return out


@dataclass(frozen=True)
class Forest:
    leaves: list[Leaf]
    base: float


def _leaf_values(stage, rows: list) -> dict[tuple[int, int], float]:
    boosted = len(set(stage.treeWeights)) > 1 or type(stage).__name__.startswith("GBT")
    probability = not boosted and "Classification" in type(stage).__name__
    trees = len(stage.treeWeights)

    def value(r) -> float:
        if boosted:
            return stage.treeWeights[r["treeID"]] * r["prediction"]
        if probability:
            return r["impurityStats"][-1] / (sum(r["impurityStats"]) * trees)
        return r["prediction"] / trees

    return {(r["treeID"], r["id"]): value(r) for r in rows}


def ensemble_leaves(model: PipelineModel, spark: SparkSession) -> Forest:
    """The leaves of the last stage, from its node table. Only splits at a threshold are understood."""
    stage = model.stages[-1]
    path = shared_folder(spark, "tree_nodes")
    stage.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # nodes of one bounded model
    nodes = {(r["treeID"], r["id"]): r for r in rows}
    values = _leaf_values(stage, rows)
    leaves, base = [], 0.0

    def walk(tree: int, number: int, held: dict[int, tuple[float, float, float]]) -> None:
        nonlocal base
        node = nodes[tree, number]
        if node["leftChild"] < 0:
            names = sorted(held)
            low, high, share = (np.array([held[f][k] for f in names], float) for k in range(3))
            leaves.append(Leaf(np.array(names, int), low, high, share, values[tree, number]))
            base += values[tree, number] * float(share.prod())
            return
        split = node["split"]
        if split["numCategories"] >= 0:
            raise ValueError("contributions need splits at thresholds")
        f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        low, high, share = held.get(f, (-np.inf, np.inf, 1.0))
        for child, ends in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
            walk(tree, child, held | {f: (*ends, share * nodes[tree, child]["rawCount"] / node["rawCount"])})

    for tree in sorted({t for t, _ in nodes}):
        walk(tree, 0, {})
    return Forest(leaves, base)


def _patterns(m: int) -> np.ndarray:
    return (np.arange(2**m)[:, None] >> np.arange(m) & 1).astype(float)


def contributions_of(forest: Forest, x: np.ndarray, tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """(rows, features) for a matrix of feature values; ``tables`` keeps the leaves' patterns between calls."""
    out = np.zeros(x.shape)
    tables = {} if tables is None else tables
    for i, leaf in enumerate(forest.leaves):
        m = len(leaf.features)
        if not m:
            continue
        at = x[:, leaf.features]
        inside = (at > leaf.low) & (at <= leaf.high)
        if m <= TABLE:
            if i not in tables:
                tables[i] = leaf.credits(_patterns(m))
            out[:, leaf.features] += tables[i][inside @ (1 << np.arange(m))]
        else:
            out[:, leaf.features] += leaf.credits(inside.astype(float))
    return out


def tree_contributions(model: PipelineModel, rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value, contribution, base): a row per complete row and feature."""
    features, keep, spark = list(features), list(keep), rows.sparkSession
    forest = spark.sparkContext.broadcast(ensemble_leaves(model, spark))
    whole = rows.na.drop(subset=features).select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
    kinds = dict(whole.dtypes)
    typed = ", ".join(f"`{c}` {kinds[c]}" for c in keep)

    def explain(batches):
        import pyarrow as pa

        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            n, k = x.shape
            credit = contributions_of(forest.value, x, tables)
            rows = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in range(len(keep))), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(x.ravel()), pa.array(credit.ravel()), pa.array(np.full(n * k, forest.value.base))],
                names=[*keep, "_f", "value", "contribution", "base"],
            )

    out = whole.mapInArrow(explain, f"{typed}, _f int, value double, contribution double, base double")
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("_f"))
    return out.select(*keep, name.alias("feature"), "value", "contribution", "base")
