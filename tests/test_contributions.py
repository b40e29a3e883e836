"""Contributions of trees against the sum over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tideline.models import contributions as C
from tideline.models import trees

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    y = x[:, 0] * 2 + np.where(x[:, 1] > 0.3, 3, 0) * x[:, 2] + rng.normal(0, 0.1, 500)
    pdf = pd.DataFrame(x, columns=NAMES).assign(id=np.arange(500), y=y, up=(y > 0).astype(int))
    return pdf, spark.createDataFrame(pdf).persist()


def value_of(nodes, tree, number, x, known, leaf):
    """The prediction where splits on features outside ``known`` go both ways by their share."""
    node = nodes[tree, number]
    if node["leftChild"] < 0:
        return leaf[tree, number]
    left, right = nodes[tree, node["leftChild"]], nodes[tree, node["rightChild"]]
    f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    parts = [value_of(nodes, tree, c["id"], x, known, leaf) for c in (left, right)]
    if f in known:
        return parts[0] if x[f] <= cut else parts[1]
    return (parts[0] * left["rawCount"] + parts[1] * right["rawCount"]) / node["rawCount"]


def shapley(nodes, x, leaf):
    m, out = len(x), np.zeros(len(x))
    count = len({t for t, _ in nodes})
    worth = {s: sum(value_of(nodes, t, 0, x, s, leaf) for t in range(count)) for k in range(m + 1) for s in combinations(range(m), k)}
    for f in range(m):
        for s in worth:
            if f not in s:
                weight = factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m)
                out[f] += weight * (worth[tuple(sorted((*s, f)))] - worth[s])
    return out, worth[()]


CASES = [("gbt", "regression", "y", {"maxIter": 5, "maxDepth": 4}), ("forest", "regression", "y", {"numTrees": 4, "maxDepth": 6}), ("forest", "classification", "up", {"numTrees": 3, "maxDepth": 4}), ("gbt", "classification", "up", {"maxIter": 4, "maxDepth": 3})]


@pytest.mark.parametrize("kind, task, target, params", CASES)
def test_contributions_equal_all_subsets_and_add_up(spark, rows, kind, task, target, params, monkeypatch):
    pdf, df = rows
    model = trees.fit(df, NAMES, target, kind, task, **params)
    long = C.tree_contributions(model, df, NAMES, ["id"])
    got = long.toPandas().pivot(index="id", columns="feature", values="contribution")[NAMES].to_numpy()
    base = long.first()["base"]
    scored = model.transform(df)
    if task == "regression":
        wanted = F.col("prediction")
    else:
        wanted = F.get(vector_to_array("rawPrediction" if kind == "gbt" else "probability"), F.lit(1))
    wanted = scored.select("id", wanted.cast("double").alias("p")).toPandas().sort_values("id").p.to_numpy()
    np.testing.assert_allclose(got.sum(1) + base, wanted, rtol=1e-9, atol=1e-9)
    path = str(C.shared_folder(spark, "nodes"))
    model.stages[-1].write().save(path)
    table = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    nodes = {(r["treeID"], r["id"]): r for r in table}
    leaf = C._leaf_values(model.stages[-1], table)
    for i in range(0, 500, 50):
        want, start = shapley(nodes, pdf.loc[i, NAMES].to_numpy(float), leaf)
        np.testing.assert_allclose(got[i], want, rtol=1e-9, atol=1e-9)
        assert abs(start - base) < 1e-9
    # paths too long for a table
    forest = C.ensemble_leaves(model, spark)
    monkeypatch.setattr(C, "TABLE", 1)
    np.testing.assert_allclose(C.contributions_of(forest, pdf[NAMES].to_numpy()), got, rtol=1e-9, atol=1e-9)
