"""Regimes from a three-state Gaussian mixture of returns per market."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("Bear", "Sideways", "Bull")


def mixture_regimes(rets: DataFrame, markets: list[str], market: str = "market", k: int = 3, seed: int = 42, rounds: int = 50) -> DataFrame:
    """(asset, ts, state, regime): states ordered by mean return, lowest Bear, highest Bull.

    One distributed fit per configured market; states in between are Sideways.
    """
    parts = []
    rows = rets.filter(F.col("ret").isNotNull())
    assemble = VectorAssembler(inputCols=["ret"], outputCol="features")
    for m in markets:
        here = assemble.transform(rows.filter(F.col(market) == m))
        model = GaussianMixture(k=k, seed=seed, maxIter=rounds).fit(here)
        means = [float(g.mean[0]) for g in model.gaussians]
        order = sorted(range(len(means)), key=means.__getitem__)
        names = {s: "Bear" if i == 0 else "Bull" if i == len(order) - 1 else "Sideways" for i, s in enumerate(order)}
        label = reduce(lambda acc, s: acc.when(F.col("state") == s, names[s]), order, F.when(F.lit(False), ""))
        scored = model.transform(here).withColumnRenamed("prediction", "state")
        top = F.array_max(vector_to_array("probability"))
        parts.append(scored.select("asset", "ts", F.lit(m).alias(market), "ret", "state", label.alias("regime"), top.alias("certainty")))
    return reduce(DataFrame.unionByName, parts)
