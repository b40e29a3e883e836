"""Exact quantiles and ranks of groups too large for one task.

Quantiles: a mergeable sketch gives, for each wanted rank, two values that enclose it. A second pass over the rows counts
the rows between such brackets and keeps the distinct values inside them, about a thousandth of the rows per rank, so no
other row is dealt out. Of the rows between brackets the least and greatest value are known as well, so ranks at their
ends are exact too. Results do not depend on the sketch; a rank that it failed to enclose would be an error.

Ranks of all rows: distinct values with their counts are dealt out by range of (group, value), as evenly as the number of
shuffle partitions allows; range totals and a running sum over that small table give every range its exact offset, and
windows run inside one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.skew import join_stats
from tideline.session import materialise

#: Rank error of the sketch is a share of 1 / ACCURACY; brackets reach four times as far.
ACCURACY = 10_000
REACH = 4 / ACCURACY


def ordered_totals(
    df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values with, per weight w: its sum ``w``, ``w_before`` and ``w_total``.

    ``w_before`` counts the rows of smaller value in the same group.
    """
    keys = list(keys)
    weights = weights or {"n": F.lit(1)}
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(expr).alias(name) for name, expr in weights.items()])
    )
    # written, so that both uses see the same ranges
    ranged = materialise(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    ahead = per_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(*[F.sum(w).alias(f"_{w}_sum") for w in weights])
        .select(
            *keys,
            "_range",
            *[F.coalesce(F.sum(f"_{w}_sum").over(ahead), F.lit(0)).alias(f"_{w}_off") for w in weights],
            *[F.sum(f"_{w}_sum").over(per_key).alias(f"{w}_total") for w in weights],
        )
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = {
        f"{w}_before": F.col(f"_{w}_off") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights
    }
    return (
        ranged.join(offsets, [*keys, "_range"])
        .withColumns(before)
        .drop("_range", *[f"_{w}_off" for w in weights])
    )


def _brackets(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, _b): the enclosing values of each rank, rising. Lowest and highest ranks are open to their side."""
    lower = [max(p - REACH, 0.0) for p in probs]
    upper = [min(p + REACH, 1.0) for p in probs]
    sketch = F.percentile_approx("_v", [*lower, *upper], ACCURACY)
    k, inf = len(probs), float("inf")
    pairs = [
        F.struct(
            (F.lit(-inf) if lower[i] == 0 else F.get("_s", F.lit(i))).alias("lo"),
            (F.lit(inf) if upper[i] == 1 else F.get("_s", F.lit(k + i))).alias("hi"),
        )
        for i in range(k)
    ]
    return rows.groupBy(*keys).agg(sketch.alias("_s")).select(*keys, F.array(*pairs).alias("_b"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles and ``n`` non-null rows."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    brackets = _brackets(rows, keys, sorted(probs.values()))
    if keys:
        joined = join_stats(rows, brackets, keys, salt=["_v"])
    else:
        joined = rows.withColumn("_b", brackets.select("_b").scalar())
    v = F.col("_v")
    inside = F.exists("_b", lambda b: (b["lo"] <= v) & (v <= b["hi"]))
    # rows between brackets are told apart by the brackets that end below them
    gap = F.when(~inside, F.size(F.filter("_b", lambda b: b["hi"] < v)))
    held = joined.groupBy(*keys, F.when(inside, v).alias("_in"), gap.alias("_gap")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    end = F.sum("_n").over(per_key.orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0))
    table = held.withColumns({"_last": end - 1, "_first": end - F.col("_n"), "_total": F.sum("_n").over(per_key)})
    picks, outs = [], []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            found = F.when(at == F.col("_first"), F.col("_lo")).when(at == F.col("_last"), F.col("_hi")).when(F.col("_in").isNotNull(), F.col("_lo"))
            found = found.otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("double"))
            picks.append(F.max(F.when((F.col("_first") <= at) & (at <= F.col("_last")), found)).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        frac = (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
        outs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * frac).alias(name))
    return table.groupBy(*keys).agg(*picks, F.max("_total").alias("n")).select(*keys, *outs, "n")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str) -> DataFrame:
    """(keys, value, rank): one-based rank of each distinct value, ties sharing the mean."""
    table = ordered_totals(df, keys, value)
    return table.select(*keys, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(rank))
