"""Feature-target statistics, feature selection and leakage reports.

Correlations are partial aggregates: one column triple per (feature, target), so the work
is one pass and the result one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.gram import group_moments
from tideline.functions.ranks import exact_quantiles
from tideline.functions.safe import corr, finite, is_inf
from tideline.functions.skew import join_stats
from tideline.operators.cleaning import unpivot


def target_correlations(
    df: DataFrame, cols: Sequence[str], targets: Sequence[str], keys: Sequence[str] = ("asset",)
) -> DataFrame:
    """Long (keys, feature, target, corr, abs_corr, n): Pearson correlation over common rows."""
    aggs, cells = [], []
    for i, c in enumerate(cols):
        for j, t in enumerate(targets):
            aggs += [
                corr(c, t).alias(f"_r{i}_{j}"),
                F.count_if(F.col(c).isNotNull() & F.col(t).isNotNull()).alias(f"_n{i}_{j}"),
            ]
            cells.append(F.struct(F.lit(c).alias("feature"), F.lit(t).alias("target"), F.col(f"_r{i}_{j}").alias("corr"), F.col(f"_n{i}_{j}").alias("n")))
    wide = (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)
    long = wide.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
    return long.withColumn("abs_corr", F.abs("corr"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long (keys, feature_1, feature_2, corr) over the pairs of the named columns."""
    k = len(cols)
    table = group_moments(df, cols, keys)
    cell = lambda name, i, j: F.get(name, i * k + j)
    # the squares of two columns over their common rows
    value = lambda i, j: F.when(cell("counts", i, j) > 1, F.try_divide(cell("comoment", i, j), F.sqrt(cell("square", i, j)) * F.sqrt(cell("square", j, i))))
    cells = [F.struct(F.lit(cols[i]).alias("feature_1"), F.lit(cols[j]).alias("feature_2"), value(i, j).alias("corr")) for i, j in combinations(range(k), 2)]
    return table.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def high_pairs(matrix: DataFrame, limit: float = 0.95) -> DataFrame:
    return matrix.filter(F.abs("corr") > limit)


def quality_flags(df: DataFrame, cols: Sequence[str], limit: float = 0.95) -> DataFrame:
    """One row: infinite cells, and column pairs correlated beyond the limit (warnings only).

    Infinite cells are left out of the correlations.
    """
    cells = sum((F.count_if(is_inf(c)) for c in cols[1:]), F.count_if(is_inf(cols[0])))
    infinite = df.agg(cells.alias("n")).scalar()
    finite_cols = df.select(*[finite(c).alias(c) for c in cols])
    pairs = high_pairs(correlation_matrix(finite_cols, cols), limit).agg(F.count(F.lit(1)).alias("high_pairs"))
    return pairs.withColumn("infinite", infinite).withColumn("is_clean", (F.col("infinite") == 0) & (F.col("high_pairs") == 0))


def select_by_correlation(table: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Features of a correlation table at or above the threshold."""
    return table.filter(F.col("abs_corr") >= threshold)


def variances(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",)) -> DataFrame:
    aggs = [F.var_samp(c).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*aggs).unpivot(list(keys), list(cols), "feature", "variance")


def select_by_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.01, keys: Sequence[str] = ("asset",)) -> DataFrame:
    return variances(df, cols, keys).filter(F.col("variance") >= threshold)


def kept_features(table: DataFrame, limit: float = 0.8, keep: bool = False, keys: Sequence[str] = ("asset",), least: int = 0, restore: int = 0) -> DataFrame:
    """Features with whether they are dropped, which are those beyond ``limit`` (none with ``keep``).

    ``least`` and ``restore``: where fewer than ``least`` features would remain, up to ``restore`` of the dropped ones
    come back, in order of their names. By default none do.
    """
    if keep:
        return table.withColumn("dropped", F.lit(False))
    high = table.withColumn("_high", F.coalesce(F.col("abs_corr") > limit, F.lit(False)))
    # one row per (series, feature): bounded by the configured columns
    w = Window.partitionBy(*keys)
    left = F.count_if(~F.col("_high")).over(w)
    order = F.row_number().over(w.orderBy(F.col("_high").desc(), "feature"))
    back = F.col("_high") & (left < least) & (order <= restore)
    return high.withColumn("dropped", F.col("_high") & ~back).drop("_high")


def f_scores(table: DataFrame) -> DataFrame:
    """F statistic of a single-feature regression from its correlation and row count."""
    r2 = F.col("corr") * F.col("corr")
    return table.withColumn("f_score", F.try_divide(r2 * (F.col("n") - 2), 1 - r2))


def top_k(table: DataFrame, score: str, k: int, keys: Sequence[str] = ("asset",), name: str = "feature") -> DataFrame:
    """The k best per group, ties by name; filtered per partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), name)
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mutual_information(
    df: DataFrame, cols: Sequence[str], target: str, bins: int = 10, keys: Sequence[str] = ("asset",)
) -> DataFrame:
    """(keys, feature, mi, n): mutual information in nats over quantile bins of both sides."""
    keys = list(keys)
    rows = df.filter(F.col(target).isNotNull())
    long = unpivot(rows.select(*keys, F.col(target).alias("_y"), *cols), [*keys, "_y"], cols).filter(F.col("value").isNotNull())
    probs = {f"_e{i}": i / bins for i in range(1, bins)}
    edges = lambda t: F.array(*[F.col(f"_e{i}") for i in range(1, bins)]).alias(t)
    x_edges = exact_quantiles(long, [*keys, "feature"], "value", probs).select(*keys, "feature", edges("_xe"))
    y_edges = exact_quantiles(rows, keys, target, probs).select(*keys, edges("_ye"))
    below = lambda e, v: F.size(F.filter(F.col(e), lambda q: q < F.col(v)))
    cells = (
        join_stats(join_stats(long, x_edges, [*keys, "feature"], salt=["value"]), y_edges, keys, salt=["value"])
        .groupBy(*keys, "feature", below("_xe", "value").alias("_bx"), below("_ye", "_y").alias("_by"))
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    # at most bins x bins cells per (series, feature)
    w = Window.partitionBy(*keys, "feature")
    n = F.sum("_k").over(w)
    nx = F.sum("_k").over(Window.partitionBy(*keys, "feature", "_bx"))
    ny = F.sum("_k").over(Window.partitionBy(*keys, "feature", "_by"))
    p = cells.withColumn("_n", n).withColumn("_t", F.col("_k") / n * F.log(F.col("_k") * n / (nx * ny)))
    return p.groupBy(*keys, "feature").agg(F.sum("_t").alias("mi"), F.max("_n").alias("n"))


def leakage_table(table: DataFrame, volatility: str, keys: Sequence[str] = ("asset",), limit: float = 0.7, listed: float = 0.5) -> DataFrame:
    """Per feature: correlation with each target, dropped (beyond limit with any), suspicious
    by name (or a volatility name beyond limit), listed for the global check."""
    beyond = F.coalesce(F.col("abs_corr") > limit, F.lit(False))
    with_vol = F.when(F.col("target") == volatility, F.col("abs_corr"))
    per = table.groupBy(*keys, "feature").agg(
        F.max("abs_corr").alias("max_corr"), F.max(with_vol).alias("vol_corr"), F.bool_or(beyond).alias("dropped")
    )
    name = F.lower("feature")
    by_name = name.rlike("target|regime|future")
    vol_name = name.contains("vol") & F.coalesce(F.col("vol_corr") > limit, F.lit(False))
    return per.withColumn("suspicious", by_name | vol_name).withColumn("listed", F.coalesce(F.col("vol_corr") > listed, F.lit(False)))


def leakage_status(report: DataFrame) -> DataFrame:
    """One row: counts and PASS, WARNING (anything found) or FAIL (more than five listed)."""
    out = report.agg(F.count_if("listed").alias("listed"), F.count_if("suspicious").alias("suspicious"), F.count_if("dropped").alias("dropped"))
    status = F.when(F.col("listed") > 5, "FAIL").when(F.col("listed") + F.col("suspicious") > 0, "WARNING").otherwise("PASS")
    return out.withColumn("status", status)


def leakage_recheck(report: DataFrame) -> DataFrame:
    """Status once the listed features are dropped; only a WARNING is mitigated."""
    status = leakage_status(report).select("status").scalar()
    return leakage_status(report.filter(~F.col("listed") | (status != F.lit("WARNING"))))
