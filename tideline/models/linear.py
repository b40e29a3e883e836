"""Least squares from partial aggregates, and autoregression with exogenous columns.

Means and covariances come from one pass that merges matrices, so a training set of any size,
hot asset or not, becomes one row per model; a small k x k system per row is solved in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.gram import group_moments, range_moments
from tideline.functions.layout import DAILY, Series, over_series
from tideline.functions.skew import join_stats
from tideline.operators.folds import held_out
from tideline.session import materialise

# Two-sided standard normal quantiles by confidence level.
NORMAL_TWO_SIDED = {0.80: 1.2815515655446004, 0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def moments(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """One row per group: count, means and population covariances of the features and, last, the target."""
    columns = [*features, target]
    return _averaged(group_moments(rows, columns, keys, columns), columns, keys)


def fold_moments(rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """As ``moments``, of the train rows of every (keys, fold), without a copy of them per fold."""
    columns = [*features, target]
    return _averaged(range_moments(rows, folds, columns, keys, needed=columns), columns, [*keys, "fold"])


def _averaged(table: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    means = F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.get("mean", i * (len(columns) + 1)))
    n = F.get("counts", F.lit(0))
    return table.select(*keys, n.cast("bigint").alias("n"), means.alias("means"), F.transform("comoment", lambda x: x / n).alias("cov"))


def least_squares(use: Sequence[int], ridge: float = 0.0):
    """Struct (coefs, intercept, sse) of the chosen features from a moments row."""
    use = list(use)

    def solve(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
        out = []
        for rows, mean, flat in zip(n, means, cov):
            mean = np.asarray(mean, dtype=float)
            a = np.reshape(np.asarray(flat, dtype=float), (len(mean), len(mean)))
            v, y = a[use, -1], a[-1, -1]
            a = a[np.ix_(use, use)]
            a = a + np.diag(a.diagonal() * ridge)
            scale = np.sqrt(np.where(a.diagonal() > 0, a.diagonal(), 1.0))
            a = a / np.outer(scale, scale)
            if np.isfinite(a).all() and np.isfinite(v).all():
                coefs = np.linalg.pinv(a + 1e-10 * np.eye(len(use)), hermitian=True) @ (v / scale) / scale
            else:
                coefs = np.zeros(len(use))
            out.append((coefs.tolist(), float(mean[-1] - coefs @ mean[use]), float(max(0.0, y - coefs @ v) * rows)))
        return pd.DataFrame(out, columns=["coefs", "intercept", "sse"])

    return F.pandas_udf(solve, "coefs array<double>, intercept double, sse double")("n", "means", "cov")


def fit_linear(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """(keys, coefs, intercept, n, sse): least squares per group over complete rows.

    ``ridge`` is added to each feature variance as a share of it.
    """
    return _solved(moments(rows, features, target, keys), features, keys, ridge)


def _solved(table: DataFrame, features: Sequence[str], keys: Sequence[str], ridge: float) -> DataFrame:
    fitted = table.withColumn("_fit", least_squares(range(len(features)), ridge))
    return fitted.select(*keys, "_fit.coefs", "_fit.intercept", "n", "_fit.sse")


def predict_linear(rows: DataFrame, model: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows with ``y_pred`` of their group's model (one row per group, or one in all)."""
    if keys:
        joined = join_stats(rows, model.select(*keys, "coefs", "intercept"), keys)
    else:
        only = model.select(F.struct("coefs", "intercept").alias("_m")).scalar()
        joined = rows.withColumn("_m", only).withColumns({"coefs": F.col("_m.coefs"), "intercept": F.col("_m.intercept")}).drop("_m")
    value = sum((F.col("coefs")[i] * F.col(f) for i, f in enumerate(features)), F.col("intercept"))
    return joined.withColumn("y_pred", value).drop("coefs", "intercept")


def linear_frames(frames: DataFrame, features: Sequence[str], target: str = "y", keys: Sequence[str] = ("asset",), name: str = "linear", ridge: float = 0.0) -> DataFrame:
    """Walk-forward least squares on prepared frames (fold, role): one model per (asset, fold), fitted on its train rows."""
    frames = frames.na.drop(subset=[*features, target])
    model = fit_linear(frames.filter(F.col("role") == "train"), features, target, [*keys, "fold"], ridge)
    test = predict_linear(frames.filter(F.col("role") == "test"), model, features, [*keys, "fold"])
    return test.select(*keys, F.lit(name).alias("model"), "fold", "ts", F.col(target).alias("y_true"), "y_pred")


def linear_folds(rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str = "y", keys: Sequence[str] = ("asset",), name: str = "linear", ridge: float = 0.0) -> DataFrame:
    """As ``linear_frames``, from rows and folds: train rows are read once for all folds."""
    keys, rows = list(keys), rows.na.drop(subset=[*features, target])
    model = _solved(fold_moments(rows, folds, features, target, keys), features, [*keys, "fold"], ridge)
    test = predict_linear(held_out(rows, folds, keys), model, features, [*keys, "fold"])
    return test.select(*keys, F.lit(name).alias("model"), "fold", "ts", F.col(target).alias("y_true"), "y_pred")


def linear_contribution_frames(frames: DataFrame, features: Sequence[str], target: str = "y") -> DataFrame:
    """(asset, model, fold, ts, feature, value, contribution) of test rows: coefficient times the distance from the train mean."""
    frames = frames.na.drop(subset=[*features, target])
    train = frames.filter(F.col("role") == "train")
    model = fit_linear(train, features, target, ["asset", "fold"]).select("asset", "fold", "coefs")
    means = train.groupBy("asset", "fold").agg(F.array(*[F.avg(f) for f in features]).alias("_means"))
    test = join_stats(frames.filter(F.col("role") == "test"), model.join(means, ["asset", "fold"]), ["asset", "fold"])
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), (F.col("coefs")[i] * (F.col(f) - F.col("_means")[i])).alias("contribution")) for i, f in enumerate(features)]
    return test.select("asset", F.lit("linear").alias("model"), "fold", "ts", F.explode(F.array(*cells)).alias("_c")).select("asset", "model", "fold", "ts", "_c.*")


# ---- autoregression -------------------------------------------------------------------


def with_lags(rows: DataFrame, x: str, most: int, series: Series = DAILY) -> DataFrame:
    names = {f"lag_{k}": k for k in range(1, most + 1)}
    return over_series(rows, lambda d, w: d.withColumns({n: F.lag(x, k).over(w) for n, k in names.items()}), series, most).drop("_rn", "_n")


def _recursion(features: list[str], d: int, z: float):
    """Forecast the test rows of one fold step by step from the values before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        first = pdf.iloc[0]
        p = int(first["p"])
        coefs, base, sigma = np.asarray(first["coefs"], dtype=float), float(first["intercept"]), float(first["sigma"])
        state = [float(first[f"lag_{k}"]) for k in range(1, p + 1)]
        exog = pdf[features].to_numpy(dtype=float) @ coefs[p:] if features else np.zeros(len(pdf))
        phi, psi = coefs[:p], [1.0]
        level = float(first["level"]) if d else 0.0
        preds, spread, total = [], [], 0.0
        for h in range(len(pdf)):
            value = base + float(np.dot(phi, state)) + exog[h]
            state = [value, *state[:-1]]
            level = level + value if d else value
            # impulse responses give the variance of the forecast h steps ahead
            reach = float(np.sum(psi)) if d else psi[-1]
            total += reach * reach
            psi.append(float(sum(phi[i] * psi[-1 - i] for i in range(min(p, len(psi))))))
            preds.append(level)
            spread.append(sigma * np.sqrt(total))
        preds, spread = np.asarray(preds), np.asarray(spread)
        out = pdf[["asset", "fold", "ts", "p"]].copy()
        out["y_true"], out["y_pred"], out["std"] = pdf["y"], preds, spread
        out["lower"], out["upper"] = preds - z * spread, preds + z * spread
        return out

    return run


def arx_folds(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str] = (),
    orders: Sequence[int] = (1, 2, 3),
    d: int | str = 0,
    confidence: float = 0.95,
    series: Series = DAILY,
) -> DataFrame:
    """AR(p) with exogenous columns on the d-differenced target ``y``, p chosen by AIC.

    Coefficients come from moments of blocks of rows, read once for all folds; the recursion runs over
    the test rows of one fold, whose number the splitter bounds. ``lower``/``upper`` are the
    forecast interval. ``d="auto"`` differences a fold where its train rows show a unit root.
    """
    features, keys = list(features), list(series.keys)
    if d == "auto":
        from tideline.operators.unitroot import by_differencing, fold_differencing

        rows = rows.select(*keys, "ts", "rn", "y", *features).na.drop()
        chosen = materialise(fold_differencing(rows, folds, "y", series), "differencing")
        plain, once = (arx_folds(rows, by_differencing(folds, chosen, keys, k), features, orders, k, confidence, series) for k in (0, 1))
        return plain.unionByName(once)
    x = "_dy" if d else "y"
    rows = rows.select(*keys, "ts", "rn", "y", *features).na.drop()
    if d:
        step = lambda t, w: t.withColumns({"_dy": F.col("y") - F.lag("y", 1).over(w), "level": F.lag("y", 1).over(w)})
        rows = over_series(rows, step, series, 1).drop("_rn", "_n").na.drop(subset=["_dy"])
    most = max(orders)
    # read for the blocks, the edges and the test rows
    laid = materialise(with_lags(rows, x, most, series).na.drop(subset=[f"lag_{most}"]), "lagged")
    # every order is solved from the same moments row
    columns = [f"lag_{k}" for k in range(1, most + 1)] + features
    table = fold_moments(laid, folds, columns, x, keys)
    uses = {p: [*range(p), *range(most, len(columns))] for p in orders}
    table = table.withColumns({f"_c{p}": least_squares(use) for p, use in uses.items()})
    tries = []
    for p, use in uses.items():
        fit = F.col(f"_c{p}")
        mse = F.greatest(fit["sse"] / F.col("n"), F.lit(1e-300))
        aic = F.col("n") * F.log(mse) + 2.0 * (len(use) + 1)
        tries.append(F.struct(aic.alias("aic"), F.lit(p).alias("p"), fit["coefs"].alias("coefs"), fit["intercept"].alias("intercept"), F.sqrt(mse).alias("sigma")))
    best = table.select(*keys, "fold", F.array_min(F.array(*tries)).alias("_m")).select(*keys, "fold", "_m.*").drop("aic")
    # a row per fold; written, as the optimiser takes long over such expressions below a join
    best = materialise(best, "arx_models")
    test = join_stats(held_out(laid, folds, keys), best, [*keys, "fold"])
    schema = "asset string, fold bigint, ts timestamp_ntz, p int, y_true double, y_pred double, std double, lower double, upper double"
    out = test.groupBy(*keys, "fold").applyInPandas(_recursion(features, d, NORMAL_TWO_SIDED[confidence]), schema)
    return out.withColumn("model", F.lit("arx"))


def breusch_pagan(rows: DataFrame, residual: str, exog: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """LM statistic n R² of squared residuals regressed on the exogenous columns."""
    sq = rows.withColumn("_sq", F.col(residual) * F.col(residual))
    fit = fit_linear(sq, exog, "_sq", keys)
    total = sq.na.drop(subset=[*exog, "_sq"]).groupBy(*keys).agg((F.var_pop("_sq") * F.count("_sq")).alias("_sst"))
    r2 = 1 - F.try_divide(F.col("sse"), F.col("_sst"))
    return fit.join(total, list(keys)).select(*keys, "n", r2.alias("r2"), (F.col("n") * r2).alias("lm"))
