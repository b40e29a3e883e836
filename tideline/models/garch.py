"""GARCH(1,1) by variance targeting and maximum likelihood, many series in parallel, with the exact recursion.

The variance follows v' = w + alpha r^2 + beta v, so a chunk of a series is an affine map of v (``functions/scan.py``):
the maps of all points of a grid come from one pass, a group per range of rows strings them together, and a second pass
adds up the log likelihood of each chunk from its exact first variance. There is no burn-in, whatever the persistence, and no copy
of train rows per fold: a chunk is read once for all folds that it touches. The grid is even in log(1 - persistence) and
log(alpha); around its best point it is refined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.layout import DAILY, Series, with_position
from tideline.functions.safe import ANNUAL, NORMAL_LOWER
from tideline.functions.scan import SIZE, affine_path, chunk_pieces, listed, position_chunks
from tideline.functions.skew import join_stats
from tideline.operators.align import range_join
from tideline.session import materialise


@dataclass(frozen=True)
class GarchSettings:
    #: Ends and number of the grid's steps: 1 - persistence and alpha.
    lack: tuple[float, float, int] = (0.4, 0.0005, 12)
    alpha: tuple[float, float, int] = (0.01, 0.3, 9)
    #: Times the grid is refined around its best point, ``reach`` steps to each side, each ``cut`` times as fine.
    refinements: int = 1
    reach: int = 3
    cut: int = 4
    #: Rows that a fit needs.
    least: int = 20


def _axis(low: float, high: float, n: int) -> tuple[np.ndarray, float]:
    ends = np.log([low, high])
    return np.linspace(*ends, n), float((ends[1] - ends[0]) / (n - 1))


def grid_points(settings: GarchSettings, stage: int, x: float = 0.0, y: float = 0.0) -> np.ndarray:
    """(points, 2): log(1 - persistence) and log(alpha) of a stage, about (x, y) after the first."""
    xs, dx = _axis(*settings.lack)
    ys, dy = _axis(*settings.alpha)
    if stage:
        offsets = np.arange(-settings.reach, settings.reach + 1) / settings.cut**stage
        xs, ys = x + offsets * dx, y + offsets * dy
    return np.array([(a, b) for a in xs for b in ys])


def parameters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and beta; beta is never negative."""
    alpha = np.exp(points[:, 1])
    return alpha, np.maximum(1.0 - np.exp(points[:, 0]) - alpha, 0.0)


def log_likelihood(r: np.ndarray, var: np.ndarray) -> np.ndarray:
    var = np.maximum(var, 1e-18)
    return -0.5 * np.sum(np.log(2 * math.pi * var) + (r * r)[:, None] / var, axis=0)


def _piece(pos: np.ndarray, ret: np.ndarray, piece) -> np.ndarray:
    return ret[slice(*np.searchsorted(pos, [piece["lo"], piece["hi"]]))]


def _rows(pdf: pd.DataFrame, keys: Sequence[str], *columns: str) -> Iterator[tuple]:
    return zip(pdf[list(keys)].itertuples(index=False, name=None), *(pdf[c] for c in columns), strict=True)


def _chunk_maps(settings: GarchSettings, stage: int, keys: Sequence[str]):
    """Per piece of a chunk: its sums, and the decayed sum of its squared returns at each point of the grid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, chunk, pos, ret, pieces in _rows(pdf, keys, "chunk", "rn", "ret", "pieces"):
                for p in pieces:
                    r = _piece(pos, ret, p)
                    alpha, beta = parameters(grid_points(settings, stage, p["x"], p["y"]))
                    none = np.zeros(len(beta))
                    shocks = affine_path(none, beta, none, none + 1.0, r * r)[-1]
                    out.append((*own, p["fold"], chunk, p["lo"], p["hi"], p["x"], p["y"], len(r), r.sum(), (r * r).sum(), shocks.tolist()))
            yield pd.DataFrame(out, columns=[*keys, "fold", "chunk", "lo", "hi", "x", "y", "rows", "_r", "_rr", "_shocks"])

    return run


def _strung(settings: GarchSettings, stage: int, keys: Sequence[str]):
    """Of one range, a row per chunk: the variances it starts from, and whether it is the last. Short ranges, and those
    without variance, start from none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        first, n = pdf.iloc[0], int(pdf["rows"].sum())
        mu, s2 = (float(pdf[c].sum()) / n if n else np.nan for c in ("_r", "_rr"))
        starts: list = [None] * len(pdf)
        if n >= settings.least and s2 > 0:
            alpha, beta = parameters(grid_points(settings, stage, first["x"], first["y"]))
            v = np.full(len(beta), s2)
            for i, (rows, shocks) in enumerate(zip(pdf["rows"], pdf["_shocks"], strict=True)):
                starts[i] = v.tolist()
                decay = beta**rows
                level = np.where(beta < 1, (1 - decay) / np.where(beta < 1, 1 - beta, 1), rows)  # 1 + beta + beta^2 ...
                v = s2 * (1 - alpha - beta) * level + alpha * np.asarray(shocks) + decay * v
        out = {c: first[c] for c in (*keys, "fold", "lo", "hi", "x", "y")} | {"rows": n, "mu": mu, "s2": s2}
        return pd.DataFrame(out | {"chunk": pdf["chunk"], "start": starts, "final": [False] * (len(pdf) - 1) + [True]})

    return run


def _chunk_likelihoods(settings: GarchSettings, stage: int, keys: Sequence[str]):
    """Per piece and point its log likelihood, and in the last chunk the variance after the last row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, pos, ret, pieces in _rows(pdf, keys, "rn", "ret", "pieces"):
                for p in pieces:
                    head = (*own, p["fold"], p["rows"], p["mu"], p["s2"])
                    if p["start"] is None:
                        out += [(*head, 0, None, None, None, None)] if p["final"] else []
                        continue
                    r = _piece(pos, ret, p)
                    points = grid_points(settings, stage, p["x"], p["y"])
                    alpha, beta = parameters(points)
                    path = affine_path(np.asarray(p["start"], float), beta, p["s2"] * (1 - alpha - beta), alpha, r * r)
                    last = path[-1] if p["final"] else [None] * len(alpha)
                    out += [(*head, i, x, y, ll, v) for i, ((x, y), ll, v) in enumerate(zip(points, log_likelihood(r, path[:-1]), last, strict=True))]
            yield pd.DataFrame(out, columns=[*keys, "fold", "rows", "mu", "s2", "point", "x", "y", "loglik", "last"])

    return run


def fit_ranges(chunks: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("asset",), size: int = SIZE, settings: GarchSettings | None = None) -> DataFrame:
    """(keys, fold, rows, mu, s2, alpha, beta, last, loglik) of every range (keys, fold, lo, hi) of positions with a return.

    ``chunks``: (keys, chunk, rn, ret) without missing returns. ``last`` is the variance after the last row. Ranges with
    too few rows, or without variance, have no parameters.
    """
    s, keys = settings or GarchSettings(), list(keys)
    by, kinds = [*keys, "fold"], dict(ranges.dtypes)
    typed = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    fit = f"{typed}, lo bigint, hi bigint, x double, y double, rows bigint"
    zero = F.lit(0.0)
    best = ranges.select(*by, F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), zero.alias("x"), zero.alias("y"))
    for stage in range(s.refinements + 1):
        pieces = chunk_pieces(best.select(*by, "lo", "hi", "x", "y"), "lo", "hi", size)
        mapped = chunks.join(listed(pieces, keys, ("fold", "lo", "hi", "x", "y")), [*keys, "chunk"])
        maps = mapped.mapInPandas(_chunk_maps(s, stage, keys), f"{typed}, chunk bigint, lo bigint, hi bigint, x double, y double, rows bigint, _r double, _rr double, _shocks array<double>")
        starts = maps.groupBy(*by).applyInPandas(_strung(s, stage, keys), f"{fit}, mu double, s2 double, chunk bigint, start array<double>, final boolean")
        scored = chunks.join(listed(starts, keys, ("fold", "lo", "hi", "x", "y", "rows", "mu", "s2", "start", "final")), [*keys, "chunk"])
        parts = scored.mapInPandas(_chunk_likelihoods(s, stage, keys), f"{typed}, rows bigint, mu double, s2 double, point bigint, x double, y double, loglik double, last double")
        same = [F.max(c).alias(c) for c in ("rows", "mu", "s2", "x", "y", "last")]
        total = parts.groupBy(*by, "point").agg(F.sum("loglik").alias("loglik"), *same)
        # of equal likelihoods the first point
        top = F.max_by(F.struct("x", "y", "loglik", "last", "rows", "mu", "s2"), F.struct("loglik", -F.col("point")))
        found = total.groupBy(*by).agg(top.alias("_m")).select(*by, "_m.*")
        if stage < s.refinements:
            best = ranges.join(found.filter(F.col("x").isNotNull()).select(*by, "x", "y"), by, "left").select(*by, "lo", "hi", *(F.coalesce(c, zero).alias(c) for c in ("x", "y")))
    alpha = F.exp("y")
    return found.select(*by, "rows", "mu", "s2", alpha.alias("alpha"), F.greatest(1.0 - F.exp("x") - alpha, F.lit(0.0)).alias("beta"), "last", "loglik")


def return_chunks(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    ret = F.col("ret").cast("double")
    present = rows.filter(ret.isNotNull() & ~F.isnan(ret)).select(*keys, "rn", ret.alias("ret"))
    return materialise(position_chunks(present, ["ret"], keys, size=size), "return_chunks")


def garch_folds(
    rows: DataFrame,
    folds: DataFrame,
    levels: Sequence[float] = (0.95, 0.99),
    keys: Sequence[str] = ("asset",),
    size: int = SIZE,
    settings: GarchSettings | None = None,
) -> DataFrame:
    """Annualised volatility forecast of every test row from the end of its train rows, with value at risk.

    Needs (keys, ts, rn, ret, y); ``size``: positions of a chunk. Without a fit the forecast is the deviation of the train rows.
    """
    by = [*keys, "fold"]
    chunks = return_chunks(rows, keys, size)
    ranges = folds.select(*by, F.col("train_lo").alias("lo"), F.col("train_hi").alias("hi"))
    found = materialise(fit_ranges(chunks, ranges, keys, size, settings), "garch_fits")
    present = F.col("y").cast("double").isNotNull() & ~F.isnan(F.col("y").cast("double"))
    test = range_join(rows.filter(present).select(*keys, "ts", "rn", "y"), folds.select(*by, "test_lo", "test_hi"), list(keys), "rn", "test_lo", "test_hi")
    step = F.row_number().over(Window.partitionBy(*by).orderBy("rn")) - 1  # a test block is bounded by its settings
    ahead = join_stats(test.withColumn("_h", step), found, by, "left")
    s2 = F.coalesce("s2", F.lit(0.0))
    decay = F.pow(F.col("alpha") + F.col("beta"), F.col("_h"))
    std = F.sqrt(F.when(F.col("last").isNull(), s2).otherwise(s2 + decay * (F.col("last") - s2)))
    risk = [(F.coalesce("mu", F.lit(0.0)) + NORMAL_LOWER[c] * F.col("_std")).alias(f"var_{round(c * 100)}") for c in levels]
    params = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("alpha", "beta")]
    shown = [*keys, F.col("fold").cast("bigint").alias("fold"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("y").cast("double").alias("y_true")]
    return ahead.withColumn("_std", std).select(*shown, *params, (F.col("_std") * ANNUAL).alias("y_pred"), *risk, F.lit("garch").alias("model"))


def conditional_volatility(rets: DataFrame, series: Series = DAILY, size: int = SIZE, settings: GarchSettings | None = None) -> DataFrame:
    """(asset, ts, ret, alpha, beta, cond_vol) with parameters fitted per asset, of assets with enough rows."""
    s = settings or GarchSettings()
    rows = materialise(with_position(rets.select("asset", "ts", "ret").filter(F.col("ret").isNotNull()), series).select("asset", "ts", "rn", "ret"), "garch_rows")
    chunks = return_chunks(rows, ["asset"], size)
    ranges = chunks.groupBy("asset").agg((F.max(F.array_max("rn")) + 1).alias("hi")).select("asset", F.lit(0).cast("bigint").alias("fold"), F.lit(0).cast("bigint").alias("lo"), "hi")
    fits = fit_ranges(chunks, ranges, ["asset"], size, s).filter(F.col("last").isNotNull()).select("asset", "s2", "alpha", "beta")
    fits = materialise(fits, "garch_fits")
    one = join_stats(chunks, fits, ["asset"], salt=["chunk"])

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [affine_path(np.zeros(1), np.array([b]), np.array([v * (1 - a - b)]), np.array([a]), r * r)[-1, 0] for r, v, a, b in zip(pdf["ret"], pdf["s2"], pdf["alpha"], pdf["beta"], strict=True)]
            yield pd.DataFrame({"asset": pdf["asset"], "chunk": pdf["chunk"], "s2": pdf["s2"], "_decay": [b ** len(r) for r, b in zip(pdf["ret"], pdf["beta"], strict=True)], "_end": ends})

    def string(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        v, starts = float(pdf["s2"].iloc[0]), []
        for decay, end in zip(pdf["_decay"], pdf["_end"], strict=True):
            starts.append(v)
            v = end + decay * v
        return pd.DataFrame({"asset": pdf["asset"], "chunk": pdf["chunk"], "start": starts})

    starts = one.mapInPandas(maps, "asset string, chunk bigint, s2 double, _decay double, _end double").groupBy("asset").applyInPandas(string, "asset string, chunk bigint, start double")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asset, rn, r, v, a, b, start in zip(*(pdf[c] for c in ("asset", "rn", "ret", "s2", "alpha", "beta", "start")), strict=True):
                var = affine_path(np.array([start]), np.array([b]), np.array([v * (1 - a - b)]), np.array([a]), r * r)[:-1, 0]
                yield pd.DataFrame({"asset": asset, "rn": rn, "alpha": a, "beta": b, "cond_vol": np.sqrt(var)})

    run = one.join(starts, ["asset", "chunk"]).mapInPandas(paths, "asset string, rn bigint, alpha double, beta double, cond_vol double")
    return rows.join(run, ["asset", "rn"]).select("asset", "ts", "ret", "alpha", "beta", "cond_vol")
