"""Hidden Markov regimes: Gaussian states of a return with a transition matrix, fitted by expectation maximisation.

Forward and backward vectors of a series are products of one k x k matrix per row. A chunk's product is one small matrix
(``functions/scan.py``, in logs), so a round is: matrices of all chunks in parallel; a group per series, which strings
its chunks' matrices together from both ends; and sums of posteriors per chunk from the exact vectors at its edges. The
best path is found likewise with maxima, and traced back by composing each chunk's map from its last state to its first.
Results do not depend on the size of a chunk, and no task holds a series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.layout import DAILY, Series, with_position
from tideline.functions.scan import SIZE, back, backward, forward, largest, log_sum, onward, position_chunks, traced, transfer
from tideline.functions.skew import join_stats
from tideline.session import materialise


@dataclass(frozen=True)
class HmmSettings:
    states: int = 3
    rounds: int = 25
    #: A series' rounds end where its log likelihood gains less.
    tolerance: float = 0.01
    #: Chance of staying in a state, to begin with.
    stay: float = 0.9
    #: Least variance of a state, as a share of the series'.
    least_variance: float = 1e-4
    #: Rows that a series needs.
    least: int = 200
    size: int = SIZE


PARAMETERS = ("start", "trans", "mean", "var")
_KINDS = "start array<double>, trans array<double>, mean array<double>, var array<double>"


def initial(rets: DataFrame, keys: Sequence[str], settings: HmmSettings | None = None) -> DataFrame:
    """(keys, start, trans, mean, var): means even from one deviation below a series' mean to one above, states alike."""
    s = settings or HmmSettings()
    k = s.states
    stats = rets.groupBy(*keys).agg(F.count("ret").alias("_n"), F.avg("ret").alias("_mu"), F.var_pop("ret").alias("_v"))
    stats = stats.filter((F.col("_n") >= s.least) & (F.col("_v") > 0))
    shift = [2.0 * i / (k - 1) - 1.0 if k > 1 else 0.0 for i in range(k)]
    trans = [F.lit(1.0 if k == 1 else s.stay if i == j else (1.0 - s.stay) / (k - 1)) for i in range(k) for j in range(k)]
    return stats.select(
        *keys, F.array(*[F.lit(1.0 / k)] * k).alias("start"), F.array(*trans).alias("trans"),
        F.array(*[F.col("_mu") + F.sqrt("_v") * x for x in shift]).alias("mean"), F.array(*[F.col("_v")] * k).alias("var"), F.col("_v").alias("spread"),
    )


def return_chunks(rets: DataFrame, keys: Sequence[str] = ("asset",), size: int = SIZE) -> DataFrame:
    """(keys, chunk, rn, ret) of rows (keys, rn, ret) without missing returns, their positions without gaps."""
    return materialise(position_chunks(rets.select(*keys, "rn", F.col("ret").cast("double").alias("ret")), ["ret"], keys, size=size), "return_chunks")


def _log(x) -> np.ndarray:
    return np.log(np.maximum(np.asarray(x, float), 1e-300))


def matrices(ret: np.ndarray, first: int, start, trans, mean, var) -> np.ndarray:
    """(rows, k, k): log chance of a state after another, times the density of the row in it. Before a series' first row
    all states are alike, and the first row's matrix gives the start."""
    mean, var, k = np.asarray(mean, float), np.asarray(var, float), len(mean)
    density = -0.5 * (np.log(2 * np.pi * var) + (ret[:, None] - mean) ** 2 / var)
    out = _log(trans).reshape(1, k, k) + density[:, None, :]
    if first == 0 and len(ret):
        out[0] = np.broadcast_to(_log(start) + density[0], (k, k))
    return out


def _each(pdf: pd.DataFrame, keys: Sequence[str], columns: Sequence[str]) -> Iterator[tuple]:
    return zip(pdf[list(keys)].itertuples(index=False, name=None), *(pdf[c] for c in columns), strict=True)


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keys)


def _edges(modelled: DataFrame, keys: Sequence[str], best: bool) -> DataFrame:
    """(keys, chunk, into, out, loglik): vectors before a chunk's first row and after its last, scaled, and on the first
    chunk the log likelihood of the series (of its best path)."""
    keys, reduce = list(keys), largest if best else log_sum
    typed = _typed(modelled, keys)

    def chunk_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*own, chunk, transfer(matrices(ret, int(rn[0]), *p), reduce).ravel().tolist()) for own, chunk, rn, ret, *p in _each(pdf, keys, ("chunk", "rn", "ret", *PARAMETERS))]
            yield pd.DataFrame(out, columns=[*keys, "chunk", "_m"])

    def string(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        maps = np.array(pdf["_m"].tolist())
        k = int(round(maps.shape[1] ** 0.5))
        maps = maps.reshape(-1, k, k)
        v, into, total = np.full(k, 0.0 if best else -np.log(k)), [], 0.0
        for m in maps:
            into.append(v)
            v = onward(v, m, reduce)
            scale = float(reduce(v, -1))
            v, total = v - scale, total + scale
        b, out = np.zeros(k), []
        for m in maps[::-1]:
            out.append(b)
            b = back(m, b, reduce)
            b = b - float(reduce(b, -1))
        result = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame(result | {"chunk": pdf["chunk"], "into": [x.tolist() for x in into], "out": [x.tolist() for x in out[::-1]], "loglik": [total] + [None] * (len(maps) - 1)})

    products = modelled.select(*keys, "chunk", "rn", "ret", *PARAMETERS).mapInPandas(chunk_products, f"{typed}, chunk bigint, _m array<double>")
    return products.groupBy(*keys).applyInPandas(string, f"{typed}, chunk bigint, into array<double>, out array<double>, loglik double")


def _modelled(chunks: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_stats(chunks, model.select(*keys, *PARAMETERS), keys, salt=["chunk"])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def _row_posteriors(m: np.ndarray, into, out) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the states of each row, and of pairs of states before and at it (rows, k, k)."""
    a, b = forward(np.asarray(into, float), m, log_sum), backward(np.asarray(out, float), m, log_sum)
    pairs = a[:-1, :, None] + m + b[1:, None, :]
    return _softmax(a[1:] + b[1:]), _softmax(pairs.reshape(len(m), -1)).reshape(m.shape)


def improved(chunks: DataFrame, model: DataFrame, keys: Sequence[str] = ("asset",), settings: HmmSettings | None = None) -> DataFrame:
    """One round: (keys, start, trans, mean, var, spread, loglik), ``loglik`` that of the model given."""
    s, keys, k = settings or HmmSettings(), list(keys), (settings or HmmSettings()).states
    modelled = _modelled(chunks, model, keys)
    typed = _typed(modelled, keys)
    names = [f"{c}{i}" for c in ("g", "r", "rr", "first") for i in range(k)] + [f"x{i}" for i in range(k * k)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, rn, ret, into, after, loglik, *p in _each(pdf, keys, ("rn", "ret", "into", "out", "loglik", *PARAMETERS)):
                first = int(rn[0])
                at, pairs = _row_posteriors(matrices(ret, first, *p), into, after)
                off = ret[:, None] - np.asarray(p[2], float)  # about the last means, which loses no digits
                begin = at[0] if first == 0 else np.zeros(k)
                out.append((*own, loglik, *at.sum(0), *(at * off).sum(0), *(at * off * off).sum(0), *begin, *pairs[1 if first == 0 else 0 :].sum(0).ravel()))
            yield pd.DataFrame(out, columns=[*keys, "loglik", *names])

    joined = modelled.join(_edges(modelled, keys, False), [*keys, "chunk"])
    total = joined.mapInPandas(sums, f"{typed}, loglik double, {', '.join(f'{c} double' for c in names)}").groupBy(*keys).agg(F.sum("loglik").alias("loglik"), *(F.sum(c).alias(c) for c in names))
    now = total.join(model.select(*keys, *PARAMETERS, "spread"), keys)
    weight = [F.greatest(F.col(f"g{i}"), F.lit(1e-12)) for i in range(k)]
    off = [F.col(f"r{i}") / weight[i] for i in range(k)]
    var = [F.greatest(F.col(f"rr{i}") / weight[i] - off[i] * off[i], s.least_variance * F.col("spread")) for i in range(k)]
    left = [sum((F.col(f"x{i * k + j}") for j in range(k)), F.lit(0.0)) for i in range(k)]
    trans = [F.when(left[i] > 0, F.col(f"x{i * k + j}") / left[i]).otherwise(F.get("trans", F.lit(i * k + j))) for i in range(k) for j in range(k)]
    return now.select(
        *keys, F.array(*[F.col(f"first{i}") for i in range(k)]).alias("start"), F.array(*trans).alias("trans"),
        F.array(*[F.get("mean", F.lit(i)) + off[i] for i in range(k)]).alias("mean"), F.array(*var).alias("var"), "spread", "loglik",
    )


def fit(chunks: DataFrame, model: DataFrame, keys: Sequence[str] = ("asset",), settings: HmmSettings | None = None) -> DataFrame:
    """(keys, start, trans, mean, var, spread, loglik, rounds). A series stays as it is once its gain is below the
    tolerance; rounds end when all do. ``loglik`` is that of the model before its last round."""
    s, keys = settings or HmmSettings(), list(keys)
    held = model.select(*keys, *PARAMETERS, "spread", F.lit(float("-inf")).alias("loglik"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    held = materialise(held, "hmm_model")
    for _ in range(s.rounds):
        step = improved(chunks, held.filter(~F.col("done")), keys, s)
        old = held.select(*keys, F.col("loglik").alias("_old"), (F.col("rounds") + 1).alias("rounds"))
        step = step.join(old, keys).withColumn("done", F.col("loglik") - F.col("_old") < s.tolerance).drop("_old")
        held = materialise(held.filter("done").unionByName(step), "hmm_model")
        if held.filter(~F.col("done")).isEmpty():
            break
    return held.drop("done")


def best_path(chunks: DataFrame, model: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """(keys, rn, state) along each series' most likely path; of equal ones the lower state."""
    keys = list(keys)
    modelled = _modelled(chunks, model, keys)
    typed = _typed(modelled, keys)
    joined = modelled.join(_edges(modelled, keys, True).select(*keys, "chunk", "into"), [*keys, "chunk"])

    def maps_of(rn, ret, into, p) -> tuple[np.ndarray, np.ndarray]:
        m = matrices(ret, int(rn[0]), *p)
        d = forward(np.asarray(into, float), m, largest)
        return traced((d[:-1, :, None] + m).argmax(1)), d[-1]

    def chunk_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, chunk, rn, ret, into, *p in _each(pdf, keys, ("chunk", "rn", "ret", "into", *PARAMETERS)):
                states, last = maps_of(rn, ret, into, p)
                out.append((*own, chunk, states[0].tolist(), int(last.argmax())))
            yield pd.DataFrame(out, columns=[*keys, "chunk", "_map", "_top"])

    def string(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, ends = int(pdf["_top"].iloc[-1]), []
        for m in pdf["_map"].iloc[::-1]:
            ends.append(state)
            state = int(m[state])
        return pd.DataFrame({c: pdf[c].iloc[0] for c in keys} | {"chunk": pdf["chunk"], "_end": ends[::-1]})

    ends = joined.mapInPandas(chunk_maps, f"{typed}, chunk bigint, _map array<bigint>, _top bigint").groupBy(*keys).applyInPandas(string, f"{typed}, chunk bigint, _end bigint")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, rn, ret, into, end, *p in _each(pdf, keys, ("rn", "ret", "into", "_end", *PARAMETERS)):
                states, _ = maps_of(rn, ret, into, p)
                yield pd.DataFrame(dict(zip(keys, own, strict=True)) | {"rn": rn, "state": states[1:, end]})

    return joined.join(ends, [*keys, "chunk"]).mapInPandas(paths, f"{typed}, rn bigint, state bigint")


def posteriors(chunks: DataFrame, model: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """(keys, rn, posterior): chances of the states of each row."""
    keys = list(keys)
    modelled = _modelled(chunks, model, keys)
    joined = modelled.join(_edges(modelled, keys, False), [*keys, "chunk"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, rn, ret, into, out, *p in _each(pdf, keys, ("rn", "ret", "into", "out", *PARAMETERS)):
                at, _ = _row_posteriors(matrices(ret, int(rn[0]), *p), into, out)
                yield pd.DataFrame(dict(zip(keys, own, strict=True)) | {"rn": rn, "posterior": at.tolist()})

    return joined.mapInPandas(rows, f"{_typed(modelled, keys)}, rn bigint, posterior array<double>")


def _named(order: Column, states: Column) -> Column:
    return F.when(order == states, "Bull").when(order == 1, "Bear").otherwise("Sideways")


def hidden_regimes(rets: DataFrame, series: Series = DAILY, settings: HmmSettings | None = None) -> DataFrame:
    """(keys, ts, ret, state, regime, rounds, loglik) of every series with enough returns.

    Of the states that a series' path visits, the one with the lowest mean return is Bear, the highest Bull, others Sideways.
    """
    s, keys = settings or HmmSettings(), list(series.keys)
    present = rets.filter(F.col("ret").isNotNull() & ~F.isnan("ret")).select(*keys, series.time, "ret")
    rows = materialise(with_position(present, series).select(*keys, series.time, "rn", "ret"), "hmm_rows")
    model = initial(rows, keys, s)
    chunks = return_chunks(rows, keys, s.size)
    model = fit(chunks, model, keys, s)
    path = rows.join(best_path(chunks, model, keys), [*keys, "rn"])
    path = materialise(path, "hmm_path")
    means = path.groupBy(*keys, "state").agg(F.avg("ret").alias("_mean"))
    whole = Window.partitionBy(*keys)  # a row per state
    ranked = means.withColumn("_rank", F.row_number().over(whole.orderBy("_mean"))).withColumn("_states", F.count(F.lit(1)).over(whole))
    names = ranked.select(*keys, "state", _named(F.col("_rank"), F.col("_states")).alias("regime"))
    out = join_stats(path, names, [*keys, "state"], salt=["rn"])
    return join_stats(out, model.select(*keys, "rounds", "loglik"), keys, salt=["rn"]).select(*keys, series.time, "ret", "state", "regime", "rounds", "loglik")
