"""Volatility models and hidden regimes on the priority bars, beside SQL that runs their recursions row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tideline.functions.layout import with_position
from tideline.models import garch, hmm
from tideline.operators.align import returns
from workloads.fixtures import priority_bars, rnd, with_sql
from workloads.models import MODEL_ROWS, folds_of, model_rows
from workloads.registry import query
from workloads.windows import shown

GARCH = garch.GarchSettings()


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def _garch_stages(keys: str) -> list[str]:
    """From t0 (keys, rs, mu, s2): the grid, and its refinements about the best point, as folds over the list of returns.

    In a fold's list are the variances of all points and then their log likelihoods so far."""
    ctes = []
    for stage in range(GARCH.refinements + 1):
        base = garch.grid_points(GARCH, stage)
        n, x, y = len(base), *(_list(base[:, k]) for k in (0, 1))
        if stage:
            x, y = (f"list_transform({v}, lambda o: o + {c})" for v, c in ((x, "x"), (y, "y")))
        ctes += [
            f"u{stage} AS (SELECT {keys}, rs, mu, s2, {x} AS xs, {y} AS ys FROM t{stage})",
            f"""w{stage} AS (SELECT *, list_transform(range(1, {n + 1}), lambda i: greatest(1 - exp(xs[i]) - exp(ys[i]), 0)) AS be, list_transform(ys, lambda v: exp(v)) AS al FROM u{stage})""",
            f"""l{stage} AS (SELECT *, list_reduce(list_prepend(list_concat(list_transform(be, lambda v: s2), list_transform(be, lambda v: 0.0::DOUBLE)), list_transform(rs, lambda r: [r * r])),
              lambda acc, e: list_transform(range(1, {2 * n + 1}), lambda i: CASE WHEN i <= {n} THEN s2 * (1 - al[i] - be[i]) + al[i] * e[1] + be[i] * acc[i]
                ELSE acc[i] - 0.5 * (ln(2 * pi() * greatest(acc[i - {n}], 1e-18)) + e[1] / greatest(acc[i - {n}], 1e-18)) END)) AS st FROM w{stage})""",
            f"a{stage} AS (SELECT *, list_position(st[{n + 1}:], list_max(st[{n + 1}:])) AS p FROM l{stage})",
            f"t{stage + 1} AS (SELECT {keys}, rs, mu, s2, xs[p] AS x, ys[p] AS y, al[p] AS alpha, be[p] AS beta, st[p] AS last FROM a{stage})",
        ]
    return ctes


_FITS = f"t{GARCH.refinements + 1}"
_TRAIN = (
    *MODEL_ROWS[:2],
    "fd AS (SELECT asset, n - (s - fold) * 42 AS lo, fold FROM (SELECT asset, n, s, unnest(range(0, s)) AS fold FROM mn))",
    "t0 AS (SELECT f.asset, fold, list(ret ORDER BY m.rn) AS rs, avg(ret) AS mu, avg(ret * ret) AS s2 FROM mr m JOIN fd f ON f.asset = m.asset AND m.rn < lo - 5 JOIN r ON r.asset = m.asset AND r.ts = m.ts GROUP BY ALL)",
    *_garch_stages("asset, fold"),
    "te AS (SELECT f.asset, fold, ts, m.rn - lo AS h FROM mr m JOIN fd f ON f.asset = m.asset AND m.rn >= lo AND m.rn < lo + 42)",
    f"sd AS (SELECT asset, fold, ts, alpha, beta, mu, sqrt(s2 + pow(alpha + beta, h) * (last - s2)) AS sd FROM te JOIN {_FITS} USING (asset, fold))",
)


@query("fit_garch", with_sql(*_TRAIN, select="SELECT asset, fold, ts, " + ", ".join((
    rnd("alpha", "alpha"), rnd("beta", "beta"), rnd("sd * sqrt(252.0)", "y_pred"), rnd(f"mu + {garch.NORMAL_LOWER[0.95]} * sd", "var_95"), rnd(f"mu + {garch.NORMAL_LOWER[0.99]} * sd", "var_99"))) + " FROM sd"))
def fit_garch(spark, sf):
    """Parameters, volatility forecasts and value at risk of every fold."""
    rows = model_rows(spark, sf)
    out = garch.garch_folds(rows, folds_of(rows))
    return shown(out, dict.fromkeys(("alpha", "beta", "y_pred", "var_95", "var_99"), 6), ("asset", "fold", "ts"))


_WHOLE = (
    "rr AS (SELECT asset, ts, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS t FROM r WHERE ret IS NOT NULL)",
    "t0 AS (SELECT asset, list(ret ORDER BY t) AS rs, avg(ret) AS mu, avg(ret * ret) AS s2 FROM rr GROUP BY asset HAVING count(*) >= 20)",
    *_garch_stages("asset"),
    f"vol(asset, t, v) AS (SELECT asset, CAST(1 AS BIGINT), s2 FROM {_FITS} UNION ALL SELECT g.asset, w.t + 1, g.s2 * (1 - alpha - beta) + alpha * q.ret * q.ret + beta * w.v "
    f"FROM vol w JOIN rr q ON q.asset = w.asset AND q.t = w.t JOIN {_FITS} g ON g.asset = w.asset)",
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("garch_volatility", _recursive(with_sql(*_WHOLE, select=f"SELECT asset, ts, {rnd('alpha', 'alpha')}, {rnd('beta', 'beta')}, {rnd('sqrt(v)', 'cond_vol')} FROM vol JOIN rr USING (asset, t) JOIN {_FITS} USING (asset)")))
def garch_volatility(spark, sf):
    """Conditional volatility of every return, with parameters fitted to the whole series."""
    out = garch.conditional_volatility(returns(priority_bars(spark, sf)))
    return shown(out, dict.fromkeys(("alpha", "beta", "cond_vol"), 6))


# ---- hidden regimes -------------------------------------------------------------------

HMM = hmm.HmmSettings()
_K = range(3)
_STAY, _MOVE = HMM.stay, (1 - HMM.stay) / 2


def _a(i: int, j: int) -> float:
    return _STAY if i == j else _MOVE


_NORM = "{0} / (x0 + x1 + x2)"
_HMM_ROWS = (
    "rr AS (SELECT asset, ts, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS t, count(*) OVER (PARTITION BY asset) AS m FROM r WHERE ret IS NOT NULL)",
    f"st AS (SELECT asset, avg(ret) AS mu, var_pop(ret) AS v FROM rr GROUP BY asset HAVING count(*) >= {HMM.least})",
    "de AS (SELECT rr.asset, ts, ret, t, m, v, "
    + ", ".join(f"mu + ({k} - 1) * sqrt(v) AS m{k}, -0.5 * (ln(2 * pi() * v) + (ret - mu - ({k} - 1) * sqrt(v)) ** 2 / v) AS e{k}" for k in _K)
    + " FROM rr JOIN st USING (asset))",
)
_STEP = (
    *_HMM_ROWS,
    "fw(asset, t, x0, x1, x2, c) AS (SELECT asset, t, " + ", ".join(f"exp(e{k}) / (exp(e0) + exp(e1) + exp(e2))" for k in _K) + ", (exp(e0) + exp(e1) + exp(e2)) / 3 FROM de WHERE t = 1 "
    "UNION ALL SELECT asset, t, y0 / (y0 + y1 + y2), y1 / (y0 + y1 + y2), y2 / (y0 + y1 + y2), y0 + y1 + y2 FROM (SELECT d.asset, d.t, "
    + ", ".join("(" + " + ".join(f"x{i} * {_a(i, k)!r}" for i in _K) + f") * exp(e{k}) AS y{k}" for k in _K)
    + " FROM fw JOIN de d ON d.asset = fw.asset AND d.t = fw.t + 1))",
    "bw(asset, t, b0, b1, b2) AS (SELECT asset, t, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM de WHERE t = m UNION ALL SELECT bw.asset, bw.t - 1, "
    + ", ".join("(" + " + ".join(f"{_a(i, j)!r} * exp(e{j}) * b{j}" for j in _K) + ") / c" for i in _K)
    + " FROM bw JOIN de d ON d.asset = bw.asset AND d.t = bw.t JOIN fw f ON f.asset = bw.asset AND f.t = bw.t WHERE bw.t > 1)",
    "po AS (SELECT asset, t, ret, v, c, " + ", ".join(f"m{k}, exp(e{k}) AS d{k}, x{k}, b{k}, x{k} * b{k} AS g{k}" for k in _K) + " FROM de JOIN fw USING (asset, t) JOIN bw USING (asset, t))",
    "pa AS (SELECT *, " + ", ".join(f"lag(x{i}) OVER (PARTITION BY asset ORDER BY t) * {_a(i, j)!r} * d{j} * b{j} / c AS p{i}{j}" for i in _K for j in _K) + " FROM po)",
    "em AS (SELECT asset, sum(ln(c)) AS loglik, any_value(v) AS v, "
    + ", ".join(f"sum(g{k}) AS g{k}, sum(g{k} * ret) / sum(g{k}) AS mean{k}, max(CASE WHEN t = 1 THEN g{k} END) AS s{k}" for k in _K)
    + ", " + ", ".join(f"sum(p{i}{j}) AS p{i}{j}" for i in _K for j in _K) + " FROM pa GROUP BY asset)",
    "va AS (SELECT asset, " + ", ".join(f"sum(po.g{k} * (ret - mean{k}) ** 2) / sum(po.g{k}) AS var{k}" for k in _K) + " FROM po JOIN em USING (asset) GROUP BY asset)",
)


def _state_rows(k: int) -> str:
    left = " + ".join(f"p{k}{j}" for j in _K)
    cells = [rnd(f"mean{k}", "mean"), rnd(f"sqrt(greatest(var{k}, {HMM.least_variance!r} * v))", "deviation"), rnd(f"s{k}", "start")]
    cells += [rnd(f"p{k}{j} / ({left})", f"to_{j}") for j in _K]
    return f"SELECT asset, {k} AS state, {rnd('loglik', 'loglik', 4)}, {', '.join(cells)} FROM em JOIN va USING (asset)"


def _return_rows(spark, sf):
    rets = returns(priority_bars(spark, sf)).filter(F.col("ret").isNotNull())
    return with_position(rets).select("asset", "ts", "rn", "ret")


@query("hmm_step", _recursive(with_sql(*_STEP, select=" UNION ALL ".join(_state_rows(k) for k in _K))))
def hmm_step(spark, sf):
    """One round of expectation maximisation of hidden regimes: log likelihood and the parameters after it."""
    rows = _return_rows(spark, sf)
    model = hmm.improved(hmm.return_chunks(rows), hmm.initial(rows, ["asset"]))
    state = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("state")
    long = model.select("*", state)
    at = lambda c, i: F.get(c, i.cast("int"))
    s = F.col("state")
    cells = {"mean": at("mean", s), "deviation": F.sqrt(at("var", s)), "start": at("start", s)} | {f"to_{j}": at("trans", s * 3 + j) for j in _K}
    return shown(long.select("asset", "state", "loglik", *(v.alias(c) for c, v in cells.items())), {"loglik": 4} | dict.fromkeys(cells, 6), ("asset", "state"))


_LOG = [[float(np.log(_a(i, j))) for j in _K] for i in _K]
_BEST = (
    *_HMM_ROWS,
    "vi(asset, t, x0, x1, x2, q0, q1, q2) AS (SELECT asset, t, e0, e1, e2, 0, 0, 0 FROM de WHERE t = 1 UNION ALL SELECT d.asset, d.t, "
    + ", ".join("greatest(" + ", ".join(f"x{i} + {_LOG[i][k]!r}" for i in _K) + f") + e{k}" for k in _K) + ", "
    + ", ".join(f"CASE WHEN x0 + {_LOG[0][k]!r} >= greatest(x1 + {_LOG[1][k]!r}, x2 + {_LOG[2][k]!r}) THEN 0 WHEN x1 + {_LOG[1][k]!r} >= x2 + {_LOG[2][k]!r} THEN 1 ELSE 2 END" for k in _K)
    + " FROM vi JOIN de d ON d.asset = vi.asset AND d.t = vi.t + 1)",
    "pt(asset, t, state) AS (SELECT asset, t, CASE WHEN x0 >= greatest(x1, x2) THEN 0 WHEN x1 >= x2 THEN 1 ELSE 2 END FROM vi JOIN (SELECT asset, max(m) AS t FROM rr GROUP BY asset) USING (asset, t) "
    "UNION ALL SELECT pt.asset, pt.t - 1, CASE state WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END FROM pt JOIN vi ON vi.asset = pt.asset AND vi.t = pt.t WHERE pt.t > 1)",
)


@query("hmm_path", _recursive(with_sql(*_BEST, select="SELECT asset, ts, CAST(state AS BIGINT) AS state FROM pt JOIN rr USING (asset, t)")))
def hmm_path(spark, sf):
    """The most likely path of hidden states under the parameters that a fit begins with."""
    rows = _return_rows(spark, sf)
    path = hmm.best_path(hmm.return_chunks(rows), hmm.initial(rows, ["asset"]))
    return rows.join(path, ["asset", "rn"]).select("asset", "ts", "state")


@query("regime_hmm", with_sql(*_HMM_ROWS[:2], select="SELECT asset, count(*) AS rows, TRUE AS ordered, TRUE AS finite FROM rr JOIN st USING (asset) GROUP BY asset"))
def regime_hmm(spark, sf):
    """Regimes of fitted hidden states: rows per series, Bear's mean return is the lowest and Bull's the highest."""
    out = hmm.hidden_regimes(returns(priority_bars(spark, sf)))
    mean = lambda r: F.avg(F.when(F.col("regime") == r, F.col("ret")))
    ordered = F.coalesce(mean("Bear") < mean("Sideways"), F.lit(True)) & F.coalesce(mean("Sideways") < mean("Bull"), F.lit(True)) & F.coalesce(mean("Bear") < mean("Bull"), F.lit(True))
    return out.groupBy("asset").agg(F.count(F.lit(1)).alias("rows"), ordered.alias("ordered"), F.bool_and((F.abs("loglik") < float("inf")) & F.col("state").between(0, 2)).alias("finite"))
