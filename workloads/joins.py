"""Alignment, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.safe import rounded
from tideline.operators import align as A
from tideline.operators.features import features
from tideline.sources import bars as B
from workloads.fixtures import (
    ASSETS,
    BRAND_SQL,
    INDEX_ASSET,
    PRIORITY_SQL,
    PROXY_ASSET,
    US_ASSETS,
    W,
    hourly_bars,
    priority_bars,
    rnd,
    roll,
    table,
    with_sql,
)
from workloads.registry import query
from workloads.windows import REGIME, SLOPE, SLOPE2, TARGET, VOL5, shown

MARKETS = tuple(a for a in ASSETS if a != INDEX_ASSET)
PAIRS = A.asset_pairs(ASSETS, (INDEX_ASSET,))
NAMES = {a: A.plain_name(a) for a in ASSETS}


@query("align_outer", with_sql(select="SELECT ts, " + ", ".join(
    rnd(f"max(CASE WHEN asset = '{a}' THEN ret END)", NAMES[a]) for a in MARKETS) + " FROM r GROUP BY ts"))
def align_outer(spark, sf):
    wide = A.align_outer(A.returns(priority_bars(spark, sf)), MARKETS)
    return wide.select("ts", *[rounded(NAMES[a]).alias(NAMES[a]) for a in MARKETS])


@query("pair_generate", with_sql(
    "p AS (SELECT a.asset AS asset_1, b.asset AS asset_2 FROM (SELECT DISTINCT asset FROM r) a JOIN (SELECT DISTINCT asset FROM r) b ON a.asset < b.asset WHERE a.asset <> '5-LOW' AND b.asset <> '5-LOW')",
    "d AS (SELECT count(DISTINCT ts) AS days FROM r WHERE asset <> '5-LOW')",
    "c AS (SELECT x.asset AS asset_1, y.asset AS asset_2, count(*) AS common_days FROM r x JOIN r y ON x.ts = y.ts AND x.asset < y.asset WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2)",
    select="SELECT asset_1, asset_2, days, common_days FROM p JOIN c USING (asset_1, asset_2) JOIN d ON TRUE"))
def pair_generate(spark, sf):
    rets = A.returns(priority_bars(spark, sf)).filter(F.col("asset") != INDEX_ASSET)
    return A.pair_overlap(rets, PAIRS)


PAIR_SQL = (
    "cal AS (SELECT DISTINCT ts FROM r WHERE asset <> '5-LOW')",
    "p AS (SELECT a.asset AS a1, b.asset AS a2 FROM (SELECT DISTINCT asset FROM r) a JOIN (SELECT DISTINCT asset FROM r) b ON a.asset < b.asset WHERE a.asset <> '5-LOW' AND b.asset <> '5-LOW')",
    """j AS (SELECT a1, a2, cal.ts, CASE WHEN y.ret IS NOT NULL THEN x.ret END AS x, CASE WHEN x.ret IS NOT NULL THEN y.ret END AS y
       FROM cal JOIN p ON TRUE LEFT JOIN r x ON x.asset = a1 AND x.ts = cal.ts LEFT JOIN r y ON y.asset = a2 AND y.ts = cal.ts)""",
    "pc AS (SELECT a1, a2, ts, corr(x, y) OVER (PARTITION BY a1, a2 ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS c, "
    "count(x) OVER (PARTITION BY a1, a2 ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS k FROM j)",
)


def correlations(spark, sf):
    return A.pair_correlations(A.returns(priority_bars(spark, sf)).filter(F.col("asset") != INDEX_ASSET), PAIRS)


def pair_columns(spark, sf):
    return A.pair_columns(correlations(spark, sf), PAIRS)


def _corr_cell(a, b):
    return f"max(CASE WHEN a1 = '{a}' AND a2 = '{b}' AND k > 1 AND isfinite(c) THEN c END)"


PAIR_NAMES = {A.corr_name(a, b): (a, b) for a, b in PAIRS}


@query("pair_corr_join", with_sql(*PAIR_SQL, select="SELECT ts, " + ", ".join(rnd(_corr_cell(*ab), n, 5) for n, ab in PAIR_NAMES.items()) + " FROM pc GROUP BY ts"))
def pair_corr_join(spark, sf):
    return shown(pair_columns(spark, sf), {n: 5 for n in PAIR_NAMES}, ("ts",))


@query("pair_corr", with_sql(*PAIR_SQL, select=f"SELECT a1 AS asset_1, a2 AS asset_2, ts, {rnd('CASE WHEN k > 1 THEN c END', 'corr', 5)} FROM pc"))
def pair_corr(spark, sf):
    return shown(correlations(spark, sf), {"corr": 5}, ("asset_1", "asset_2", "ts"))


@query("corr_to_features", with_sql(*PAIR_SQL,
    "wide AS (SELECT ts, " + ", ".join(f"{_corr_cell(*ab)} AS \"{n}\"" for n, ab in PAIR_NAMES.items()) + " FROM pc GROUP BY ts)",
    select=f"SELECT asset, r.ts, {rnd('lag(ret, 31) OVER (PARTITION BY asset ORDER BY r.ts)', 'lag1')}, " + ", ".join(rnd(f'"{n}"', n, 5) for n in PAIR_NAMES) + " FROM r LEFT JOIN wide ON wide.ts = r.ts"))
def corr_to_features(spark, sf):
    df = A.join_by_date(features(priority_bars(spark, sf), ["lagged"]), pair_columns(spark, sf))
    return shown(df, {"lag1": 6} | {n: 5 for n in PAIR_NAMES})


def _padded(x: str) -> str:
    f = f"last_value({x} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"
    return f


@query("vix_join", with_sql(
    "j AS (SELECT r.asset, r.ts, i.close AS lv FROM r LEFT JOIN bars i ON i.ts = r.ts AND i.asset = '5-LOW')",
    f"f AS (SELECT *, {_padded('lv')} AS fl FROM j)", f"c AS (SELECT *, fl / lag(fl) OVER ({W}) - 1 AS ch FROM f)",
    "s AS (SELECT asset, avg(ch) AS mu, stddev_samp(ch) AS sd FROM c GROUP BY asset)",
    select=f"SELECT asset, ts, lv AS index_level, {rnd('(ch - mu) / sd', 'index_change')} FROM c JOIN s USING (asset)"))
def vix_join(spark, sf):
    bars = priority_bars(spark, sf)
    df = A.join_index(bars.select("asset", "ts"), bars.filter(F.col("asset") == INDEX_ASSET))
    return shown(df, {"index_change": 6}, ("asset", "ts", "index_level"))


@query("proxy_vol_join", with_sql(
    f"pv AS (SELECT ts, ({roll('stddev_samp', 'ret', 20, 10)}) * sqrt(252.0) AS pv FROM r WHERE asset = '3-MEDIUM')",
    "j AS (SELECT r.asset, r.ts, pv FROM r LEFT JOIN pv ON pv.ts = r.ts WHERE asset NOT IN ('1-URGENT', '2-HIGH'))",
    f"f AS (SELECT *, {_padded('pv')} AS fl FROM j)",
    select=f"SELECT asset, ts, {rnd('pv', 'proxy_vol')}, {rnd(f'fl / lag(fl) OVER ({W}) - 1', 'proxy_vol_change')} FROM f"))
def proxy_vol_join(spark, sf):
    bars = priority_bars(spark, sf)
    df = A.join_proxy(bars.select("asset", "ts"), bars.filter(F.col("asset") == PROXY_ASSET), ~F.col("asset").isin(*US_ASSETS))
    return shown(df, {"proxy_vol": 6, "proxy_vol_change": 6})


_MODULE_COLS = {"lag1": f"lag(ret, 31) OVER ({W})", "ret_abs": f"abs(lag(ret, 30) OVER ({W}))", "momentum_5": f"close / lag(close, 5) OVER ({W}) - 1"}


@query("module_concat", with_sql(select=f"SELECT asset, ts, CAST(month(ts) AS INTEGER) AS month_of_year, " + ", ".join(rnd(e, c) for c, e in _MODULE_COLS.items()) + " FROM r"))
def module_concat(spark, sf):
    df = features(priority_bars(spark, sf), ["lagged", "nonlinear", "performance", "calendar"])
    return shown(df, {c: 6 for c in _MODULE_COLS}, ("asset", "ts", "month_of_year"))


@query("asof_ffill", with_sql(SLOPE, SLOPE2, REGIME,
    "lab AS (SELECT asset, ts, regime FROM regime WHERE regime IS NOT NULL)",
    "sh AS (SELECT DISTINCT o_orderpriority AS asset, l_shipdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey)",
    select="SELECT sh.asset, sh.ts, lab.regime FROM sh ASOF LEFT JOIN lab ON lab.asset = sh.asset AND sh.ts >= lab.ts"))
def asof_ffill(spark, sf):
    """The regime known on each shipping day of a priority's orders, from the labels of its order days."""
    labels = features(priority_bars(spark, sf), ["regimes"]).select("asset", "ts", "regime").filter(F.col("regime").isNotNull())
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("asset"))
    shipped = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("ts")).join(orders, "o_orderkey")
    return A.asof_join(shipped.select("asset", "ts").distinct(), labels, ["regime"])


@query("align_inner", with_sql(VOL5, TARGET, f"f AS (SELECT *, lag(ret, 31) OVER ({W}) AS lag1 FROM r)",
    select=f"SELECT f.asset, f.ts, {rnd('lag1', 'lag1')}, {rnd('y', 'y')} FROM f JOIN t USING (asset, ts) WHERE y IS NOT NULL AND lag1 IS NOT NULL"))
def align_inner(spark, sf):
    bars = priority_bars(spark, sf)
    feats = features(bars, ["lagged"]).select("asset", "ts", "lag1").filter(F.col("lag1").isNotNull())
    target = features(bars, ["targets"]).select("asset", "ts", F.col("target_vol5").alias("y")).filter(F.col("y").isNotNull())
    return shown(feats.join(target, ["asset", "ts"]), {"lag1": 6, "y": 6})


@query("calendar_missing", with_sql(
    "sp AS (SELECT asset, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM bars GROUP BY asset)",
    "ex AS (SELECT asset, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sp)",
    select="SELECT asset, strftime(day, '%Y-%m-%d') AS day FROM ex WHERE isodow(day) <= 5 AND (asset, day) NOT IN (SELECT asset, CAST(ts AS DATE) FROM bars)"))
def calendar_missing(spark, sf):
    return B.business_day_gaps(priority_bars(spark, sf)).select("asset", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("data_info", with_sql(
    "sp AS (SELECT asset, min(ts) AS lo, max(ts) AS hi, count(*) AS k FROM bars GROUP BY asset)",
    "ex AS (SELECT asset, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM sp)",
    "bd AS (SELECT asset, count(*) AS expected FROM ex WHERE isodow(day) <= 5 GROUP BY asset)",
    select="SELECT asset, lo AS first_ts, hi AS last_ts, k AS rows, CAST(greatest(0, expected - k) AS BIGINT) AS missing_days FROM sp JOIN bd USING (asset)"))
def data_info(spark, sf):
    bars = priority_bars(spark, sf)
    return B.data_info(bars, B.missing_day_count(bars))


@query("pool_sources", "WITH " + PRIORITY_SQL + """, src AS (SELECT asset, ts, close, volume FROM bars WHERE asset IN ('1-URGENT', '2-HIGH')
  UNION ALL BY NAME SELECT event_type AS asset, ts, value AS close FROM events)
  SELECT asset, ts, close, volume FROM src""")
def pool_sources(spark, sf):
    from workloads.fixtures import table

    own = A.pool(priority_bars(spark, sf), US_ASSETS).select("asset", "ts", "close", "volume")
    other = table(spark, sf, "events").select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("close"))
    return own.unionByName(other, allowMissingColumns=True)


@query("universe_union", "SELECT o_orderpriority AS asset FROM orders UNION SELECT event_type FROM events")
def universe_union(spark, sf):
    from workloads.fixtures import table

    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("asset"))
    return A.symbol_union(a, table(spark, sf, "events").select(F.col("event_type").alias("asset")))


@query("load_universe", with_sql(select="SELECT asset, ts, open, high, low, close, volume FROM bars WHERE asset IN ('1-URGENT', '3-MEDIUM') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'"))
def load_universe(spark, sf):
    bars = B.universe(priority_bars(spark, sf), ["1-URGENT", "3-MEDIUM", "NOT THERE"], "1996-01-01", "1999-12-31")
    return bars.select("asset", "ts", "open", "high", "low", "close", "volume")


@query("bars_hourly", """SELECT event_type AS asset, date_trunc('hour', ts) AS ts, arg_min(value, (e.ts, event_id)) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, (e.ts, event_id)) AS close, count(*) AS volume FROM events e GROUP BY 1, 2""")
def bars_hourly(spark, sf):
    return hourly_bars(spark, sf)


@query("bars_brand", "WITH " + BRAND_SQL + """
  SELECT asset, ts, open, high, low, close, volume FROM bars""")
def bars_brand(spark, sf):
    from workloads.fixtures import brand_bars

    return brand_bars(spark, sf)
