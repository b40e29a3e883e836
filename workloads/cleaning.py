"""Cleaning, validation and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.layout import with_position
from tideline.functions.safe import rounded
from tideline.operators import cleaning as C
from tideline.operators import labels as L
from tideline.operators.features import features
from workloads.fixtures import (
    HOURLY_SQL,
    PRIORITY_SQL,
    US_ASSETS,
    W,
    hourly_bars,
    priority_bars,
    rnd,
    with_sql,
)
from workloads.registry import query
from workloads.windows import TARGET, VOL5, shown

INF = float("inf")
DIRTY_SQL = """dirty AS (SELECT asset, ts,
  CASE WHEN volume = 2 THEN CAST('inf' AS DOUBLE) WHEN volume = 3 THEN NULL ELSE close / 1000 END AS x,
  CASE WHEN volume = 4 THEN CAST('-inf' AS DOUBLE) WHEN volume = 1 AND dayofyear(ts) % 7 = 0 THEN NULL ELSE high - low END AS z,
  CASE WHEN volume = 2 THEN NULL ELSE 'v' || least(volume, 3) END AS tag,
  CASE WHEN volume = 3 THEN NULL WHEN volume = 5 THEN CAST('inf' AS DOUBLE) ELSE close / open - 1 END AS y FROM bars)"""


def dirty(spark, sf):
    """Bars turned into columns with missing, infinite and text values."""
    v = F.col("volume")
    return priority_bars(spark, sf).select(
        "asset",
        "ts",
        F.when(v == 2, F.lit(INF)).when(v == 3, F.lit(None)).otherwise(F.col("close") / 1000).alias("x"),
        F.when(v == 4, F.lit(-INF)).when((v == 1) & (F.dayofyear("ts") % 7 == 0), F.lit(None)).otherwise(F.col("high") - F.col("low")).alias("z"),
        F.when(v == 2, F.lit(None)).otherwise(F.concat(F.lit("v"), F.least(v, F.lit(3)))).alias("tag"),
        F.when(v == 3, F.lit(None)).when(v == 5, F.lit(INF)).otherwise(F.col("close") / F.col("open") - 1).alias("y"),
    )


def dirty_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join((PRIORITY_SQL, DIRTY_SQL, *ctes)) + "\n" + select


@query("price_col", with_sql(
    select="SELECT asset, ts, CASE WHEN volume > 1 THEN low ELSE close END AS adjusted_price, close AS plain_price FROM r"))
def price_col(spark, sf):
    from tideline.operators.features import price_column

    bars = priority_bars(spark, sf)
    adjusted = bars.withColumn("adj_close", F.when(F.col("volume") > 1, F.col("low")).otherwise(F.col("close")))
    return adjusted.select("asset", "ts", price_column(adjusted).alias("adjusted_price"), price_column(bars).alias("plain_price"))


@query("utc_normalise", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate - INTERVAL 10 HOUR
  WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate + INTERVAL 5 HOUR END AS ts FROM orders""")
def utc_normalise(spark, sf):
    from tideline.sources.bars import to_utc
    from workloads.fixtures import table

    k = F.col("o_orderkey") % 4
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    zoned = F.concat(text, F.when(k == 0, "+10:00").when(k == 1, "").when(k == 2, "-05:00").otherwise(" bad"))
    return table(spark, sf, "orders").select("o_orderkey", zoned.alias("t")).select("o_orderkey", to_utc("t").alias("ts"))


@query("drop_missing", dirty_sql(select="SELECT asset, ts, tag FROM dirty WHERE x IS NOT NULL AND z IS NOT NULL AND tag IS NOT NULL AND y IS NOT NULL"))
def drop_missing(spark, sf):
    return dirty(spark, sf).na.drop().select("asset", "ts", "tag")


@query("validate_bars", with_sql(
    "q AS (SELECT asset, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM bars GROUP BY asset)",
    "s AS (SELECT asset, count(*) AS rows, count(*) FILTER (WHERE close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1)) AS outliers FROM bars JOIN q USING (asset) GROUP BY asset)",
    "i AS (SELECT *, concat_ws(' ', CASE WHEN rows < 100 THEN 'few:' || rows END, CASE WHEN outliers > rows * 0.05 THEN 'wild:' || outliers END) AS issues FROM s)",
    select="SELECT asset, rows, outliers, issues, issues = '' AS is_valid FROM i", bars=HOURLY_SQL))
def validate_bars(spark, sf):
    return C.validate_bars(hourly_bars(spark, sf))


@query("inf_to_median", dirty_sql(
    "m AS (SELECT asset, quantile_cont(x, 0.5) FILTER (WHERE isfinite(x)) AS mx, quantile_cont(z, 0.5) FILTER (WHERE isfinite(z)) AS mz FROM dirty GROUP BY asset)",
    select=f"SELECT asset, ts, {rnd('CASE WHEN isinf(x) THEN coalesce(mx, 0) ELSE x END', 'x')}, {rnd('CASE WHEN isinf(z) THEN coalesce(mz, 0) ELSE z END', 'z', 4)} FROM dirty JOIN m USING (asset)"))
def inf_to_median(spark, sf):
    return shown(C.infinite_to_median(dirty(spark, sf), ["x", "z"]), {"x": 6, "z": 4})


_FFILL = f"last_value({{0}} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"


@query("ffill_median_zero", dirty_sql(
    f"f AS (SELECT asset, ts, {_FFILL.format('CASE WHEN isfinite(x) THEN x END')} AS x, {_FFILL.format('CASE WHEN isfinite(z) THEN z END')} AS z FROM dirty)",
    "m AS (SELECT asset, quantile_cont(x, 0.5) AS mx, quantile_cont(z, 0.5) AS mz FROM f GROUP BY asset)",
    select=f"SELECT asset, ts, {rnd('coalesce(x, mx, 0)', 'x')}, {rnd('coalesce(z, mz, 0)', 'z', 4)} FROM f JOIN m USING (asset)"))
def ffill_median_zero(spark, sf):
    from tideline.functions.safe import finite

    df = dirty(spark, sf).withColumns({"x": finite("x"), "z": finite("z")})
    return shown(C.fill_missing(df, ["x", "z"]), {"x": 6, "z": 4})


@query("impute_train", dirty_sql(
    """m AS (SELECT asset, quantile_cont(x, 0.5) FILTER (WHERE isfinite(x)) AS mx, quantile_cont(z, 0.5) FILTER (WHERE isfinite(z)) AS mz,
       quantile_cont(y, 0.5) FILTER (WHERE isfinite(y)) AS my FROM dirty GROUP BY asset)""",
    "tc AS (SELECT asset, tag, count(*) AS k FROM dirty WHERE tag IS NOT NULL GROUP BY 1, 2)",
    "mode AS (SELECT asset, tag AS mtag FROM tc QUALIFY row_number() OVER (PARTITION BY asset ORDER BY k DESC, tag) = 1)",
    """a AS (SELECT asset, ts, CASE WHEN isfinite(x) THEN x ELSE mx END AS x, CASE WHEN isfinite(z) THEN z ELSE mz END AS z,
       coalesce(tag, mtag) AS tag, CASE WHEN isinf(y) THEN my ELSE y END AS y FROM dirty JOIN m USING (asset) JOIN mode USING (asset))""",
    f"""b AS (SELECT asset, ts, x, z, tag, coalesce({_FFILL.format('y')}, first_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM a)""",
    select=f"SELECT asset, ts, tag, {rnd('x', 'x')}, {rnd('z', 'z', 4)}, {rnd('y', 'y')} FROM b WHERE y IS NOT NULL"))
def impute_train(spark, sf):
    return shown(C.impute_for_training(dirty(spark, sf), ["x", "z"], "y", ["tag"]), {"x": 6, "z": 4, "y": 6}, ("asset", "ts", "tag"))


def _quality_sql(cols):
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM dirty" for c in cols)
    return dirty_sql(
        f"long AS ({long})",
        "m AS (SELECT feature, quantile_cont(value, 0.5) FILTER (WHERE isfinite(value)) AS med FROM long GROUP BY 1)",
        "f AS (SELECT feature, CASE WHEN isfinite(value) THEN value ELSE med END AS v, value FROM long JOIN m USING (feature))",
        "q AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM f GROUP BY 1)",
        select="""SELECT feature, count(*) FILTER (WHERE isinf(value)) AS infinite, count(*) FILTER (WHERE value IS NULL) AS missing,
  count(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS outliers FROM f JOIN q USING (feature) GROUP BY feature""",
    )


@query("data_quality", _quality_sql(("x", "z", "y")))
def data_quality(spark, sf):
    return C.quality_report(dirty(spark, sf), ["x", "z", "y"])


_LABELLED = "SELECT asset, ts, rn, n, y, CASE WHEN y <= q33 THEN 0 WHEN y <= q67 THEN 1 WHEN y IS NOT NULL THEN 2 END AS label FROM t JOIN q USING (asset)"
_Q = "q AS (SELECT asset, quantile_cont(vol5, 0.33) AS q33, quantile_cont(vol5, 0.67) AS q67 FROM v GROUP BY asset)"


def labelled(spark, sf, bars=priority_bars):
    df = features(bars(spark, sf), ["targets"])
    return L.quantile_labels(df, "target_vol5", "vol5")


@query("target_align", with_sql(VOL5, TARGET, _Q, f"l AS ({_LABELLED})",
    select=f"""SELECT asset, ts, label, {rnd('y', 'target_vol5')} FROM l WHERE y IS NOT NULL AND label IS NOT NULL
  AND asset IN (SELECT asset FROM l WHERE y IS NOT NULL AND label IS NOT NULL GROUP BY asset HAVING count(*) >= 600)""", bars=HOURLY_SQL))
def target_align(spark, sf):
    from tideline.functions.layout import HOURLY

    df = L.quantile_labels(features(hourly_bars(spark, sf), ["targets"], series=HOURLY), "target_vol5", "vol5")
    return shown(L.align_targets(df, ["target_vol5", "label"], least=600), {"target_vol5": 6}, ("asset", "ts", "label"))


@query("nan_share_filter", dirty_sql(
    "s AS (SELECT asset, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END + CASE WHEN tag IS NULL THEN 1 ELSE 0 END) / (count(*) * 2.0) AS share FROM dirty GROUP BY asset)",
    select=f"SELECT d.asset, ts, {rnd('z', 'z', 4)} FROM dirty d JOIN s USING (asset) WHERE share <= 0.22"))
def nan_share_filter(spark, sf):
    from tideline.functions.safe import finite

    df = C.drop_sparse(dirty(spark, sf), ["x", "tag"], most=0.22)
    return df.select("asset", "ts", rounded(finite("z"), 4).alias("z"))


@query("degenerate_target_filter", with_sql(VOL5, TARGET, _Q, f"l AS ({_LABELLED})",
    "l2 AS (SELECT asset, ts, CASE WHEN asset = '5-LOW' THEN 1.0 ELSE y END AS y, CASE WHEN asset = '2-HIGH' THEN 1 ELSE label END AS label FROM l)",
    "g AS (SELECT asset FROM l2 GROUP BY asset HAVING stddev_samp(y) > 0 AND count(DISTINCT label) >= 2)",
    select="SELECT asset, ts, label FROM l2 WHERE asset IN (SELECT asset FROM g)"))
def degenerate_target_filter(spark, sf):
    df = labelled(spark, sf)
    df = df.withColumn("y", F.when(F.col("asset") == "5-LOW", F.lit(1.0)).otherwise(F.col("target_vol5")))
    df = df.withColumn("label", F.when(F.col("asset") == "2-HIGH", F.lit(1)).otherwise(F.col("label")))
    return L.drop_degenerate(df, "y", "label").select("asset", "ts", "label")


@query("clip_target", with_sql(VOL5, TARGET, select=f"SELECT asset, ts, {rnd('CASE WHEN y IS NOT NULL THEN greatest(least(y * 10 - 200, 100), -100) END', 'y')} FROM t"))
def clip_target(spark, sf):
    df = features(priority_bars(spark, sf), ["targets"]).withColumn("wide", F.col("target_vol5") * 10 - 200)
    return df.select("asset", "ts", rounded(L.clip_target("wide")).alias("y"))


_EX = ("a", "b")


@query("extreme_scale_gate", with_sql(
    "x AS (SELECT asset, ts, rn, n, CASE WHEN asset < '3' THEN close ELSE close / 1e6 END AS a, CAST(volume AS DOUBLE) / 10 AS b FROM r)",
    """s AS (SELECT asset, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb,
       avg(a) FILTER (WHERE rn < floor(n * 0.7)) AS ta, avg(b) FILTER (WHERE rn < floor(n * 0.7)) AS tb,
       stddev_pop(a) FILTER (WHERE rn < floor(n * 0.7)) AS da, stddev_pop(b) FILTER (WHERE rn < floor(n * 0.7)) AS db FROM x GROUP BY asset)""",
    "e AS (SELECT *, abs((ma + mb) / 2) > 10 OR (sa + sb) / 2 > 10 AS scaled FROM s)",
    select=f"SELECT asset, ts, scaled, {rnd('CASE WHEN scaled THEN (a - ta) / da ELSE a END', 'a')}, {rnd('CASE WHEN scaled THEN (b - tb) / db ELSE b END', 'b')} FROM x JOIN e USING (asset)"))
def extreme_scale_gate(spark, sf):
    df = with_position(priority_bars(spark, sf))
    small = F.when(F.col("asset") < "3", F.col("close")).otherwise(F.col("close") / 1e6)
    df = df.select("asset", "ts", "rn", "n", small.alias("a"), (F.col("volume").cast("double") / 10).alias("b"))
    return shown(C.scale_extreme(df, _EX), {"a": 6, "b": 6}, ("asset", "ts", "scaled"))


@query("zscore_full", with_sql(
    f"c AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS pc FROM r)",
    "s AS (SELECT asset, avg(pc) AS mu, stddev_samp(pc) AS sd FROM c GROUP BY asset)",
    select=f"SELECT asset, ts, {rnd('(pc - mu) / sd', 'z')} FROM c JOIN s USING (asset)"))
def zscore_full(spark, sf):
    df = features(priority_bars(spark, sf), ["cached"]).select("asset", "ts", "returns")
    return shown(C.group_zscore(df, "returns", "z"), {"z": 6})


@query("market_tag", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'US' ELSE 'AU' END AS market FROM orders")
def market_tag(spark, sf):
    from tideline.operators.reports import market_of
    from workloads.fixtures import table

    return table(spark, sf, "orders").select("o_orderkey", market_of("o_orderpriority", US_ASSETS).alias("market"))


def _summary_sql(cols):
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM s" for c in cols)
    return long


@query("feature_summary", with_sql(
    f"s AS (SELECT close / 1e5 AS price, ret, lag(ret, 31) OVER ({W}) AS lag1 FROM r)",
    f"long AS ({_summary_sql(('price', 'ret', 'lag1'))})",
    select=f"SELECT feature, count(*) FILTER (WHERE value IS NULL) AS missing, {rnd('avg(value)', 'mean')}, {rnd('stddev_samp(value)', 'std')}, {rnd('min(value)', 'min')}, {rnd('max(value)', 'max')} FROM long GROUP BY feature"))
def feature_summary(spark, sf):
    df = features(priority_bars(spark, sf), ["lagged", "cached"], extra=["close"])
    df = df.select((F.col("close") / 1e5).alias("price"), F.col("log_returns").alias("ret"), "lag1")
    out = C.summary(df, ["price", "ret", "lag1"])
    return shown(out, {c: 6 for c in ("mean", "std", "min", "max")}, ("feature", "missing"))


@query("target_stats", with_sql(VOL5, TARGET, _Q, f"l AS ({_LABELLED})",
    select=f"""SELECT asset, {rnd('avg(y)', 'mean')}, {rnd('stddev_samp(y)', 'std')}, count(*) FILTER (WHERE label = 0) AS class_0,
  count(*) FILTER (WHERE label = 1) AS class_1, count(*) FILTER (WHERE label = 2) AS class_2 FROM l GROUP BY asset"""))
def target_stats(spark, sf):
    df = labelled(spark, sf)
    counts = [F.count_if(F.col("label") == i).alias(f"class_{i}") for i in range(3)]
    out = df.groupBy("asset").agg(F.avg("target_vol5").alias("mean"), F.stddev_samp("target_vol5").alias("std"), *counts)
    return shown(out, {"mean": 6, "std": 6}, ("asset", "class_0", "class_1", "class_2"))
