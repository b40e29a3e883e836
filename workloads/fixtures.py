"""Bars, predictions and contributions derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.bars import bars_from_rows

# The five series of the priority bars.
ASSETS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
INDEX_ASSET = "5-LOW"
PROXY_ASSET = "3-MEDIUM"
US_ASSETS = ("1-URGENT", "2-HIGH")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def priority_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_rows(
        table(spark, sf, "orders"), "o_orderpriority", F.col("o_orderdate"), "o_totalprice", F.count(F.lit(1)), ["o_orderkey"]
    )


def brand_bars(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("_px", F.col("l_extendedprice") / F.col("l_quantity"))
    rows = lines.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return bars_from_rows(rows, "p_brand", F.col("l_shipdate"), "_px", F.sum("l_quantity"), order)


def hour_of(ts: str):
    sec = F.date_part(F.lit("SECOND"), F.col(ts))
    return F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), sec)


def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return bars_from_rows(events, "event_type", hour_of("ts"), "value", F.count(F.lit(1)), ["ts", "event_id"])


# ---- SQL ------------------------------------------------------------------------------

W = "PARTITION BY asset ORDER BY ts"

PRIORITY_SQL = """bars AS (
  SELECT o_orderpriority AS asset, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         count(*) AS volume
  FROM orders GROUP BY 1, 2)"""

BRAND_SQL = """bars AS (
  SELECT p_brand AS asset, l_shipdate AS ts,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""

HOURLY_SQL = """bars AS (
  SELECT event_type AS asset, date_trunc('hour', ts) AS ts, arg_min(value, (e.ts, event_id)) AS open,
         max(value) AS high, min(value) AS low, arg_max(value, (e.ts, event_id)) AS close, count(*) AS volume
  FROM events e GROUP BY 1, 2)"""

RETURNS_SQL = f"""r AS (
  SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY asset) AS n,
         CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) END AS ret
  FROM bars)"""


def frame(k: int, w: str = W) -> str:
    return f"({w} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, k: int, least: int | None = None, w: str = W) -> str:
    least = k if least is None else least
    return f"CASE WHEN count({x}) OVER {frame(k, w)} >= {least} THEN {agg}({x}) OVER {frame(k, w)} END"


def roll_corr(x: str, y: str, k: int, w: str = W) -> str:
    return f"corr({x}, {y}) OVER {frame(k, w)}"


def rnd(x: str, name: str, digits: int = 6) -> str:
    return f'CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN round(CAST({x} AS DOUBLE), {digits}) + 0.0 END AS "{name}"'


def with_sql(*ctes: str, select: str, bars: str = PRIORITY_SQL) -> str:
    return "WITH " + ",\n".join((bars, RETURNS_SQL, *ctes)) + "\n" + select


# ---- predictions ----------------------------------------------------------------------

TRAIN, VAL, STEP = 200, 60, 60


def _forecast_stages(c):
    from tideline.functions.safe import ANNUAL, rolling

    return [
        {"last": rolling(F.stddev_samp, "ret", c.w, 5) * ANNUAL},
        {"y": F.lead("last", 5).over(c.w), "mean60": rolling(F.avg, "last", c.w, 60)},
    ]


def forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(asset, ts, rn, n, y, last, mean60): forward volatility and two simple forecasts."""
    from tideline.operators.features import Module, features

    module = Module("forecasts", _forecast_stages, lambda cfg: 70, ("close",), lambda cfg: 5)
    df = features(priority_bars(spark, sf), [module], extra=["_rn", "_n"])
    return df.withColumnsRenamed({"_rn": "rn", "_n": "n"})


def sliding_folds(spark: SparkSession, sf: str, step: int = STEP) -> DataFrame:
    from tideline.operators.folds import lengths, sliding_splits

    return sliding_splits(lengths(priority_bars(spark, sf)), TRAIN, VAL, step)


def predictions_reg(spark: SparkSession, sf: str, step: int = STEP) -> DataFrame:
    from tideline.operators.align import range_join

    rows = forecast_rows(spark, sf).filter(F.col("y").isNotNull()).select("asset", "ts", "rn", "y", "last", "mean60")
    folds = sliding_folds(spark, sf, step).select("asset", "fold", "test_lo", "test_hi")
    test = range_join(rows, folds, ["asset"], "rn", "test_lo", "test_hi", 64)
    long = test.unpivot(["asset", "fold", "ts", "y"], ["last", "mean60"], "model", "y_pred")
    return long.select("asset", "model", "fold", "ts", F.col("y").alias("y_true"), "y_pred")


def predictions_clf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    prob = F.col("n_chars") / (F.col("n_chars") + 1000)
    rows = table(spark, sf, "labels").join(docs, "doc_id").withColumn("y_prob", prob)
    return rows.select(
        "doc_id",
        (F.col("doc_id") % 5).alias("fold"),
        F.col("quality").alias("y_true"),
        "y_prob",
        (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"),
    )


def prediction_ctes(step: int = STEP, tag: str = "") -> tuple[str, ...]:
    return (
        f"pv{tag} AS (SELECT *, ({roll('stddev_samp', 'ret', 5)}) * sqrt(252.0) AS last FROM r)",
        f"py{tag} AS (SELECT *, lead(last, 5) OVER ({W}) AS y, {roll('avg', 'last', 60)} AS mean60 FROM pv{tag})",
        f"folds{tag} AS (SELECT asset, k AS fold, {step} * k AS train_lo, {step} * k + {TRAIN} AS train_hi, {step} * k + {TRAIN} AS test_lo, "
        f"{step} * k + {TRAIN + VAL} AS test_hi FROM (SELECT DISTINCT asset, n, unnest(range(0, CASE WHEN n >= {TRAIN + VAL} THEN (n - {TRAIN + VAL}) // {step} + 1 ELSE 0 END)) AS k FROM r))",
        f"test{tag} AS (SELECT p.asset, fold, ts, rn, y, last, mean60 FROM py{tag} p JOIN folds{tag} f ON f.asset = p.asset AND rn >= test_lo AND rn < test_hi WHERE y IS NOT NULL)",
        f"preds{tag} AS (SELECT asset, 'last' AS model, fold, ts, y AS y_true, last AS y_pred FROM test{tag} "
        f"UNION ALL SELECT asset, 'mean60', fold, ts, y, mean60 FROM test{tag})",
    )


PREDS = prediction_ctes()
CLF_SQL = """clf AS (SELECT doc_id, doc_id % 5 AS fold, quality AS y_true, n_chars / (n_chars + 1000.0) AS y_prob,
  CASE WHEN n_chars / (n_chars + 1000.0) >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM labels JOIN documents USING (doc_id))"""
FOLD_METRICS_SQL = """fm AS (SELECT asset, model, fold, avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
  avg(abs(y_true - y_pred)) AS mae, avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8)) AS mape,
  2 * avg(abs(y_true - y_pred) / (abs(y_true) + abs(y_pred) + 1e-8)) AS smape,
  1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) AS r2,
  stddev_pop(y_pred) / (stddev_pop(y_true) + 1e-8) AS vol_ratio, count(*) AS test_size
  FROM preds GROUP BY 1, 2, 3)"""
