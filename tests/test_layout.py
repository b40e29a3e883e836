"""Chunked windows and scans give what one window per series would give."""

import pandas as pd
import pytest
from conftest import collect, same
from pyspark.sql import functions as F

from tideline.functions.layout import Series, backward_fill, forward_fill, over_series, running_sum, spread, with_position
from tideline.operators.features import features

TINY = Series(bucket_days=8, chunk_rows=64)
ONE = Series(chunk_rows=10**9)


def test_positions_and_chunk_sizes(spark, long_df, long_bars):
    got = collect(with_position(long_df, TINY))
    assert len(got) == len(long_bars)
    assert (got.rn == got.groupby("asset").cumcount()).all()
    assert (got.n == got.groupby("asset").ts.transform("size")).all()
    biggest = spread(long_df, TINY, 30, 5).groupBy("asset", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 64 + 8 + 8 + 35


def test_chunks_equal_whole_series(long_df):
    modules = ["technical", "statistical", "lagged", "nonlinear", "performance", "targets", "regimes"]
    a, b = (collect(features(long_df, modules, series=s)) for s in (TINY, ONE))
    for c in a.columns:
        if c.startswith("regime") and a[c].dtype == object:
            assert a[c].fillna("").tolist() == b[c].fillna("").tolist(), c
        elif c not in ("asset", "ts"):
            same(a[c].astype(float), b[c].astype(float), 1e-7)


def test_dense_series_get_shorter_buckets(spark):
    from pyspark.sql import functions as F

    from tideline.functions.layout import fitted

    ticks = spark.range(5000).select(
        F.lit("a").alias("asset"),
        F.expr("timestamp_ntz'2001-01-01' + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6)))").alias("ts"),
    ).persist()
    fit = fitted(ticks, Series(chunk_rows=256))
    assert fit.bucket_seconds and fit.bucket_seconds <= 256
    chunks = spread(ticks, fit, 10).groupBy("_chunk").count()
    assert chunks.agg(F.max("count")).first()[0] <= 256 + 2 * fit.bucket_seconds + 10
    got = with_position(ticks, fit).orderBy("ts").toPandas()
    assert got.rn.tolist() == list(range(5000))


def test_lookahead_rows_reach_into_next_chunk(long_df, long_bars):
    got = collect(over_series(long_df, lambda d, w: d.withColumn("x", F.lead("close", 7).over(w)), TINY, 0, 7))
    same(got.x, long_bars.groupby("asset").close.shift(-7))


def test_fill_and_running_sum(spark, long_df, long_bars):
    gap = F.when(F.pmod(F.xxhash64("asset", "ts"), F.lit(10)) == 0, F.col("close"))
    df = long_df.withColumn("x", gap).persist()
    base = collect(df)
    groups = base.groupby("asset").x
    same(collect(forward_fill(df, ["x"], TINY)).x, groups.ffill())
    same(collect(backward_fill(df, ["x"], TINY)).x, groups.bfill())
    same(collect(running_sum(df, {"x": "total"}, TINY)).total, groups.cumsum(), 1e-7)


def test_features_do_not_look_ahead(spark, long_df, long_bars):
    cut = long_bars.ts[long_bars.asset == "HOT"].iloc[700]
    names = None
    whole = collect(features(long_df.filter("asset = 'HOT'"), names))
    part = collect(features(long_df.filter((F.col("asset") == "HOT") & (F.col("ts") <= F.lit(cut))), names))
    whole = whole[whole.ts <= cut].reset_index(drop=True)
    for c in part.columns[2:]:
        same(part[c].astype(float), whole[c].astype(float), 1e-9)


def test_asof_matches_pandas(spark, long_df, long_bars):
    from tideline.operators.align import asof_join

    labels = long_bars[long_bars.ts.dt.day < 4][["asset", "ts"]].assign(label=lambda d: d.ts.dt.strftime("%Y%m%d"))
    labels["ts"] = labels.ts + pd.Timedelta(hours=0)
    right = spark.createDataFrame(labels, "asset string, ts timestamp_ntz, label string")
    got = collect(asof_join(long_df.select("asset", "ts"), right, ["label"], TINY))
    want = pd.merge_asof(long_bars[["asset", "ts"]].sort_values("ts"), labels.sort_values("ts"), on="ts", by="asset")
    want = want.sort_values(["asset", "ts"]).reset_index(drop=True)
    assert got.label.fillna("").tolist() == want.label.fillna("").tolist()
