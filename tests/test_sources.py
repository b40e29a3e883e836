"""Cached files, time normalising and the result store."""

import pytest
from conftest import collect

from tideline.sources import bars as B
from tideline.sources.store import ResultStore


def test_csv_per_symbol(spark, tmp_path, small_bars):
    for asset, g in small_bars.groupby("asset"):
        out = g.rename(columns={"ts": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume"})
        out.drop(columns="asset").to_csv(tmp_path / f"{asset}_2001-01-01_2002-01-01.csv", index=False)
    got = collect(B.preprocess(B.read_csv_bars(spark, str(tmp_path))))
    want = small_bars.sort_values(["asset", "ts"]).reset_index(drop=True)
    assert got.asset.tolist() == want.asset.tolist() and got.ts.tolist() == want.ts.tolist()
    assert abs(got.close - want.close).max() < 1e-9
    assert [r[0] for r in B.list_symbols(spark, str(tmp_path)).collect()] == ["A", "B", "C", "D"]
    info = B.cache_info(spark, str(tmp_path), "csv").first()
    assert info["files"] == 4 and info["total_mb"] > 0


def test_times(spark):
    rows = [("2020-01-01 10:00:00+10:00",), ("2020-01-01",), ("2020-01-01T05:00:00Z",), ("nonsense",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(B.to_utc("t")).collect()]
    assert [str(t) for t in got] == ["2020-01-01 00:00:00", "2020-01-01 00:00:00", "2020-01-01 05:00:00", "None", "None"]


def test_write_and_drop(spark, tmp_path, small_df):
    path = str(tmp_path / "bars")
    B.write_bars(small_df, path)
    assert B.read_bars(spark, path, ["A", "missing"]).count() == 40
    assert B.drop_bars(spark, path, ["A"]) == 1
    assert {r[0] for r in B.read_bars(spark, path).select("asset").distinct().collect()} == {"B", "C", "D"}
    with pytest.raises(ValueError):
        B.preprocess(small_df.drop("volume"))


def test_missing_days(spark, small_df):
    import pandas as pd

    got = {r["asset"]: r["missing_days"] for r in B.missing_day_count(small_df).collect()}
    for asset, g in collect(small_df).groupby("asset"):
        assert got[asset] == max(0, len(pd.bdate_range(g.ts.min(), g.ts.max())) - len(g))


def test_store_runs_and_partitions(spark, tmp_path, small_df):
    s = ResultStore(spark, str(tmp_path / "store"))
    s.start_run("r1", {"a": 1}, {"x": 1})
    s.update_run("r1", {"y": 2})
    row = s.run("r1")
    assert row["revision"] == 1 and row["metadata"] == '{"x": 1, "y": 2}' and row["config"] == '{"a": 1}'
    assert s.run("nothing") is None
    s.save("bars", small_df, "r1", by=("asset",))
    s.save("bars", small_df.filter("asset = 'A'").limit(5), "r1", by=("asset",))
    counts = {r["asset"]: r["count"] for r in s.load("bars", "r1").groupBy("asset").count().collect()}
    assert counts == {"A": 5}  # a run is replaced whole


def test_names_that_look_like_numbers_or_hold_reserved_characters(spark, tmp_path, small_df):
    from pyspark.sql import functions as F

    names = F.create_map(*[F.lit(x) for pair in zip("ABCD", ("0005", "^VIX", "BRK+B", "7203")) for x in pair])
    bars = small_df.withColumn("asset", F.try_element_at(names, "asset"))
    path = str(tmp_path / "bars")
    B.write_bars(bars, path)
    assert {r[0] for r in B.read_bars(spark, path).select("asset").distinct().collect()} == {"0005", "^VIX", "BRK+B", "7203"}
    assert B.drop_bars(spark, path, ["^VIX", "0005"]) == 2
    assert {r[0] for r in B.read_bars(spark, path).select("asset").distinct().collect()} == {"BRK+B", "7203"}
    s = ResultStore(spark, str(tmp_path / "store"))
    for run in ("007", "7", "a=b"):
        s.start_run(run, {"step": 1})
        s.save("metrics", bars.limit(3), run, by=("asset",))
    assert s.runs().filter("run_id = '007'").count() == 1 and s.load("metrics", "007").count() == 3 and s.load("metrics", "a=b").count() == 3
    assert s.run("7")["run_id"] == "7"
