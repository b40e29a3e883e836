"""Alignment and joins on dates, positions and assets."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.layout import DAILY, Series, forward_fill, over_series
from tideline.functions.safe import ANNUAL, ratio, rolling, rolling_corr, safe_log
from tideline.operators.cleaning import group_zscore


def plain_name(symbol: str) -> str:
    """Symbol without the characters ``^ . -`` (and blanks, for column names)."""
    return re.sub(r"[\^.\- ]", "", symbol)


def returns(bars: DataFrame, series: Series = DAILY) -> DataFrame:
    """(keys, time, price, ret)."""
    from tideline.operators.features import price_column

    def build(rows, w):
        rows = rows.withColumn("price", price_column(rows))
        return rows.withColumn("ret", safe_log(ratio("price", F.lag("price", 1).over(w))))

    return over_series(bars, build, series, 1).select(*series.keys, series.time, "price", "ret")


def align_outer(rets: DataFrame, assets: Sequence[str], value: str = "ret") -> DataFrame:
    """One row per date with one column per configured asset (full outer alignment)."""
    cells = [F.max(F.when(F.col("asset") == a, F.col(value))).alias(plain_name(a)) for a in assets]
    return rets.groupBy("ts").agg(*cells)


Pairs = Sequence[tuple[str, str]]


def asset_pairs(assets: Sequence[str], leave_out: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Unordered pairs of the named symbols without those left out; for universes small enough to want all of them."""
    return list(combinations([a for a in assets if a not in leave_out], 2))


def pairs_with(partner: str, assets: Sequence[str]) -> list[tuple[str, str]]:
    """Each asset against one partner, such as the index: as many pairs as assets."""
    return [(a, partner) for a in assets if a != partner]


def _pair_table(rets: DataFrame, pairs: Pairs) -> DataFrame:
    return rets.sparkSession.createDataFrame(list(pairs), "asset_1 string, asset_2 string")


def _sides(rets: DataFrame, pairs: Pairs, value: str) -> DataFrame:
    """(asset_1, asset_2, ts, x, y): one row per pair and date on which either has a bar.

    Each side is an equality join on the asset with the pairs it takes part in; the two sides meet in an aggregate on
    (pair, date), so rows are spread over dates and no series is gathered.
    """
    table = _pair_table(rets, pairs)
    sides = [
        rets.join(table, F.col("asset") == F.col(f"asset_{k}")).select("asset_1", "asset_2", "ts", *[(F.col(value) if k == i else F.lit(None).cast("double")).alias(n) for i, n in ((1, "x"), (2, "y"))])
        for k in (1, 2)
    ]
    return sides[0].unionByName(sides[1]).groupBy("asset_1", "asset_2", "ts").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def pair_overlap(rets: DataFrame, pairs: Pairs, value: str = "ret") -> DataFrame:
    """(asset_1, asset_2, days, common_days): dates of the whole table, and dates on which both have a value."""
    days = rets.select("ts").distinct().agg(F.count(F.lit(1)).alias("days")).scalar()
    both = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return _sides(rets, pairs, value).groupBy("asset_1", "asset_2").agg(both.alias("common_days")).select("asset_1", "asset_2", days.alias("days"), "common_days")


def pair_correlations(rets: DataFrame, pairs: Pairs, window: int = 30, value: str = "ret", series: Series = DAILY) -> DataFrame:
    """Long (asset_1, asset_2, ts, corr): rolling correlation of each pair over the last ``window`` dates of the table.

    Pairs are rows and partition the windows together with the chunks of the calendar.
    """
    listed = F.array(*[F.struct(F.lit(a).alias("asset_1"), F.lit(b).alias("asset_2")) for a, b in pairs])
    dates = rets.select("ts").distinct().select("ts", F.explode(listed).alias("_p")).select("_p.asset_1", "_p.asset_2", "ts")
    rows = dates.join(_sides(rets, pairs, value), ["asset_1", "asset_2", "ts"], "left")
    keyed = replace(series, keys=("asset_1", "asset_2"))
    out = over_series(rows, lambda d, w: d.withColumn("corr", rolling_corr("x", "y", w, window)), keyed, window - 1)
    return out.select("asset_1", "asset_2", "ts", "corr")


def corr_name(a: str, b: str) -> str:
    return f"{plain_name(a)}_{plain_name(b)}_corr"


def pair_columns(correlations: DataFrame, pairs: Pairs) -> DataFrame:
    """One row per date and a column per named pair, for features that a caller wants side by side."""
    cells = [F.max(F.when((F.col("asset_1") == a) & (F.col("asset_2") == b), F.col("corr"))).alias(corr_name(a, b)) for a, b in pairs]
    return correlations.groupBy("ts").agg(*cells)


def join_by_date(features: DataFrame, other: DataFrame) -> DataFrame:
    """Left join on date, without filling."""
    return features.join(other, "ts", "left")


def pct_change_padded(df: DataFrame, x: str, out: str, series: Series = DAILY) -> DataFrame:
    """Change on the previous row after carrying missing values forward."""
    filled = forward_fill(df.withColumn("_x", F.col(x)), ["_x"], series)

    def build(rows, w):
        return rows.withColumn(out, ratio("_x", F.lag("_x", 1).over(w)) - 1)

    return over_series(filled, build, series, 1).drop("_x", "_rn", "_n")


def join_index(df: DataFrame, index_bars: DataFrame, series: Series = DAILY) -> DataFrame:
    """External index level by date, and its padded change z-scored over the series."""
    from tideline.operators.features import price_column

    level = index_bars.select("ts", price_column(index_bars).alias("index_level"))
    changed = pct_change_padded(join_by_date(df, level), "index_level", "index_change", series)
    return group_zscore(changed, "index_change", "index_change", series.keys)


def join_proxy(df: DataFrame, proxy_bars: DataFrame, in_market: Column, series: Series = DAILY) -> DataFrame:
    """20-row volatility of a proxy and its padded change, for assets of its market only."""

    def build(rows, w):
        rows = rows.withColumn("_ret", safe_log(ratio("close", F.lag("close", 1).over(w))))
        return rows.withColumn("proxy_vol", rolling(F.stddev_samp, "_ret", w, 20, 10) * ANNUAL)

    proxy = over_series(proxy_bars, build, series, 22).select("ts", "proxy_vol")
    return pct_change_padded(join_by_date(df.filter(in_market), proxy), "proxy_vol", "proxy_vol_change", series)


def asof_join(left: DataFrame, right: DataFrame, cols: Sequence[str], series: Series = DAILY) -> DataFrame:
    """Latest non-null right values at or before each left row of the same series."""
    keys = [*series.keys, series.time]
    rest = [c for c in left.columns if c not in keys]
    both = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, *cols).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    filled = forward_fill(both, list(cols), series, tie=("_side",))
    return filled.filter(F.col("_side") == 1).select(*keys, *rest, *cols)


def range_join(
    rows: DataFrame, ranges: DataFrame, keys: Sequence[str], position: str, lo: str, hi: str, width: int = 256
) -> DataFrame:
    """Rows whose position lies in [lo, hi) of a range with the same keys.

    Ranges are cut into blocks of ``width`` positions, so the join has an equality on
    (keys, block): its cost follows the output, and a long series spreads over blocks.
    """
    blocks = F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))
    cut = ranges.filter(F.col(hi) > F.col(lo)).withColumn("_blk", F.explode(blocks))
    placed = rows.withColumn("_blk", F.floor(F.col(position) / width))
    inside = (F.col(position) >= F.col(lo)) & (F.col(position) < F.col(hi))
    return placed.join(cut, [*keys, "_blk"]).filter(inside).drop("_blk")


def pool(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Rows of the source assets, stacked."""
    return rows.filter(F.col("asset").isin(*sources))


def symbol_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("asset").union(b.select("asset")).distinct()
