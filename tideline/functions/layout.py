"""Order-dependent work without one task per series.

A plain ``Window.partitionBy(asset)`` sends a whole series to one task, so an asset that
holds a third of the rows becomes the job. Here a series is cut by row position:

* time buckets (a fixed number of days, so their row count is bounded by the bar grid) are
  counted with map-side combine; a running sum over that small table gives exact positions;
* buckets are grouped into chunks of about ``chunk_rows`` rows, and the buckets that hold
  the last ``lookback`` rows before a chunk are copied into it;
* windows run per (keys, chunk); each row is kept from the one chunk that sees both its
  look-back and its look-ahead.

Frames bounded by ``lookback``/``lookahead`` are therefore exact. Unbounded scans (forward
fill, running sum) carry one value per bucket through the same kind of small table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """How rows form series: keys, time column, bucket length, rows per chunk.

    The bucket length (days, or seconds where given) should hold at most about
    ``chunk_rows`` rows of one series; ``fitted`` makes sure of it.
    """

    keys: tuple[str, ...] = ("asset",)
    time: str = "ts"
    bucket_days: int = 64
    chunk_rows: int = 16384
    bucket_seconds: int | None = None

    @property
    def chunked(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy(self.time)


DAILY = Series()
HOURLY = Series(bucket_days=8)


def bucket_of(series: Series) -> Column:
    t = F.col(series.time)
    day = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date"))
    if series.bucket_seconds is None:
        return F.floor(day / F.lit(series.bucket_days)).cast("bigint")
    second = day.cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.floor(second / F.lit(series.bucket_seconds)).cast("bigint")


def fitted(df: DataFrame, series: Series = DAILY) -> Series:
    """The series with buckets short enough that none holds more than ``chunk_rows`` rows.

    Each round reads one number, the largest bucket count (a partial aggregate). Bars on a
    grid need no round beyond the first; dense series get buckets down to one second.
    """
    while True:
        rows = df.groupBy(*series.keys, bucket_of(series).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        largest = rows.agg(F.max("_c")).first()[0] or 0
        seconds = series.bucket_seconds or series.bucket_days * 86400
        if largest <= series.chunk_rows or seconds == 1:
            return series
        shorter = max(1, min(seconds // 2, seconds * series.chunk_rows // (2 * largest)))
        series = replace(series, bucket_seconds=shorter)


def bucket_counts(df: DataFrame, series: Series) -> DataFrame:
    """(keys, _b, _off, _end, _n): rows before, rows up to the end, rows of the series."""
    whole = Window.partitionBy(*series.keys)
    running = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.groupBy(*series.keys, bucket_of(series).alias("_b"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.sum("_c").over(running))
        .withColumn("_n", F.sum("_c").over(whole))
        .select(*series.keys, "_b", (F.col("_end") - F.col("_c")).alias("_off"), "_end", "_n")
    )


def _placement(df: DataFrame, series: Series, lookback: int, lookahead: int) -> DataFrame:
    size, reach = series.chunk_rows, lookback + lookahead
    own = F.floor(F.col("_off") / size)
    first_halo = F.greatest(own + 1, F.floor(F.col("_end") / size))
    last_halo = F.floor((F.col("_end") + F.lit(reach - 1)) / size)
    halo = F.when(last_halo >= first_halo, F.sequence(first_halo, last_halo)).otherwise(F.array().cast("array<bigint>"))
    per_chunk = Window.partitionBy(*series.keys, "_chunk")
    mine = F.col("_chunk") == F.col("_home")
    lo = F.min(F.when(mine, F.col("_off"))).over(per_chunk)
    hi = F.max(F.when(mine, F.col("_end"))).over(per_chunk)
    return (
        bucket_counts(df, series)
        .withColumn("_home", own)
        .withColumn("_chunk", F.explode(F.concat(F.array(own), halo)))
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .filter(F.col("_lo").isNotNull())
        .withColumn("_lo", F.when(F.col("_lo") == 0, F.lit(0)).otherwise(F.col("_lo") - lookahead))
        .withColumn("_hi", F.when(F.col("_hi") == F.col("_n"), F.col("_n")).otherwise(F.col("_hi") - lookahead))
        .drop("_home", "_end")
    )


def spread(df: DataFrame, series: Series = DAILY, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Rows placed in their chunks, halo rows included, with ``_rn`` (position) and ``_n``."""
    placed = df.withColumn("_b", bucket_of(series)).join(
        _placement(df, series, lookback, lookahead), [*series.keys, "_b"]
    )
    # explicit keys: a partitioning on the series alone would satisfy the window and undo the
    # chunks; explicit number: windows cost far more per byte than the byte-based coalescing
    # of small partitions allows for
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(parts, *series.keys, "_chunk")
    w = series.chunked
    base = F.first("_off").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_rn", base + F.row_number().over(w) - 1).drop("_b", "_off")


def settle(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Drop halo rows, keeping every input row exactly once."""
    own = df.filter((F.col("_rn") >= F.col("_lo")) & (F.col("_rn") < F.col("_hi")))
    if keep is not None:
        return own.select(*keep)
    return own.drop("_chunk", "_lo", "_hi")


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    series: Series = DAILY,
    lookback: int = 0,
    lookahead: int = 0,
) -> DataFrame:
    """Apply ``build(rows, window)`` with frames of at most lookback/lookahead rows."""
    return settle(build(spread(df, series, lookback, lookahead), series.chunked))


def with_position(df: DataFrame, series: Series = DAILY) -> DataFrame:
    """Zero-based ``rn`` per series and its length ``n``."""
    out = settle(spread(df, series))
    return out.withColumnsRenamed({"_rn": "rn", "_n": "n"})


def _carried(df: DataFrame, series: Series, aggs: list[Column]) -> DataFrame:
    return df.groupBy(*series.keys, bucket_of(series).alias("_b")).agg(*aggs)


def _fill(df: DataFrame, cols: list[str], series: Series, forward: bool, tie: tuple[str, ...] = ()) -> DataFrame:
    pick = F.max_by if forward else F.min_by
    edge = F.last if forward else F.first
    aggs = [pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(series.time))).alias(f"_edge_{c}") for c in cols]
    per_key = Window.partitionBy(*series.keys).orderBy("_b")
    beyond = (
        per_key.rowsBetween(Window.unboundedPreceding, -1) if forward else per_key.rowsBetween(1, Window.unboundedFollowing)
    )
    carry = _carried(df, series, aggs).select(
        *series.keys, "_b", *[edge(F.col(f"_edge_{c}"), ignorenulls=True).over(beyond).alias(f"_edge_{c}") for c in cols]
    )
    near = Window.partitionBy(*series.keys, "_b").orderBy(series.time, *tie)
    near = (
        near.rowsBetween(Window.unboundedPreceding, 0) if forward else near.rowsBetween(0, Window.unboundedFollowing)
    )
    filled = {c: F.coalesce(edge(F.col(c), ignorenulls=True).over(near), F.col(f"_edge_{c}")) for c in cols}
    return (
        df.withColumn("_b", bucket_of(series))
        .join(carry, [*series.keys, "_b"])
        .withColumns(filled)
        .select(*df.columns)
    )


def forward_fill(df: DataFrame, cols: list[str], series: Series = DAILY, tie: tuple[str, ...] = ()) -> DataFrame:
    """Latest non-null value at or before each row, across the whole series.

    Rows of equal time are taken in the order of ``tie``.
    """
    return _fill(df, cols, series, True, tie)


def backward_fill(df: DataFrame, cols: list[str], series: Series = DAILY) -> DataFrame:
    """Earliest non-null value at or after each row, across the whole series."""
    return _fill(df, cols, series, False)


def running_sum(df: DataFrame, cols: dict[str, str], series: Series = DAILY) -> DataFrame:
    """Adds cols[name] = running sum of column name; NULL stays NULL, as rows are skipped."""
    aggs = [F.sum(F.col(c)).alias(f"_part_{c}") for c in cols]
    before = Window.partitionBy(*series.keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(df, series, aggs).select(
        *series.keys, "_b", *[F.sum(f"_part_{c}").over(before).alias(f"_part_{c}") for c in cols]
    )
    near = Window.partitionBy(*series.keys, "_b").orderBy(series.time).rowsBetween(Window.unboundedPreceding, 0)
    sums = {
        out: F.when(F.col(c).isNotNull(), F.sum(c).over(near) + F.coalesce(F.col(f"_part_{c}"), F.lit(0.0)))
        for c, out in cols.items()
    }
    return (
        df.withColumn("_b", bucket_of(series))
        .join(carry, [*series.keys, "_b"])
        .withColumns(sums)
        .select(*df.columns, *cols.values())
    )
