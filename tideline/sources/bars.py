"""Bars: readers for cached files, builders from event tables, cleaning of raw rows."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tideline.functions.layout import DAILY, Series
from tideline.functions.safe import col

BARS_SCHEMA = "Date STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume BIGINT"
ADJUSTED_SCHEMA = "Date STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, `Adj Close` DOUBLE, Volume BIGINT"
REQUIRED = ("open", "high", "low", "close", "volume")


def bars_from_rows(
    rows: DataFrame, asset: str | Column, ts: Column, price: str, volume: Column, order: Sequence[str]
) -> DataFrame:
    """Open/high/low/close/volume per (asset, ts); ``order`` decides first and last price.

    All five are partial aggregates, so a hot (asset, ts) collapses before the shuffle.
    """
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return rows.groupBy(col(asset).alias("asset"), ts.alias("ts")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        volume.cast("bigint").alias("volume"),
    )


def symbol_of_path(path: Column) -> Column:
    """Symbol part of ``.../{symbol}_{start}_{end}.csv``, percent forms undone."""
    name = F.regexp_extract(path, r"([^/]+?)_[^_/]*_[^_/]*\.\w+$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def symbol_of_file() -> Column:
    return symbol_of_path(F.col("_metadata.file_path"))


def to_utc(x: str | Column) -> Column:
    """Text to a naive UTC timestamp; offsets are applied, unreadable text gives NULL."""
    text = col(x)
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d")
    aware = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")
    naive = text.try_cast("timestamp_ntz")
    return F.when(has_zone, aware).otherwise(naive)


def read_csv_bars(spark: SparkSession, path: str, adjusted: bool = False) -> DataFrame:
    """One CSV per symbol into one long table, with an explicit schema."""
    raw = (
        spark.read.schema(ADJUSTED_SCHEMA if adjusted else BARS_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )
    cols = [F.col("Open").alias("open"), F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close")]
    if adjusted:
        cols.append(F.col("Adj Close").alias("adj_close"))
    return raw.select(symbol_of_file().alias("asset"), to_utc("Date").alias("ts"), *cols, F.col("Volume").alias("volume"))


def read_table(spark: SparkSession, path: str, text: Sequence[str]) -> DataFrame:
    """A Parquet table whose partition columns named in ``text`` stay strings (``0005`` is no number)."""
    schema = spark.read.parquet(path).schema
    kinds = [StructField(f.name, StringType(), f.nullable) if f.name in text else f for f in schema]
    return spark.read.schema(StructType(kinds)).parquet(path)


def read_bars(
    spark: SparkSession, path: str, assets: Sequence[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Parquet bars partitioned by asset; asset and date filters reach the scan."""
    return universe(read_table(spark, path, ["asset"]), assets, start, end)


def universe(
    bars: DataFrame, assets: Sequence[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Named assets between two dates; symbols without rows simply do not appear."""
    out = bars
    if assets is not None:
        out = out.filter(F.col("asset").isin(*assets))
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def list_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Sorted distinct symbols of the cached files; only names are listed, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    return files.select(symbol_of_path(F.col("path")).alias("asset")).distinct().orderBy("asset")


def cache_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row per cached file: name, bytes, modification time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}")
    return files.load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def cache_info(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Number of files and total megabytes."""
    return cache_files(spark, path, fmt).agg(
        F.count(F.lit(1)).alias("files"), F.round(F.sum("bytes") / 1048576, 6).alias("total_mb")
    )


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Bars by asset; a hot asset is split over files by time bucket."""
    from tideline.functions.layout import bucket_of

    laid = bars.withColumn("_b", bucket_of(DAILY)).repartition("asset", "_b").drop("_b")
    laid.write.partitionBy("asset").mode("overwrite").format(fmt).save(path)


def drop_bars(spark: SparkSession, path: str, assets: Sequence[str] | None = None, fmt: str = "parquet") -> int:
    """Delete the cached folders of some assets (all without a list); returns folders deleted.

    Folders are removed through the Hadoop file system of the path; no surviving row is
    rewritten.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    wanted = None if assets is None else set(assets)
    removed = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        # Spark writes characters that paths cannot hold in percent form
        if name.startswith("asset=") and (wanted is None or unquote(name.removeprefix("asset=")) in wanted):
            removed += int(fs.delete(status.getPath(), True))
    return removed


def preprocess(bars: DataFrame) -> DataFrame:
    """Required columns checked, rows with a missing value or an unreadable date dropped."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return bars.na.drop()


def data_info(bars: DataFrame, missing: DataFrame) -> DataFrame:
    """Per asset first and last bar, rows and missing business days (from calendar counts)."""
    stats = bars.groupBy("asset").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows"))
    return stats.join(missing, "asset", "left").withColumn("missing_days", F.coalesce("missing_days", F.lit(0)))


def business_day_gaps(bars: DataFrame) -> DataFrame:
    """(asset, day): business days between first and last bar that have no bar."""
    day = F.col("ts").cast("date")
    span = bars.groupBy("asset").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    expected = span.select("asset", F.explode(F.sequence("lo", "hi")).alias("day")).filter(F.weekday("day") < 5)
    return expected.join(bars.select("asset", day.alias("day")).distinct(), ["asset", "day"], "left_anti")


def missing_day_count(bars: DataFrame) -> DataFrame:
    """(asset, missing_days): business days expected minus rows present, not below zero."""
    day = F.col("ts").cast("date")
    span = bars.groupBy("asset").agg(F.min(day).alias("lo"), F.max(day).alias("hi"), F.count(F.lit(1)).alias("rows"))
    # whole weeks hold five business days; the remainder is counted from the weekday of lo
    days = F.datediff("hi", "lo") + 1
    rest = days % 7
    in_rest = F.size(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: (i < rest) & ((F.weekday("lo") + i) % 7 < 5)))
    expected = F.floor(days / 7) * 5 + in_rest
    return span.select("asset", F.greatest(F.lit(0), expected - F.col("rows")).cast("bigint").alias("missing_days"))
