"""Walk-forward folds as tables of position ranges, and rows joined to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import SplitSettings
from tideline.functions.safe import finite
from tideline.functions.skew import join_stats
from tideline.operators.align import range_join

RANGES = ("train_lo", "train_hi", "test_lo", "test_hi")
_BATCH = 4096


def lengths(rows: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _numbered(df: DataFrame, count: Column, name: str) -> DataFrame:
    """One row per 0 <= name < count, in two steps so no long array is ever held."""
    batches = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / _BATCH)))
    df = df.withColumn("_count", count.cast("bigint")).withColumn("_batch", F.explode(batches))
    last = F.least(F.col("_batch") * _BATCH + _BATCH - 1, F.col("_count") - 1)
    return df.withColumn(name, F.explode(F.sequence(F.col("_batch") * _BATCH, last))).drop("_count", "_batch")


def sliding_splits(sizes: DataFrame, train: int, val: int, step: int) -> DataFrame:
    """Fixed windows: train rows, then validation rows, moved on by ``step``."""
    keys = [c for c in sizes.columns if c != "n"]
    count = F.when(F.col("n") >= train + val, F.floor((F.col("n") - train - val) / step) + 1).otherwise(F.lit(0))
    start = F.col("fold") * step
    return _numbered(sizes, count, "fold").select(
        *keys,
        "fold",
        start.alias("train_lo"),
        (start + train).alias("train_hi"),
        (start + train).alias("test_lo"),
        (start + train + val).alias("test_hi"),
    )


def _div(a: Column, b) -> Column:
    return F.floor(a / b)


def walk_forward_splits(sizes: DataFrame, cfg: SplitSettings | None = None) -> DataFrame:
    """Splits by the strategy of the settings."""
    cfg = cfg or SplitSettings()
    strategies = {"fixed": fixed_splits, "adaptive": adaptive_splits}
    if cfg.strategy not in strategies:
        raise ValueError(f"unknown strategy {cfg.strategy!r}; available: {sorted(strategies)}")
    return strategies[cfg.strategy](sizes, cfg)


def fixed_splits(sizes: DataFrame, cfg: SplitSettings) -> DataFrame:
    """Test blocks of ``test_size`` rows that end with the series, as many as leave ``min_train`` rows for the first."""
    keys = [c for c in sizes.columns if c != "n"]
    n, gap, test = F.col("n"), max(0, cfg.gap), cfg.test_size
    count = F.least(F.lit(cfg.n_splits), F.greatest(F.lit(0), _div(n - gap - cfg.min_train, test)))
    rows = _numbered(sizes.withColumn("_s", count), F.col("_s"), "fold")
    test_lo = n - (F.col("_s") - F.col("fold")) * test
    first = n - F.col("_s") * test - gap
    train_hi = test_lo - gap
    train_lo = F.lit(0) if cfg.expanding else train_hi - first
    if cfg.max_train:
        train_lo = F.greatest(train_lo, train_hi - cfg.max_train)
    out = rows.withColumns({"train_lo": train_lo.cast("bigint"), "train_hi": train_hi.cast("bigint"), "test_lo": test_lo.cast("bigint"), "test_hi": (test_lo + test).cast("bigint")})
    return valid_splits(out, cfg.min_train, cfg.min_test).select(*keys, "fold", *RANGES)


def unsplit(sizes: DataFrame, folds: DataFrame) -> DataFrame:
    """Series without any fold, with their length: what an evaluation leaves out."""
    keys = [c for c in sizes.columns if c != "n"]
    return sizes.join(folds.select(*keys).distinct(), keys, "left_anti")


def adaptive_splits(sizes: DataFrame, cfg: SplitSettings | None = None) -> DataFrame:
    """Walk-forward splits whose test size, count and first train size follow the length.

    With a single split the train size is worked out after the test block has grown, and
    the minimum train size never exceeds a train cap; otherwise short or long series
    would lose all their folds.
    """
    cfg = cfg or SplitSettings(strategy="adaptive")
    keys = [c for c in sizes.columns if c != "n"]
    n, gap = F.col("n"), max(0, cfg.gap)
    wanted = max(cfg.min_test, cfg.test_size)
    by_share = F.greatest(F.lit(cfg.min_test), F.least(F.lit(cfg.most_test), F.greatest(F.lit(1), _div(n, cfg.test_share))))
    block = F.least(F.lit(wanted), by_share)
    by_length = F.lit(cfg.short_splits)
    for least, count in sorted(cfg.length_steps):
        by_length = F.when(n >= least, count).otherwise(by_length)
    feasible = F.greatest(F.lit(1), _div(n - max(cfg.min_train, cfg.reserve), F.greatest(F.lit(1), F.col("_block"))))
    splits = F.least(F.lit(max(1, cfg.n_splits)), by_length, feasible)
    single = F.greatest(F.lit(cfg.min_test), F.least(F.lit(wanted), F.greatest(F.lit(1), _div(n, cfg.single_share))))
    first = F.when(F.col("_s") == 1, F.greatest(F.lit(cfg.min_train), n - F.col("_test") - gap)).otherwise(
        F.greatest(F.lit(cfg.min_train), F.least(F.lit(cfg.first_most), F.greatest(F.lit(cfg.first_least), _div(n, cfg.first_share))))
    )
    base = (
        sizes.withColumn("_block", block)
        .withColumn("_s", splits)
        .withColumn("_test", F.when(F.col("_s") == 1, single).otherwise(F.col("_block")))
        .withColumn("_first", first)
    )
    rows = _numbered(base, F.col("_s"), "fold")
    i, test, start, cap = F.col("fold"), F.col("_test"), F.col("_first"), cfg.max_train
    if cfg.expanding:
        train_hi = F.when(F.col("_s") == 1, n - test - gap).otherwise(start + _div((n - test - gap - start) * (i + 1), F.col("_s")))
        train_lo = F.greatest(F.lit(0), F.col("train_hi") - cap) if cap else F.lit(0)
        test_hi = F.least(F.col("test_lo") + test, n)
    else:
        train_hi = start + i * (test + gap)
        train_lo = F.greatest(F.lit(0), F.col("train_hi") - (F.least(start, F.lit(cap)) if cap else start))
        test_hi = F.col("test_lo") + test
        rows = rows.filter(n - test - gap > start)
    out = rows.withColumn("train_hi", train_hi.cast("bigint")).withColumn("train_lo", train_lo.cast("bigint"))
    out = out.withColumn("test_lo", F.col("train_hi") + gap).withColumn("test_hi", test_hi.cast("bigint"))
    least = F.least(start, F.lit(cap)) if cap else start
    return valid_splits(out, least, cfg.min_test).select(*keys, "fold", *RANGES)


def valid_splits(folds: DataFrame, min_train: Column | int, min_test: int) -> DataFrame:
    """Folds inside the series (needs ``n``) whose parts are large enough."""
    least = F.lit(min_train) if isinstance(min_train, int) else min_train
    return folds.filter(
        (F.col("train_lo") >= 0)
        & (F.col("train_hi") > F.col("train_lo"))
        & (F.col("test_lo") >= F.col("train_hi"))
        & (F.col("test_hi") > F.col("test_lo"))
        & (F.col("test_hi") <= F.col("n"))
        & (F.col("train_hi") - F.col("train_lo") >= least)
        & (F.col("test_hi") - F.col("test_lo") >= min_test)
    )


def time_series_splits(sizes: DataFrame, k: int) -> DataFrame:
    """k expanding folds whose test blocks of n // (k + 1) rows end at the last row."""
    keys = [c for c in sizes.columns if c != "n"]
    test = _div(F.col("n"), k + 1)
    out = sizes.withColumn("_test", test).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
    start = F.col("n") - (k - F.col("fold")) * F.col("_test")
    return out.filter(F.col("_test") > 0).select(
        *keys, "fold", F.lit(0).cast("bigint").alias("train_lo"), start.alias("train_hi"), start.alias("test_lo"), (start + F.col("_test")).alias("test_hi")
    )


def fold_frames(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = ("asset",), position: str = "rn") -> DataFrame:
    """Rows with their ``fold`` and ``role`` (train or test); a row may be in many folds."""
    part = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"{role}_lo").alias("_lo"), F.col(f"{role}_hi").alias("_hi"))
    ranges = folds.select(*keys, "fold", F.explode(F.array(part("train"), part("test"))).alias("_p")).select(*keys, "fold", "_p.*")
    return range_join(rows, ranges, keys, position, "_lo", "_hi").drop("_lo", "_hi")


def held_out(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = ("asset",), position: str = "rn") -> DataFrame:
    """The test rows of every fold, with ``fold``."""
    return range_join(rows, folds.select(*keys, "fold", "test_lo", "test_hi"), list(keys), position, "test_lo", "test_hi").drop("test_lo", "test_hi")


def fold_index(frames: DataFrame, keys: Sequence[str] = ("asset",), time: str = "ts") -> DataFrame:
    """Per fold: first and last train and test time, and sizes."""
    cols = []
    for role in ("train", "test"):
        here = F.when(F.col("role") == role, F.col(time))
        cols += [F.min(here).alias(f"{role}_start"), F.max(here).alias(f"{role}_end"), F.count(here).alias(f"{role}_size")]
    return frames.groupBy(*keys, "fold").agg(*cols)


def impute_frames(frames: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",), accuracy: int = 10000) -> DataFrame:
    """Missing and infinite cells become the median of their fold's train rows, else 0.

    Medians are mergeable sketches (off by at most a rank share of 1 / accuracy), so a fold of any size is an aggregate.
    """
    train = F.col("role") == "train"
    meds = frames.groupBy(*keys, "fold").agg(*[F.percentile_approx(F.when(train, finite(c)), 0.5, accuracy).alias(f"_med_{c}") for c in cols])
    fixed = {c: F.coalesce(finite(c), F.col(f"_med_{c}"), F.lit(0.0)) for c in cols}
    return join_stats(frames, meds, [*keys, "fold"]).withColumns(fixed).select(*frames.columns)


def select_frames(frames: DataFrame, dropped: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Features dropped for a fold are held constant in it, so no model can use them there.

    ``dropped``: (keys, fold, feature).
    """
    lists = dropped.groupBy(*keys, "fold").agg(F.collect_set("feature").alias("_gone"))  # at most the configured features
    out = join_stats(frames, lists, [*keys, "fold"], "left")
    gone = lambda c: F.coalesce(F.array_contains("_gone", c), F.lit(False))
    return out.withColumns({c: F.when(gone(c), F.lit(0.0)).otherwise(F.col(c)) for c in cols}).select(*frames.columns)


def finite_targets(frames: DataFrame, target: str = "y") -> DataFrame:
    return frames.filter(finite(target).isNotNull())


def scale_folds(
    frames: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",), kind: str = "standard"
) -> DataFrame:
    """Scale every fold by its own train rows: standard (population) or min-max."""
    here = lambda c: F.when(F.col("role") == "train", F.col(c))
    aggs = []
    for c in cols:
        if kind == "standard":
            aggs += [F.avg(here(c)).alias(f"_a_{c}"), F.stddev_pop(here(c)).alias(f"_b_{c}")]
        else:
            aggs += [F.min(here(c)).alias(f"_a_{c}"), (F.max(here(c)) - F.min(here(c))).alias(f"_b_{c}")]
    stats = frames.groupBy(*keys, "fold").agg(*aggs)
    scale = lambda c: F.when(F.col(f"_b_{c}") > 0, F.col(f"_b_{c}")).otherwise(F.lit(1.0))
    return (
        join_stats(frames, stats, [*keys, "fold"])
        .withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / scale(c) for c in cols})
        .select(*frames.columns)
    )


def scale_sequences(
    frames: DataFrame, x: str = "x_seq", length: int = 10, keys: Sequence[str] = ("asset",), kind: str = "standard"
) -> DataFrame:
    """Scale each position of a sequence column by the fold's train rows; adds ``x_flat``."""
    names = [f"_x{i}" for i in range(length)]
    wide = frames.withColumns({n: F.element_at(x, i + 1) for i, n in enumerate(names)})
    out = scale_folds(wide, names, keys, kind)
    return out.withColumn(x, F.array(*names)).withColumn("x_flat", F.col(x)).select(*frames.columns, "x_flat")


def log_targets(frames: DataFrame, target: str = "y", keys: Sequence[str] = ("asset",), eps: float = 1e-8) -> DataFrame:
    """Log of the target in folds whose train minimum is positive; ``logged`` tells which."""
    low = frames.groupBy(*keys, "fold").agg(F.min(F.when(F.col("role") == "train", F.col(target))).alias("_low"))
    logged = F.coalesce(F.col("_low") > 0, F.lit(False))
    value = F.when(F.col("logged"), F.log(F.when(F.col(target) + eps > 0, F.col(target) + eps))).otherwise(F.col(target))
    return join_stats(frames, low, [*keys, "fold"]).withColumn("logged", logged).withColumn(target, value).drop("_low")


def infer_task(frames: DataFrame, target: str = "y", keys: Sequence[str] = ("asset",), most: int = 10) -> DataFrame:
    """classification for at most ``most`` distinct values, else regression."""
    few = F.count_distinct(target) <= most
    return frames.groupBy(*keys).agg(F.when(few, "classification").otherwise("regression").alias("task"))


def drop_bad_folds(preds: DataFrame, keys: Sequence[str] = ("asset", "model", "fold"), expected: DataFrame | None = None) -> DataFrame:
    """Folds with a missing or infinite prediction, or of unexpected length, are left out."""
    bad = preds.groupBy(*keys).agg(F.bool_or(finite("y_pred").isNull()).alias("_bad"), F.count(F.lit(1)).alias("_size"))
    if expected is not None:
        on = [k for k in keys if k in expected.columns]
        bad = bad.join(expected.withColumnRenamed("test_size", "_want"), on, "left")
        bad = bad.withColumn("_bad", F.col("_bad") | ~F.col("_size").eqNullSafe(F.col("_want")))
    return preds.join(bad.filter("_bad").select(*keys), list(keys), "left_anti")


def split_info(folds: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Count, and min/max/mean/population deviation of train and test sizes."""
    cols = [F.count(F.lit(1)).alias("n_splits")]
    for role in ("train", "test"):
        size = F.col(f"{role}_hi") - F.col(f"{role}_lo")
        cols += [F.min(size).alias(f"{role}_min"), F.max(size).alias(f"{role}_max"), F.avg(size).alias(f"{role}_mean"), F.stddev_pop(size).alias(f"{role}_std")]
    total = F.col("train_hi") - F.col("train_lo") + F.col("test_hi") - F.col("test_lo")
    return folds.groupBy(*keys).agg(*cols, F.sum(total).alias("total_samples"))


def fold_overlap(folds: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Share of each fold's train (test) rows that the next fold also holds: min, max, mean.

    Sliding folds differ by one fold number, so the next fold is found by an equality join
    on (keys, fold) and no series is gathered in one task.
    """
    nxt = folds.select(*keys, (F.col("fold") - 1).alias("fold"), *[F.col(c).alias(f"_{c}") for c in RANGES])
    cols = []
    both = folds.join(nxt, [*keys, "fold"])
    for role in ("train", "test"):
        lo, hi = F.col(f"{role}_lo"), F.col(f"{role}_hi")
        common = F.greatest(F.lit(0), F.least(hi, F.col(f"_{role}_hi")) - F.greatest(lo, F.col(f"_{role}_lo")))
        share = F.try_divide(common.cast("double"), (hi - lo).cast("double"))
        cols += [F.min(share).alias(f"{role}_overlap_min"), F.max(share).alias(f"{role}_overlap_max"), F.avg(share).alias(f"{role}_overlap_mean")]
    return both.groupBy(*keys).agg(*cols)
