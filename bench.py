"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.operators.features import features  # noqa: E402
from tideline.operators.labels import quartile_labels  # noqa: E402
from tideline.session import local_session, materialise, ship_package  # noqa: E402
from workloads import QUERIES  # noqa: E402
from workloads.fixtures import brand_bars  # noqa: E402

HEADLINE = (
    "flagship",
    "regime_slope",
    "pair_corr",
    "asof_ffill",
    "fold_frames",
    "reg_metrics",
    "roc_auc",
    "vol_quartile",
    "feature_target_corr",
    "residual_tests",
    "linear_contrib",
    "perf_summary",
    "transfer_matrix",
    "fit_arx",
    "fit_garch",
    "impute_train",
    "kbest_mi",
    "uniform_eval",
    "fit_forest",
    "full_run",
)


TABLES = {}


def _brand_bars(spark, sf):
    """Bars are built once and kept as a table; features and labels read that table."""
    TABLES["bars"] = materialise(brand_bars(spark, sf), "bars")
    return TABLES["bars"]


def _brand_features(spark, sf):
    return features(TABLES["bars"])


def _brand_labels(spark, sf):
    return features(TABLES["bars"], ["targets", "regimes"])


def _brand_quartiles(spark, sf):
    return quartile_labels(features(TABLES["bars"], ["targets"]), "vol5")


EXTRA = {
    "brand_bars": _brand_bars,
    "brand_features": _brand_features,
    "brand_labels": _brand_labels,
    "brand_quartiles": _brand_quartiles,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    QUERIES["sma"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in (*EXTRA, *HEADLINE):
        run = EXTRA.get(name) or QUERIES[name]
        start = time.perf_counter()
        run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
