"""Registered queries against their SQL on the smallest tables."""

import os

import pytest
from compare import connection, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "flagship", "macd", "regime_slope", "vix_join", "asof_ffill", "splits_expanding", "reg_metrics",
    "clf_weighted", "ffill_median_zero", "leakage_report", "perf_summary", "contrib_changes", "load_run",
    "hmm_step", "hmm_path", "fit_garch", "garch_volatility", "adf_lags", "uniform_eval", "saved_model_semi", "impute_train",
)
QUERIES, SQL = entry.queries(), entry.oracle_sql()
CHOSEN = sorted(SQL) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_registry():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 190


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    note = differences(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df())
    assert not note, note
