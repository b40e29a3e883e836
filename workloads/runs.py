"""The whole run on the priority bars, with models that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.config import FeatureSettings, Settings, SplitSettings
from tideline.plans.run import full_run as run_all
from workloads.fixtures import priority_bars, rnd, with_sql
from workloads.registry import query
from workloads.stores import store
from workloads.windows import REGIME, SLOPE, SLOPE2, TARGET, VOL5, shown

_ROWS = (
    VOL5, TARGET, SLOPE, SLOPE2, REGIME,
    "a AS (SELECT t.asset, t.ts, greatest(least(y, 100), -100) AS y, month(t.ts) AS x, CASE regime WHEN 'Bear' THEN 0 WHEN 'Sideways' THEN 1 ELSE 2 END AS c FROM t JOIN regime g ON g.asset = t.asset AND g.ts = t.ts WHERE y IS NOT NULL AND regime IS NOT NULL)",
    "b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY asset) AS n FROM a)",
    "f0 AS (SELECT DISTINCT asset, n, least(5, greatest(0, (n - 5 - 60) // 42)) AS s FROM b WHERE n >= 100)",
    "f1 AS (SELECT asset, n, s, unnest(range(0, s)) AS fold FROM f0)",
    "f2 AS (SELECT asset, fold, n - (s - fold) * 42 AS lo FROM f1)",
    "fr AS (SELECT b.asset, fold, ts, rn, y, x, c, rn >= lo AS test FROM b JOIN f2 USING (asset) WHERE rn < lo - 5 OR (rn >= lo AND rn < lo + 42))",
    "m AS (SELECT asset, fold, coalesce(regr_slope(y, x), 0) AS b, coalesce(regr_intercept(y, x), avg(y)) AS a, arg_max(y, ts) AS y0, arg_max(c, ts) AS c0 FROM fr WHERE NOT test GROUP BY 1, 2)",
    "p AS (SELECT fr.asset, fold, y, c, a + b * x AS linear, y0 AS naive, c0 FROM fr JOIN m USING (asset, fold) WHERE test)",
)
_MSE = rnd("avg((y - {0}) ** 2)", "mse", 5) + ", " + rnd("avg(abs(y - {0}))", "mae", 5) + ", CAST(NULL AS DOUBLE) AS accuracy, count(*) AS test_size"


@query("full_run", with_sql(*_ROWS, select=" UNION ALL ".join(
    [f"SELECT asset, '{m}' AS model, 'regression' AS task, fold, {_MSE.replace('{0}', m)} FROM p GROUP BY asset, fold" for m in ("linear", "naive")]
    + [f"SELECT asset, 'last', 'classification', fold, NULL, NULL, {rnd('avg(CASE WHEN c = c0 THEN 1.0 ELSE 0.0 END)', 'accuracy')}, count(*) FROM p GROUP BY asset, fold"])))
def full_run(spark, sf):
    """Fold metrics of the written run: naive and one-feature linear regression, and the last class."""
    settings = Settings(features=FeatureSettings(use_log_target=False), splits=SplitSettings(test_size=42))
    tables = run_all(priority_bars(spark, sf), settings, store(spark), "run-a", models=("naive", "linear"), classifiers=("last",), modules=("calendar",), features_used=("month_of_year",))
    return shown(tables["fold_metrics"], {"mse": 5, "mae": 5, "accuracy": 6}, ("asset", "model", "task", "fold", "test_size"))
