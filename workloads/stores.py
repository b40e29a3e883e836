"""Sink and source round trips: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.safe import rounded
from tideline.operators import attribution as A
from tideline.operators import metrics as M
from tideline.session import shared_folder
from tideline.sources import bars as B
from tideline.sources.store import ResultStore, load_model, save_model
from workloads.fixtures import FOLD_METRICS_SQL, PREDS, PRIORITY_SQL, predictions_reg, priority_bars, rnd, sliding_folds, with_sql
from workloads.registry import query
from workloads.reports import RES, results
from workloads.windows import shown

_BARS = "SELECT asset, ts, open, high, low, close, volume FROM bars"
_COLS = ("asset", "ts", "open", "high", "low", "close", "volume")


def stored_bars(spark, sf, fmt="parquet"):
    path = shared_folder(spark, "bars")
    B.write_bars(priority_bars(spark, sf), path, fmt)
    return path


def symbol_files(spark, sf):
    """One ``{symbol}_{start}_{end}.csv`` per series: each asset's folder is written by one task and its file renamed."""
    root = shared_folder(spark, "csv")
    cols = [F.col("ts").cast("string").alias("Date"), *(F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume"))]
    bars = priority_bars(spark, sf).select("asset", *cols).repartition("asset")
    bars.write.partitionBy("asset").option("header", True).csv(f"{root}/by_asset")
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/by_asset")):
        symbol = folder.getPath().getName().removeprefix("asset=")
        if folder.isDirectory():
            for part in files.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    files.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/{symbol}_1990-01-01_2025-10-08.csv"))
    return f"{root}/*.csv"


def store(spark):
    return ResultStore(spark, shared_folder(spark, "results"))


@query("scan_bars", "WITH " + PRIORITY_SQL + " " + _BARS)
def scan_bars(spark, sf):
    return B.read_csv_bars(spark, symbol_files(spark, sf)).select(*_COLS)


@query("write_bars", "WITH " + PRIORITY_SQL + " " + _BARS)
def write_bars(spark, sf):
    return B.read_bars(spark, stored_bars(spark, sf)).select(*_COLS)


@query("drop_bars", "WITH " + PRIORITY_SQL + " " + _BARS + " WHERE asset NOT IN ('2-HIGH', '5-LOW')")
def drop_bars(spark, sf):
    path = stored_bars(spark, sf)
    B.drop_bars(spark, path, ["2-HIGH", "5-LOW"])
    return B.read_bars(spark, path).select(*_COLS)


@query("list_symbols", "SELECT DISTINCT o_orderpriority AS asset FROM orders ORDER BY 1")
def list_symbols(spark, sf):
    return B.list_symbols(spark, symbol_files(spark, sf))


@query("cache_info", "SELECT TRUE AS has_files, TRUE AS has_bytes")
def cache_info(spark, sf):
    """Whether the written bars are found; numbers of files follow the session's partitions."""
    return B.cache_info(spark, stored_bars(spark, sf)).select((F.col("files") > 0).alias("has_files"), (F.col("total_mb") > 0).alias("has_bytes"))


def fold_metrics(spark, sf):
    return M.regression_metrics(predictions_reg(spark, sf)).withColumn("task", F.lit("regression"))


@query("sink_metrics", with_sql(*PREDS, FOLD_METRICS_SQL, select=f"SELECT 'csv' AS fmt, asset, model, fold, {rnd('rmse', 'rmse')} FROM fm UNION ALL SELECT 'json', asset, model, fold, {rnd('rmse', 'rmse')} FROM fm"))
def sink_metrics(spark, sf):
    s, df = store(spark), fold_metrics(spark, sf).select("asset", "model", "fold", "rmse")
    schema = "asset STRING, model STRING, fold BIGINT, rmse DOUBLE"
    csv = spark.read.schema(schema).option("header", True).csv(s.export_table(df, "metrics", "csv"))
    js = spark.read.schema(schema).json(s.export_table(df, "metrics", "json"))
    both = csv.withColumn("fmt", F.lit("csv")).unionByName(js.withColumn("fmt", F.lit("json")))
    return shown(both, {"rmse": 6}, ("fmt", "asset", "model", "fold"))


@query("sink_model_results", with_sql(*PREDS, FOLD_METRICS_SQL,
    "np AS (SELECT asset, model, fold, count(*) AS k FROM preds GROUP BY 1, 2, 3)",
    select=f"SELECT 'run-a' AS run_id, fm.asset, model, 'regression' AS task, fold, k AS predictions, test_lo, test_hi, {rnd('mse', 'mse')} FROM fm JOIN np USING (asset, model, fold) JOIN folds f USING (asset, fold)"))
def sink_model_results(spark, sf):
    s = store(spark)
    preds = predictions_reg(spark, sf).withColumn("task", F.lit("regression"))
    s.save_model_results("run-a", preds, fold_metrics(spark, sf), sliding_folds(spark, sf))
    counts = s.load("predictions", "run-a").groupBy("asset", "model", "fold").agg(F.count(F.lit(1)).alias("predictions"))
    folds = s.load("folds", "run-a").select("asset", "fold", "test_lo", "test_hi")
    out = s.load("fold_metrics", "run-a").join(counts, ["asset", "model", "fold"]).join(folds, ["asset", "fold"])
    return shown(out, {"mse": 6}, ("run_id", "asset", "model", "task", "fold", "predictions", "test_lo", "test_hi"))


@query("sink_export", with_sql(*RES, select="SELECT asset, count(*) AS models, string_agg(DISTINCT model, ',' ORDER BY model) AS model_types, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM results GROUP BY asset"))
def sink_export(spark, sf):
    s = store(spark)
    preds = predictions_reg(spark, sf).withColumn("task", F.lit("regression"))
    s.save_model_results("run-a", preds, fold_metrics(spark, sf), sliding_folds(spark, sf))
    paths = s.export_all("run-a", results(spark, sf))
    schema = "asset STRING, models BIGINT, model_types STRING, tasks STRING"
    return spark.read.schema(schema).option("header", True).csv(paths["summary"])


_RUN = '{{"step": {}, "train": 200, "val": 60}}'


@query("sink_run_metadata", with_sql(select=f"""SELECT 'step60' AS run_id, 1 AS revision, '{_RUN.format(60)}' AS config, '{{"rows": ' || (SELECT count(*) FROM bars) || '}}' AS metadata
  UNION ALL SELECT 'step30', 0, '{_RUN.format(30)}', '{{}}'"""))
def sink_run_metadata(spark, sf):
    s = store(spark)
    for run_id, step in (("step60", 60), ("step30", 30)):
        s.start_run(run_id, {"train": 200, "val": 60, "step": step})
    s.update_run("step60", {"rows": priority_bars(spark, sf).count()})
    return s.runs().select("run_id", "revision", "config", "metadata")


@query("sink_leaderboard", with_sql(*PREDS, FOLD_METRICS_SQL, select=f"SELECT model, {rnd('avg(mse)', 'mse_mean')}, {rnd('avg(mae)', 'mae_mean')} FROM fm GROUP BY model"))
def sink_leaderboard(spark, sf):
    s = store(spark)
    board = fold_metrics(spark, sf).groupBy("model").agg(F.avg("mse").alias("mse_mean"), F.avg("mae").alias("mae_mean"))
    s.save_leaderboard(board.filter(F.col("model") == "last"))
    s.save_leaderboard(board)
    return shown(s.load("leaderboard"), {"mse_mean": 6, "mae_mean": 6}, ("model",))


@query("sink_save_results", with_sql(*RES, select=f"SELECT asset, model, task, {rnd('mse', 'mse')}, {rnd('f1', 'f1')} FROM results"))
def sink_save_results(spark, sf):
    s = store(spark)
    s.save("results", results(spark, sf))
    return shown(s.load("results"), {"mse": 6, "f1": 6}, ("asset", "model", "task"))


def _contribution_sql():
    from workloads.attribution import FEAT

    return with_sql(*FEAT, "ct AS (SELECT asset, model, feature, count(*) AS k FROM co GROUP BY 1, 2, 3)",
                    select=f"SELECT asset, model, feature, k AS rows, {rnd('importance', 'importance')} FROM im JOIN ct USING (asset, model, feature)")


@query("sink_contributions", _contribution_sql())
def sink_contributions(spark, sf):
    from workloads.attribution import contributions

    s = store(spark)
    co = contributions(spark, sf).withColumn("task", F.lit("regression"))
    s.save_contributions("run-a", co, A.importance(co, ["asset", "model", "task"]), {"method": "linear"})
    k = s.load("contributions", "run-a").groupBy("asset", "model", "feature").agg(F.count(F.lit(1)).alias("rows"))
    out = s.load("importance", "run-a").join(k, ["asset", "model", "feature"])
    return shown(out, {"importance": 6}, ("asset", "model", "feature", "rows"))


@query("load_run", with_sql(*PREDS, FOLD_METRICS_SQL, select=f"SELECT 'run-b' AS run_id, asset, model, fold, {rnd('mae', 'mae')}, '{{\"step\": 60}}' AS config FROM fm"))
def load_run(spark, sf):
    s = store(spark)
    preds = predictions_reg(spark, sf).withColumn("task", F.lit("regression"))
    for run_id in ("run-a", "run-b"):
        s.start_run(run_id, {"step": 60})
        s.save_model_results(run_id, preds, fold_metrics(spark, sf), sliding_folds(spark, sf))
    run = s.load_run("run-b")
    out = run["fold_metrics"].withColumn("config", run["run"].select("config").scalar())
    return shown(out, {"mae": 6}, ("run_id", "asset", "model", "fold", "config"))


def _score_sql():
    from workloads.models import MODEL_ROWS

    return with_sql(*MODEL_ROWS, select="SELECT asset, count(*) AS rows, TRUE AS finite FROM mr GROUP BY asset")


@query("score_saved", _score_sql())
def score_saved(spark, sf):
    """A saved model, loaded again, scores every row."""
    from tideline.functions.safe import finite
    from tideline.models import trees
    from workloads.models import NAMES, model_rows

    root = shared_folder(spark, "models")
    rows = model_rows(spark, sf)
    model = trees.fit(rows.filter(F.col("asset") == "1-URGENT"), NAMES, "y", "gbt", "regression")
    save_model(model, spark, root, "run-a", "1-URGENT", "gbt", "regression")
    again = load_model(spark, root, "run-a", "1-URGENT", "gbt", "regression")
    out = trees.predict(again, rows, NAMES, "y")
    return out.groupBy("asset").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(finite("y_pred").isNotNull()).alias("finite"))
