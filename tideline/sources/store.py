"""Result tables on a shared file system, written with Spark's commit protocol.

Tables live below one root: predictions, fold_metrics, folds, metrics, contributions (by
asset, model and task), runs (one row per run and revision), leaderboard (replaced whole).

A run of many tables writes them below a folder of its attempt, step by step; the manifest, one row written last, names
the attempt that is valid. Readers follow the manifest, so they see the tables of the attempt before until all of the new
ones are there. An attempt that broke off is resumed: its ledger tells which steps are finished.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.bars import read_table

KEYS = ("asset", "model", "task")


def path_name(value: str) -> str:
    """A value as Spark spells it in a partition folder: control and reserved characters in percent form."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value) or "__HIVE_DEFAULT_PARTITION__"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class ResultStore:
    """Reads and writes the tables of one or more runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _write(self, df: DataFrame, table: str, run_id: str | None, by: Sequence[str], mode: str) -> None:
        if run_id is not None:
            df = df.withColumn("run_id", F.lit(run_id))
            by = ("run_id", *by)
        by = [c for c in by if c in df.columns]
        if by:
            # few files per key, and a hot (asset, model, task) is split by its size
            df = df.hint("rebalance", *(F.col(c) for c in by))
        path, by = self.path(table), list(by)
        if run_id is not None and mode == "overwrite":
            # the run's folder is replaced whole, so nothing of a former run of the same name is left
            path, by, df = f"{path}/run_id={path_name(run_id)}", by[1:], df.drop("run_id")
            writer = df.write.mode(mode).option("partitionOverwriteMode", "static")
        else:
            writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*by) if by else writer).parquet(path)

    def save(self, table: str, df: DataFrame, run_id: str | None = None, by: Sequence[str] = KEYS) -> None:
        """Write a table. What it held of the same run is replaced whole (of a run with a valid attempt, in that attempt);
        without a run, partitions that appear in df are replaced and others stay."""
        (self if run_id is None else self.view(run_id))._write(df, table, run_id, by, "overwrite")

    def load(self, table: str, run_id: str | None = None) -> DataFrame:
        """A table of one run, or of all: of runs with a valid attempt that attempt's, of others what was saved directly."""
        if run_id is not None:
            view = self.view(run_id)
            return (view if view is not self and view.has(table) else self)._read(table).filter(F.col("run_id") == run_id)
        valid = {run: view for run, view in self._valid().items() if view.has(table)}
        parts = []
        if self.has(table) or not valid:
            direct = self._read(table)
            parts.append(direct.filter(~F.col("run_id").isin(*valid)) if valid and "run_id" in direct.columns else direct)
        parts += [view._read(table).filter(F.col("run_id") == run) for run, view in valid.items()]  # a part per run
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _read(self, table: str) -> DataFrame:
        return read_table(self.spark, self.path(table), ("run_id", *KEYS))

    def has(self, table: str) -> bool:
        return exists(self.spark, self.path(table))

    # ---- attempts -----------------------------------------------------------------

    def _valid(self) -> dict[str, ResultStore]:
        """The valid attempt of every run that has one, by its manifest row written last."""
        if not self.has("manifest"):
            return {}
        last = self.spark.read.parquet(self.path("manifest")).groupBy("run_id").agg(F.max_by("attempt", "written_at").alias("attempt"))
        return {r["run_id"]: self._attempt_store(r["run_id"], r["attempt"]) for r in last.collect()}  # a row per run

    def _attempt_store(self, run_id: str, attempt: str) -> ResultStore:
        return ResultStore(self.spark, f"{self.root}/attempts/{path_name(run_id)}/{attempt}")

    def view(self, run_id: str) -> ResultStore:
        """The store of the run's valid attempt, which stays as it is; this store where the run has none."""
        return self._valid().get(run_id, self)

    def attempt(self, run_id: str, digest: str) -> Attempt:
        """A new attempt of a run, or the last one of the same ``digest`` (of its inputs and settings) that broke off."""
        number = None
        if self.has("begun"):
            mine = self.spark.read.parquet(self.path("begun")).filter((F.col("run_id") == run_id) & (F.col("digest") == digest))
            number = mine.agg(F.max_by("attempt", "written_at")).first()[0]
        valid = self._valid().get(run_id)
        if number is None or (valid is not None and valid.root.endswith(f"/{number}")):
            number = uuid.uuid4().hex
            self._append("begun", [(run_id, number, digest)], "run_id string, attempt string, digest string")
        return Attempt(self, run_id, number)

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        df = self.spark.createDataFrame(rows, schema).withColumn("written_at", F.current_timestamp())
        df.coalesce(1).write.mode("append").parquet(self.path(table))

    def save_model_results(self, run_id: str, predictions: DataFrame, fold_metrics: DataFrame, folds: DataFrame) -> None:
        self.save("predictions", predictions, run_id)
        self.save("fold_metrics", fold_metrics, run_id)
        self.save("folds", folds, run_id, by=("asset",))

    def save_contributions(self, run_id: str, contributions: DataFrame, importance: DataFrame, metadata: dict) -> None:
        self.save("contributions", contributions, run_id)
        self.save("importance", importance, run_id)
        self.update_run(run_id, {"contributions": metadata})

    def save_leaderboard(self, df: DataFrame) -> None:
        """Replace the leaderboard whole."""
        df.coalesce(1).write.mode("overwrite").parquet(self.path("leaderboard"))

    # ---- runs ---------------------------------------------------------------------

    def start_run(self, run_id: str, config: dict, metadata: dict | None = None) -> None:
        self._append_run(run_id, 0, config, metadata or {})

    def update_run(self, run_id: str, metadata: dict) -> None:
        """Append a revision whose metadata is merged over the latest one."""
        latest = self.run(run_id)
        revision, config, before = (latest["revision"] + 1, json.loads(latest["config"]), json.loads(latest["metadata"])) if latest else (0, {}, {})
        self._append_run(run_id, revision, config, {**before, **metadata})

    def _append_run(self, run_id: str, revision: int, config: dict, metadata: dict) -> None:
        row = [(run_id, revision, json.dumps(config, sort_keys=True), json.dumps(metadata, sort_keys=True))]
        df = self.spark.createDataFrame(row, "run_id string, revision int, config string, metadata string")
        df.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").partitionBy("run_id").parquet(self.path("runs"))

    def runs(self) -> DataFrame:
        """Latest revision of every run."""
        df = read_table(self.spark, self.path("runs"), ["run_id"])
        pick = F.max_by(F.struct("revision", "config", "metadata", "written_at"), "revision")
        return df.groupBy("run_id").agg(pick.alias("_r")).select("run_id", "_r.*")

    def run(self, run_id: str):
        """The one latest row of a run, or None."""
        if not self.has("runs"):
            return None
        return self.runs().filter(F.col("run_id") == run_id).first()

    def load_run(self, run_id: str) -> dict[str, DataFrame]:
        """Config and metadata, metrics and predictions of one run, pruned by partition."""
        view = self.view(run_id)  # both tables of one attempt
        return {
            "run": self.runs().filter(F.col("run_id") == run_id),
            "fold_metrics": view.load("fold_metrics", run_id),
            "predictions": view.load("predictions", run_id),
        }

    # ---- exports ------------------------------------------------------------------

    def export_table(self, df: DataFrame, name: str, fmt: str = "csv") -> str:
        """Table as CSV with header, or as JSON records."""
        out = self.path(f"export/{name}_{fmt}")
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(out) if fmt == "csv" else writer.json(out)
        return out

    def export_all(self, run_id: str, metrics: DataFrame) -> dict[str, str]:
        """Metrics, predictions and folds of a run, and the per-asset summary, as CSV."""
        from tideline.operators.reports import export_summary

        tables = {
            "metrics": metrics,
            "predictions": self.load("predictions", run_id),
            "folds": self.load("folds", run_id),
            "summary": export_summary(metrics),
        }
        return {name: self.export_table(df, name) for name, df in tables.items()}


class Attempt:
    """The steps of one run. One process at a time works on an attempt."""

    def __init__(self, store: ResultStore, run_id: str, number: str):
        self.outer, self.run_id, self.number = store, run_id, number
        self.store = store._attempt_store(run_id, number)
        self.seconds: dict[str, float] = {}
        if self.store.has("steps"):
            self.seconds = {r["step"]: r["seconds"] for r in self.store.spark.read.parquet(self.store.path("steps")).collect()}  # a row per step

    def done(self, *names: str) -> bool:
        return all(n in self.seconds for n in names)

    def step(self, name: str, build: Callable[[], DataFrame], by: Sequence[str] = KEYS) -> DataFrame:
        """The table of a step: read where the step is finished, else built, written and entered in the ledger."""
        if not self.done(name):
            started = time.perf_counter()
            self.store.save(name, build(), self.run_id, by)
            self.seconds[name] = time.perf_counter() - started
            self.store._append("steps", [(name, self.seconds[name])], "step string, seconds double")
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.store._read(name).filter(F.col("run_id") == self.run_id).drop("run_id")

    def commit(self) -> None:
        """From now on readers of the run see this attempt."""
        self.outer._append("manifest", [(self.run_id, self.number)], "run_id string, attempt string")


def save_model(model, spark: SparkSession, root: str, run_id: str, asset: str, name: str, task: str) -> str:
    """Persist a pyspark.ml model of a run and add it to the model registry table; models are never overwritten."""
    parts = "/".join(path_name(p) for p in (run_id, asset, name, task))
    path = f"{root.rstrip('/')}/models/{parts}/{uuid.uuid4().hex}"
    model.write().save(path)
    row = spark.createDataFrame([(run_id, asset, name, task, path)], "run_id string, asset string, model string, task string, path string")
    row.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/model_registry")
    return path


def load_model(spark: SparkSession, root: str, run_id: str, asset: str, name: str, task: str):
    """Latest registered model of (run, asset, model, task)."""
    from pyspark.ml import PipelineModel

    registry = spark.read.parquet(f"{root.rstrip('/')}/model_registry")
    mine = (F.col("run_id") == run_id) & (F.col("asset") == asset) & (F.col("model") == name) & (F.col("task") == task)
    path = registry.filter(mine).agg(F.max_by("path", F.struct("written_at", "path"))).first()[0]
    if path is None:
        raise KeyError((run_id, asset, name, task))
    return PipelineModel.load(path)
