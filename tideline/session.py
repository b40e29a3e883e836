"""Session defaults and tables in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tideline") -> SparkSession:
    """A session for tests and the bench; on a cluster the session is the caller's."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    local_checkpoint_folder(session)
    return session


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run, below the session's shared checkpoint folder."""
    base = _checkpoint_folder(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _checkpoint_folder(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def local_checkpoint_folder(spark: SparkSession) -> None:
    """For tests and single-machine runs: a checkpoint folder where none is set. Does nothing on a cluster."""
    if not _checkpoint_folder(spark) and re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-run-"))


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Long chains of operators that each look at their input more than once multiply the plan;
    a written table ends the chain, keeps column pruning, and survives lost executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ARCHIVE = "tideline.zip"
_shipping = Lock()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Only needed where the package is not installed on the executors (or passed with
    ``--py-files``): group jobs and the small solver import it there.
    """
    sc = spark.sparkContext
    with _shipping:
        if _ARCHIVE in sc._python_includes:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tideline-zip-"), _ARCHIVE)
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tideline", os.path.relpath(full, root)))
        sc.addPyFile(path)


#: Rows per Arrow batch for jobs on whole texts, which may be long.
TEXT_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches in this session, so a Python worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)
