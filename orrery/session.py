"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orrery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where none is set, a local master gets a folder of its own; a cluster gets an error, since a machine-local
    folder would not outlive the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@functools.cache
def _own_folder(application: str, folder: str) -> str:
    """This application's part of the shared folder; dropped when Python ends, by Spark if it still runs, else from a local disk."""
    path = f"{folder}/orrery-{application}"

    def drop() -> None:
        context = SparkContext._active_spark_context
        if context is not None and context.applicationId == application:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        else:
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)

    atexit.register(drop)
    return path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_folder(spark.sparkContext.applicationId, shared_folder(spark))}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Unlike cached blocks the files survive the loss of an executor, and their size is known to the planner.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def freed(df: DataFrame) -> None:
    """Delete the table that a result of ``written`` reads, once nothing else will read it; other DataFrames are left alone."""
    if path := getattr(df, "_orrery_path", None):
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
