"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With this, what a query has shuffled is deleted when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if driver and executors are one process, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="polycurate-checkpoints-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/polycurate/{label}-{uuid.uuid4().hex}"
    atexit.register(_quiet_delete, spark, path)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends here, and a lost executor costs no recomputation.

    What the write has shuffled is deleted at its end, so that the disk holds one step's shuffles at a time. The files are deleted when the driver exits; `discard` deletes them earlier.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._polycurate_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind DataFrames made by `settled`, once nothing reads them any more."""
    for df in frames:
        delete_path(df.sparkSession, df._polycurate_path)


def _quiet_delete(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001  the session has usually ended by then
        pass
