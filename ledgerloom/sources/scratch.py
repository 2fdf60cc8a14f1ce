"""The folder that driver and executors share, and computing a table once into it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and the driver is the executor."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    known, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
    if not at and known.isDefined():
        return known.get()
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return at or tempfile.mkdtemp(prefix="ledgerloom-")


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and ends its lineage there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
