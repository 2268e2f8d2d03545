"""What operators need of the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, which the session names in ``spark.checkpoint.dir``.

    Where it is unset, a folder that was set before is kept, and a session in a
    single process gets one that is removed when Python ends; on a cluster it is an error, as a folder of one machine is not there for the
    others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder; later uses read them there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete what :func:`checkpoint` wrote for ``df``; no later query may read it."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _delete(df.sparkSession, file.get())


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder, for a table that is written in parts."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4()}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that was written under :func:`scratch`."""
    _delete(spark, path)


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` in a form whose partitions have the same rows in the same order whenever a task runs again.

    A scan's have; rows out of a shuffle may come in another order, so they are
    written to the shared folder first.
    """
    return checkpoint(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
