"""Session-level helpers: shipping code to executors and cutting lineage."""

from __future__ import annotations

import importlib
import re
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from parquill.errors import EngineError


def ship(*modules: str) -> None:
    """Pickle functions of these packages by value, so executors need no installed copy."""
    for name in modules:
        cloudpickle.register_pickle_by_value(importlib.import_module(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only a session whose executors are in the driver's process may do without one; it gets a temporary one.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise EngineError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="parquill-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of ``spark.checkpoint.dir``.

    Its files go with the table if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables; the path may be anything that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder by Spark's own file system, so any path that its readers open will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
