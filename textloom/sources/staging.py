"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_USED: set[str] = set()


def staged_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of our own, removed at the end, only on a local master, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = tempfile.mkdtemp(prefix="textloom-")
            atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
        root = f"file://{_OWN[key]}"
    return root.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed with all that it holds when the driver ends."""
    path = f"{staged_root(spark)}/textloom-tables/{spark.sparkContext.applicationId}"
    if path not in _USED:
        _USED.add(path)
        atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread: iteration without growing plans, safe from lost executors."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
