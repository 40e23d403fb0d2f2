"""The folder that driver and executors share, and tables in it that go when the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session on one machine that names none, as in tests, gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lexspan-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; at the driver's end the session may be gone already."""
    try:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  nothing depends on it
        return
