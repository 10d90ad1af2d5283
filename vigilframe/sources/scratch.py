"""Folders of a run in the place that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only where all runs on this machine may that be unset; a
    temporary folder then serves, and goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_folder()).rstrip("/")


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="vigilframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    at = fresh_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _at(spark: SparkSession, path: str):
    """(file system, path) as the engine opens it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """With all that is in it."""
    files, place = _at(spark, path)
    files.delete(place, True)
