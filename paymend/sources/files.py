"""Names and removal of files on whatever store the session reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    store, where = _store(spark, path)
    return [entry.getPath().getName() for entry in store.listStatus(where)] if store.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job itself has written and replaced."""
    store, where = _store(spark, path)
    store.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file in one step."""
    store, where = _store(spark, path)
    store.create(where, True).close()
