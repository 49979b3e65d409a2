"""Folders of whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _of(spark, path)
    return system.exists(folder)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, in order; none if it does not exist. Hidden ones are left out."""
    system, folder = _of(spark, path)
    if not system.exists(folder):
        return []
    found = (s for s in system.listStatus(folder) if s.isDirectory())
    return sorted(n for n in (s.getPath().getName() for s in found) if n[0] not in "._")


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a folder and what is in it."""
    system, folder = _of(spark, path)
    return system.delete(folder, True)
