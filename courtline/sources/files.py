"""Folders of the file system that a path belongs to, by Spark's own file system classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path``, sorted; none if it does not exist."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    """Delete the folder ``path`` with all that it holds."""
    fs, place = _at(spark, path)
    fs.delete(place, True)
