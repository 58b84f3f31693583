"""Stored tables whose contents are replaced in one step (SRC-5, SNK-1).

A table is a folder with two sub-folders:

  versions/<id>/   the rows of one write, complete or not
  commits/         one small JSON file per finished write: version, folder, rows

A write first makes a new folder under ``versions`` that no reader looks at.
Only when it is complete is its commit entry appended, one file that the file
system moves into place whole; the entry with the greatest version is what
readers get.  A write that fails or is killed at any point before leaves the
table as it was, and readers of an older version keep their files until
``retire`` removes them.  Of two writes that commit the same version number the
later stamp wins, so readers always get one write's rows, never a mixture.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from courtline.sources import files

COMMIT_SCHEMA = "version long, folder string, rows long, stamp string"


def history(spark: SparkSession, path: str) -> list[Row]:
    """The commit entries of a table, newest first: one row per write, empty if there is none."""
    try:
        entries = spark.read.schema(COMMIT_SCHEMA).json(f"{path}/commits")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return (entries.filter(F.col("version").isNotNull())
            .orderBy(F.desc("version"), F.desc("stamp"), F.desc("folder")).collect())


def latest(spark: SparkSession, path: str) -> Row | None:
    entries = history(spark, path)
    return entries[0] if entries else None


def stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a version that no reader sees yet; returns its folder."""
    folder = f"{path}/versions/{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(folder)
    return folder


def commit(spark: SparkSession, path: str, folder: str, rows: int | None = None) -> int:
    """Make the staged ``folder`` the table's newest version; returns the version number."""
    last = latest(spark, path)
    version = (last["version"] if last else 0) + 1
    stamp = datetime.datetime.now(datetime.timezone.utc).isoformat()
    entry = spark.createDataFrame([(version, folder.rsplit("/", 1)[1], rows, stamp)], COMMIT_SCHEMA)
    entry.coalesce(1).write.mode("append").json(f"{path}/commits")
    return version


def folder_of(spark: SparkSession, path: str, version: int | None = None) -> str:
    """The folder of a version's rows (default: the newest)."""
    for entry in history(spark, path):
        if version is None or entry["version"] == version:
            return f"{path}/versions/{entry['folder']}"
    raise FileNotFoundError(f"{path}: no such version" if version else f"{path}: no version was ever committed")


def read(spark: SparkSession, path: str, version: int | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of a version of the table (default: the newest)."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(folder_of(spark, path, version))


def replace(df: DataFrame, path: str) -> str:
    """Replace the table's rows by ``df`` in one step; returns the folder of the new version.

    ``df`` may read the table: the version it reads stays.
    """
    folder = stage(df, path)
    commit(df.sparkSession, path, folder)
    return folder


def retire(spark: SparkSession, path: str, keep: int = 1, orphans: bool = False) -> list[str]:
    """Remove the folders of all but the newest ``keep`` versions; returns their names.

    Call it when nothing reads older versions any more.  ``orphans`` also
    removes folders that were never committed, so no write may be under way.
    """
    entries = history(spark, path)
    held = {e["folder"] for e in entries[:max(1, keep)]}
    old = {e["folder"] for e in entries} - held
    gone = [f for f in files.folders(spark, f"{path}/versions")
            if f in old or (orphans and f not in held)]
    for folder in gone:
        files.remove(spark, f"{path}/versions/{folder}")
    return gone
