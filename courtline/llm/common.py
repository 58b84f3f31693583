"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark application.

    The sources go out as one small archive from the driver, so the package need
    not be installed on, or on the Python path of, every machine.
    """
    context = spark.sparkContext
    if getattr(context, "_courtline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="courtline-")), "courtline-sources.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._courtline_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage at files every executor can read, so a lost executor costs
    a re-read and not a recomputation, and values that depend on partitioning
    (row ids, local ranks) are fixed from here on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no column so called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the component's smallest node.

    Alternating large-star / small-star rounds: every round is two aggregations
    and two joins over the current edges, stored in the shared folder, until
    the edge set no longer changes.  A hub's edges are pre-aggregated by the
    minimum and split by the skew join, so no hub is gathered in one task.
    """
    def least_of(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def down(pairs: DataFrame) -> DataFrame:
        return (pairs.filter("u != v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    e = stored(down(edges.select("u", "v")), name)
    seen = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (sym.join(least_of(sym).select("u", F.least("u", "m").alias("m")), "u")
                 .filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = stored(down(large), name)
        small = large.join(least_of(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        e = stored(down(small), name)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def spread_join(rows: DataFrame, single: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Inner join on ``key``, which ``single`` holds once and ``rows`` any number of times.

    The rows of one key are dealt over ``salts`` tasks; ``single`` is sent to each.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    copies = single.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", salt).join(copies, [key, "__salt"]).drop("__salt")


def running_offsets(counts: DataFrame, part: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """``counts`` with ``out`` = sum of ``n`` over the rows of the group before this one.

    Meant for tables of per-task or per-bucket counts, not for raw rows.
    """
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))
