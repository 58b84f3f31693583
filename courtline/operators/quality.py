"""Data-quality operators: primary-key violations and duplicate removal.

Spark does not enforce keys, so the key constraints of the schedule model are
checked as queries.  Both operators aggregate with partial aggregation first,
so a key repeated across a third of the table still collapses map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) for every key value that occurs more than once or has a NULL part."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) | any_null))


def assert_key(df: DataFrame, keys: list[str], table: str = "table") -> None:
    """Raise if ``keys`` is not a primary key of ``df`` (one small job)."""
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"{table}: key {keys} violated, e.g. {[tuple(r) for r in bad]}")


def distinct_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """SELECT DISTINCT over ``cols`` (all columns if None)."""
    return (df.select(*cols) if cols else df).dropDuplicates()
