"""Global RANK without a single-partition window, and top-k with a tie-break.

``RANK() OVER (ORDER BY v DESC)`` with no PARTITION BY makes Spark move every
row into one task.  Here the rank is computed from counts of distinct values:

    rank(v) = 1 + number of rows whose value sorts strictly before v

1. ``groupBy(v).count()``: partial aggregation collapses a hot value to one row
   per map task, so a value held by a third of all rows shuffles only a few rows.
2. The distinct values are range-partitioned in rank order into a fixed number
   of partitions (fixed, so adaptive execution keeps the partition ids); the
   values of several rank columns are stacked so one pass ranks them all.
   Within each partition a running sum gives the rows before each value, and a
   per-partition total is formed.
3. The per-partition totals (one row per partition, a proven bound) are turned
   into offsets by a running sum and broadcast back.
4. The (value, rank) table is joined back to the rows on the value; a hot
   value is a skewed key there, which AQE's skew-join rule splits on the row
   side (the preserved side of the left join).

No step holds more than one range of distinct values in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.session import checkpointed


def _order(col: str, descending: bool) -> Column:
    # NULL placement of the original database: first for DESC, last for ASC.
    return F.desc_nulls_first(col) if descending else F.asc_nulls_last(col)


def rank_tables(df: DataFrame, cols: list[str], descending: bool = True,
                partitions: int | None = None) -> DataFrame:
    """(__k, __v, __rank): the rank of every distinct value of each column.

    ``__k`` is the column's position in ``cols``; all columns share one pass:
    the values are stacked as (k, v), counted, range-partitioned on (k, v) into
    a fixed number of partitions, and ranked within each (partition, k) with
    an offset from the earlier partitions of the same k.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("__k"), F.col(c).alias("__v")) for i, c in enumerate(cols)])).alias("__s"))
    counts = (stacked.select("__s.__k", "__s.__v")
                     .groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("__n")))
    order = _order("__v", descending)
    ranged = (counts.repartitionByRange(n_parts, F.asc("__k"), order)
                    .withColumn("__pid", F.spark_partition_id()))
    part = Window.partitionBy("__pid", "__k")
    local = (ranged
             .withColumn("__before", F.coalesce(F.sum("__n").over(
                 part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("__size", F.sum("__n").over(part)))
    # One row per (range partition, column): the bound that makes the broadcast safe.
    offsets = (local.groupBy("__pid", "__k").agg(F.first("__size").alias("__size"))
                    .withColumn("__offset", F.coalesce(F.sum("__size").over(
                        Window.partitionBy("__k").orderBy("__pid")
                              .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                    .drop("__size"))
    return (local.join(F.broadcast(offsets), ["__pid", "__k"])
                 .select("__k", "__v",
                         (1 + F.col("__offset") + F.col("__before")).cast("long").alias("__rank")))


def global_rank(df: DataFrame, col: str, out: str, descending: bool = True,
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``out`` = RANK() OVER (ORDER BY col [DESC]) as a long.

    NULLs rank first for descending order and last for ascending order.
    """
    return global_ranks(df, [(col, out)], descending, partitions)


def global_ranks(df: DataFrame, specs: list[tuple[str, str]], descending: bool = True,
                 partitions: int | None = None) -> DataFrame:
    """Several independent global ranks of one frame: ``specs`` = [(col, out), ...].

    Columns of one data type share a single rank pass; each rank is joined back
    on its value (NULL-safe only where the column can be NULL).
    """
    by_type: dict[str, list[int]] = {}
    for i, (col, _) in enumerate(specs):
        by_type.setdefault(df.schema[col].dataType.simpleString(), []).append(i)
    result = df
    for idxs in by_type.values():
        table = rank_tables(df, [specs[i][0] for i in idxs], descending, partitions)
        for k, i in enumerate(idxs):
            col, out = specs[i]
            ranks = table.where(F.col("__k") == k).select(
                F.col("__v").alias(f"__v{i}"), F.col("__rank").alias(out))
            cond = (result[col].eqNullSafe(ranks[f"__v{i}"]) if df.schema[col].nullable
                    else result[col] == ranks[f"__v{i}"])
            result = result.join(ranks, cond, "left").drop(f"__v{i}")
    return result


def numbered(df: DataFrame, by: list[Column], out: str = "position",
             partitions: int | None = None) -> DataFrame:
    """``df`` with each row's 1-based place in ``by`` order, without a single-partition window.

    ``by`` should be unique.  Rows are range-partitioned (and checkpointed, so
    the partition of a row is fixed), numbered within their partition, and
    offset by the rows of the partitions before (one row per partition).
    """
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n_parts, *by).withColumn("__pid", F.spark_partition_id()))
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", F.lit(0))
    before = F.sum("__n").over(Window.partitionBy("__k").orderBy("__pid")
                               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__pid", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__pid").orderBy(*by))
    return (ranged.withColumn("__rn", place).join(F.broadcast(offsets), "__pid")
                  .withColumn(out, (F.col("__before") + F.col("__rn")).cast("long"))
                  .drop("__pid", "__rn", "__before"))


def top_k(df: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """First ``k`` rows in ``by`` order (planned as TakeOrderedAndProject:
    each task keeps its own k best rows, the final merge sees k per task).
    Pass a unique tie-break as the last key so the cut is deterministic."""
    return df.orderBy(*by).limit(k)
