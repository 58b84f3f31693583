"""Long-to-wide pivot of fixed-size groups (e.g. five players of a lineup)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.session import partitions_for

ROWS = 1 << 20   # rows of a task that sorts or collapses them
SALTS = 32       # tasks over which the copies of one row are dealt


def pivot_fixed_groups(rows: DataFrame, keys: list[str], member: str, names: DataFrame,
                       name_expr, size: int = 5, prefix: str = "player") -> DataFrame:
    """One wide row per group with exactly ``size`` name rows.

    Semantics: duplicate (group, member) rows count once; members are numbered
    1.. within the group by member id (NULL last), counting unknown members
    too; a group is kept when its members have ``size`` name rows in all, and
    the greatest name of number k goes to ``{prefix}{k}`` (NULL for an unknown
    member's slot).  A member id that ``names`` holds twice counts twice and
    keeps its one number, since copies of a row share it.

    Plan: the rows are dealt by row and salt, so a row held a third of a table
    long still collapses in many tasks, to one row per salt.  The names,
    aggregated to one row per id, are joined, and one shuffle on the group keys
    serves numbering and grouping, both on one sort.  A row is the first of its
    copies where its row number is its rank, and its slot is the dense rank.
    The number of tasks follows the number of rows, so no task's hash table or
    sort grows with the input; a scan's split holds no hash table at all.
    """
    tasks = partitions_for(rows, ROWS)
    # one column for the group and one for its hash: key columns of one value would be folded out of some
    # of the steps, and the steps would no longer share their shuffle and sort
    salted = rows.select(F.struct(*keys).alias("__group"), F.xxhash64(*keys).alias("__hash"), member,
                         F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt"))
    distinct = salted.repartition(tasks, "__hash", member, "__salt").dropDuplicates().drop("__salt")
    labelled = names.groupBy(member).agg(F.max(name_expr).alias("__name"), F.count(F.lit(1)).alias("__rows"))
    order = Window.partitionBy("__hash", "__group").orderBy(F.asc_nulls_last(member))
    numbered = (distinct.join(labelled, member, "left").repartition(tasks, "__hash")
                .select("__hash", "__group", "__name", "__rows", F.dense_rank().over(order).alias("__slot"),
                        (F.row_number().over(order) == F.rank().over(order)).alias("__first"))
                .where("__first"))
    slots = [F.max(F.when(F.col("__slot") == k, F.col("__name"))).alias(f"{prefix}{k}")
             for k in range(1, size + 1)]
    return (numbered.groupBy("__hash", "__group")
                    .agg(F.sum("__rows").alias("__n"), *slots)
                    .where(F.col("__n") == size)
                    .select("__group.*", *[f"{prefix}{k}" for k in range(1, size + 1)]))
