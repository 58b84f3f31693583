"""Gaps and islands: merge touching or overlapping intervals into numbered runs.

Intervals are ordered by (start DESC, end DESC), because the game clock counts
down (an interval runs from ``time_in`` down to ``time_out``).  Walking the
intervals in that order, a new island starts after an interval whose
successor begins before the interval ends, i.e. ``next_start < end``; equal or
overlapping clock values continue the island.  Numbering restarts in every
group.  This is the LEAD / LAG / running SUM formulation, kept as three window
expressions so that Spark evaluates them over one sort per window spec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_islands(df: DataFrame, group: list[str], start: str, end: str, out: str,
                   lead_group: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Add ``out``: 1-based island number of each interval within ``group``.

    ``lead_group`` optionally gives a finer partition for finding the next
    interval (the original looks ahead per player id but numbers islands per
    player name); it must contain ``group``.  ``ties`` order intervals of equal clock
    values, which the original leaves open.  NULL clock values sort first, as
    in the original database for descending order.
    """
    order = [F.desc_nulls_first(start), F.desc_nulls_first(end),
             *[F.asc_nulls_last(c) for c in ties or []]]
    w_lead = Window.partitionBy(*(lead_group or group)).orderBy(*order)
    w_num = Window.partitionBy(*group).orderBy(*order)
    nxt = F.lead(start).over(w_lead)
    flagged = df.withColumn(
        "__brk", F.when(nxt.isNotNull() & (nxt < F.col(end)), 1).otherwise(0))
    prev_brk = F.lag("__brk", 1, 0).over(w_num)
    stepped = flagged.withColumn("__step", prev_brk)
    running = F.sum("__step").over(w_num.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(out, (running + 1).cast("long")).drop("__brk", "__step")
