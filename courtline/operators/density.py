"""Schedule density over (entity, date) multisets.

The original queries number every game of a team with a window over all of
the team's games and then look one or two games ahead (LEAD or a self-join on
the game number).  A team's window would then hold all of its games in one
task.  The same answers follow from the *distinct dates* of each team and the
number of games on each date, which partial aggregation produces map-side:

* next distinct date  -> back-to-backs and rest periods,
* running game counts -> "n games within m days" stretches.

A team's distinct dates are bounded by the calendar, so every window over them
runs over a bounded partition regardless of how many games a team has.  Game
numbers come from one distributed sort (``number_within_key``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.session import checkpointed


def dates_per_key(rows: DataFrame, key: str, date_col: str) -> DataFrame:
    """(key, d, m): distinct non-NULL dates of each key with their multiplicity.

    NULL dates sort last in the original (ascending, NULLS LAST), so they are
    never followed by a dated game and never start a counted stretch; they are
    dropped here.
    """
    return (rows.select(F.col(key), F.to_date(F.col(date_col)).alias("d"))
                .where(F.col("d").isNotNull())
                .groupBy(key, "d").agg(F.count(F.lit(1)).alias("m")))


def with_next_date(dated: DataFrame, key: str) -> DataFrame:
    """Add ``nd``: the next distinct date of the same key (NULL for the last)."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("d"))
    return dated.withColumn("nd", F.lead("d").over(w))


def consecutive_day_count(dated: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): games followed by a game on the next day.

    In a sorted list of a key's game dates, a game is followed by one dated one
    day later exactly when it is the last game of its date and the next
    distinct date is the following day; so the count is the number of distinct
    dates whose next distinct date is one day later.
    """
    nxt = with_next_date(dated, key)
    return (nxt.where(F.datediff("nd", "d") == 1)
               .groupBy(key).agg(F.count(F.lit(1)).alias(out)))


def rest_candidates(dated: DataFrame, key: str) -> DataFrame:
    """Every (game, next game) pair of a key as (key, rest_days, last, next, copies).

    For a date x with m games and next distinct date y the sorted list holds
    m - 1 pairs (x, x) of rest 0 and one pair (x, y).  ``copies`` carries the
    m - 1 so that rows can be expanded only where they are needed.
    """
    nxt = with_next_date(dated, key)
    pairs = F.array(
        F.struct(F.datediff("nd", "d").cast("long").alias("rest_days"),
                 F.col("d").alias("last_game_date"), F.col("nd").alias("next_game_date"),
                 F.lit(1).cast("long").alias("copies")),
        F.struct(F.lit(0).cast("long").alias("rest_days"),
                 F.col("d").alias("last_game_date"), F.col("d").alias("next_game_date"),
                 (F.col("m") - 1).cast("long").alias("copies")))
    return (nxt.select(key, F.explode(pairs).alias("p"))
               .select(key, "p.*")
               .where(F.col("next_game_date").isNotNull() & (F.col("copies") > 0)))


COPIES_AT_ONCE = 1 << 16


def expand_copies(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Repeat each row ``copies`` times (then drop the column).

    In two steps, so that no row ever holds an array of more than
    ``COPIES_AT_ONCE`` numbers up to some four billion copies.
    """
    step = F.lit(COPIES_AT_ONCE).cast("long")
    blocks = df.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.floor((F.col(copies) - 1) / step).cast("long"))))
    here = F.least(step, F.col(copies) - F.col("__b") * step)
    return (blocks.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), here)))
                  .drop("__i", "__b", copies))


def longest_rests(candidates: DataFrame, key: str) -> DataFrame:
    """The rest candidates at the maximum of their key (the window meets a key's distinct dates only)."""
    most = F.max("rest_days").over(Window.partitionBy(key))
    return (candidates.withColumn("__most", most)
                      .where(F.col("rest_days") == F.col("__most")).drop("__most"))


def stretch_count(dated: DataFrame, key: str, n_games: int, days: int, out: str) -> DataFrame:
    """(key, out): runs of ``n_games`` consecutive games spanning < ``days`` days.

    Number a key's games 1..N by date.  Position p starts a counted run when
    date(p + n - 1) - date(p) < days, i.e. when p + n - 1 <= C(date(p) + days - 1)
    with C(z) the number of games dated on or before z.  Positions of a date x
    are c(x) - m(x) + 1 .. c(x), so x contributes
        max(0, min(c(x), C(x + days - 1) - (n - 1)) - (c(x) - m(x))).
    Both c and C are running sums over the distinct dates (a RANGE frame on
    the day number).  Keys without any run are absent, as in the original.
    """
    day = F.datediff(F.col("d"), F.lit("1970-01-01").cast("date"))
    dn = dated.withColumn("__day", day)
    w = Window.partitionBy(key).orderBy("__day")
    c_here = F.sum("m").over(w.rangeBetween(Window.unboundedPreceding, 0))
    c_ahead = F.sum("m").over(w.rangeBetween(Window.unboundedPreceding, days - 1))
    runs = (dn.withColumn("__c", c_here).withColumn("__ca", c_ahead)
              .withColumn("__k", F.greatest(
                  F.lit(0).cast("long"),
                  F.least(F.col("__c"), F.col("__ca") - (n_games - 1)) - (F.col("__c") - F.col("m")))))
    return (runs.groupBy(key).agg(F.sum("__k").alias(out))
                .where(F.col(out) > 0))


def number_within_key(rows: DataFrame, key: str, date_col: str, tie: str, out: str) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY key ORDER BY date, tie) without a window over the rows.

    One distributed sort by (key, date, tie) puts the rows in order; NULL dates
    sort after all others.  A row's ordered id (partition number and place in
    the partition) is fixed by a checkpoint.  A key's rows of one partition are
    consecutive, so their numbers are their distance to the first of them plus
    the key's rows in the partitions before.  Those starts are one row per key
    and partition that holds it, so a key with a third of all rows is spread
    over a third of the tasks, also when all its rows share a date or have none.
    ``tie`` should be unique within a key; rows with a NULL key drop out.
    """
    by = [F.asc(key), F.asc_nulls_last(F.to_date(F.col(date_col))), F.asc_nulls_last(tie)]
    placed = checkpointed(rows.where(F.col(key).isNotNull()).orderBy(*by)
                              .withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__pid", F.shiftright("__id", 33))
    starts = placed.groupBy("__pid", key).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__pid")
                               .rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("__pid", key, (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return (placed.join(starts, ["__pid", key])
                  .withColumn(out, (F.col("__id") + F.col("__shift")).cast("long"))
                  .drop("__id", "__pid", "__shift"))
