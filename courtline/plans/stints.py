"""Lineup queries: wide lineups, stints, stint averages and the win/loss summary.

Inputs in the schedule model:
  lineup(team_id, player_id, lineup_num, period, time_in, time_out, game_id)
  game_schedule(game_id, home_id, away_id, home_score, away_score, game_date)
  team(teamid, teamname, ...), player(player_id, first_name, last_name)

Physical plan of the stint chain (Q-7 .. Q-12), the same at every size:

  lineup --dedup (partial agg map-side)--> join on (game, team) with a small
         dimension that already carries dates and team names, join with the
         player names (adaptive execution broadcasts either from its bytes)
         --one exchange on (player_name, game_date, NULL-name salt)-->
            island windows, per-stint aggregate, per-key-5 durations,
            per (player, team, date) pre-aggregate, results
         --exchange on (player_name, team)--> final averages / summary

(player_name, game_date) is contained in every later window partition and
grouping key, so one hash partitioning serves them all; a partition holds one
player's intervals of one day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions.scalars import clock_mmss, full_name, round_diff_of_ratios, round_ratio
from courtline.operators.intervals import number_islands
from courtline.operators.joins import join_role
from courtline.operators.pivot import pivot_fixed_groups
from courtline.plans.schedule import game_results

LINEUP_KEYS = ["game_id", "team_id", "lineup_num", "period", "time_in", "time_out"]
STINT_KEY5 = ["game_date", "team", "player_name", "period", "stint_number"]


# ---------------------------------------------------------------------------
# Q-6 wide lineups
# ---------------------------------------------------------------------------

def lineup_wide(lineup: DataFrame, player: DataFrame, size: int = 5) -> DataFrame:
    """Five-player lineups as one row with player1..player5 (full names)."""
    return pivot_fixed_groups(lineup, LINEUP_KEYS, "player_id", player, full_name(), size=size)


# ---------------------------------------------------------------------------
# JN-8 opponent by CASE key, and Q-7 stint intervals
# ---------------------------------------------------------------------------

def game_team_dim(lineup: DataFrame, games: DataFrame, team: DataFrame) -> DataFrame:
    """One row per (game, team) that a lineup names: date, opponent id and both names.

    The opponent is the away team when the lineup's team is home, else the
    home team (even for a team in neither role).  The pairs are aggregated
    map-side, so names meet a few rows per game and never the lineup itself.
    """
    pairs = lineup.select("game_id", "team_id").distinct()
    rows = pairs.join(games.select("game_id", "home_id", "away_id", "game_date"), "game_id")
    rows = rows.withColumn("opp_id", F.when(F.col("team_id") == F.col("home_id"), F.col("away_id"))
                                      .otherwise(F.col("home_id")))
    rows = join_role(rows, team, "team_id", "teamid", {"teamname": "team"})
    return join_role(rows, team, "opp_id", "teamid", {"teamname": "opponent"})


def with_opponent(lineup: DataFrame, games: DataFrame, team: DataFrame) -> DataFrame:
    """Lineup rows with their game, own team name and opponent name: one join on (game, team)."""
    return lineup.join(game_team_dim(lineup, games, team), ["game_id", "team_id"])


def opponent_key_join(lineup: DataFrame, games: DataFrame, team: DataFrame) -> DataFrame:
    return with_opponent(lineup, games, team).select(
        "game_id", "team_id", "player_id", "lineup_num", "opp_id", "team", "opponent")


def stint_intervals(lineup: DataFrame, games: DataFrame, team: DataFrame,
                    player: DataFrame) -> DataFrame:
    """Every distinct on-court interval with its stint number.

    A stint is an island of touching or overlapping intervals of one player
    name in one game period.  The look-ahead runs per player id inside the
    name partition, as in the original, which also merges same-named players
    of one game when numbering.
    """
    distinct = lineup.select("game_id", "team_id", "player_id", "period", "time_in", "time_out") \
                     .dropDuplicates()
    rows = with_opponent(distinct, games, team)
    names = player.select("player_id", full_name().alias("player_name"))
    rows = rows.join(names, "player_id")
    # NULL names (a missing first or last name) would all hash to one task per
    # day; they are spread by game, which the windows split by anyway.
    rows = rows.withColumn("__salt", F.when(F.col("player_name").isNull(), F.col("game_id")))
    rows = rows.repartition("player_name", "game_date", "__salt")
    numbered = number_islands(
        rows,
        group=["player_name", "game_date", "__salt", "game_id", "period"],
        lead_group=["player_name", "game_date", "__salt", "game_id", "period", "player_id"],
        start="time_in", end="time_out", out="stint_number", ties=["player_id", "team_id"])
    return numbered.select("game_date", "game_id", "team_id", "team", "opponent", "player_name",
                           "period", "time_in", "time_out", "stint_number", "__salt")


# ---------------------------------------------------------------------------
# Q-8 stint results, Q-9 durations
# ---------------------------------------------------------------------------

def _salt(df: DataFrame):
    """The NULL-name salt column if the intervals carry it (see stint_intervals)."""
    return ["__salt"] if "__salt" in df.columns else []


def _stint_groups(intervals: DataFrame) -> DataFrame:
    return (intervals.groupBy("game_date", "game_id", "team", "opponent", "player_name",
                              "period", "stint_number", *_salt(intervals))
                     .agg(F.max("time_in").alias("__in"), F.min("time_out").alias("__out")))


def stint_results(intervals: DataFrame) -> DataFrame:
    """One row per stint (per game) with its start and end clock as MI:SS."""
    return _stint_groups(intervals).select(
        "game_date", "team", "opponent", "player_name", "period", "stint_number",
        clock_mmss("__in").alias("stint_start_time"), clock_mmss("__out").alias("stint_end_time"))


def stint_durations(intervals: DataFrame) -> DataFrame:
    """Distinct stint rows with stint_seconds = max(time_in) - min(time_out).

    The span is taken over all intervals sharing (game_date, team,
    player_name, period, stint_number), as the original's join back on those
    five columns does; rows with a NULL among them have no match and drop out.
    Computed with a window over the per-stint aggregate instead of a join.
    """
    groups = _stint_groups(intervals).where(
        F.col("game_date").isNotNull() & F.col("team").isNotNull() & F.col("player_name").isNotNull()
        & F.col("period").isNotNull())
    # the salt is NULL on every remaining row; keeping it in the key keeps the
    # window on the existing partitioning
    w5 = Window.partitionBy(*STINT_KEY5, *_salt(groups))
    secs = (F.max("__in").over(w5) - F.min("__out").over(w5)).cast("int")
    return (groups.select(
                "game_date", "team", "opponent", "player_name", "period", "stint_number",
                clock_mmss("__in").alias("stint_start_time"),
                clock_mmss("__out").alias("stint_end_time"),
                secs.alias("stint_seconds"), *_salt(groups))
            .dropDuplicates())


def stint_intervals_table(intervals: DataFrame) -> DataFrame:
    """The intervals without the internal salt column (the stored table's shape)."""
    return intervals.drop("__salt")


def stint_durations_table(durations: DataFrame) -> DataFrame:
    """The durations without the internal salt column (the stored table's shape)."""
    return durations.drop("__salt")


# ---------------------------------------------------------------------------
# Q-10 averages, Q-12 win/loss summary (two-level aggregation)
# ---------------------------------------------------------------------------

def _per_day(durations: DataFrame) -> DataFrame:
    """Level 1: per (player_name, team, game_date) stint count and second totals."""
    return durations.groupBy("player_name", "team", "game_date", *_salt(durations)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("stint_seconds").cast("long").alias("s"),
        F.count("stint_seconds").alias("c"))


def stint_averages(durations: DataFrame) -> DataFrame:
    """Stints per game (per distinct date) and mean stint length per player and team."""
    lvl2 = _per_day(durations).groupBy("player_name", "team").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"),
        F.sum("s").alias("s"), F.sum("c").alias("c"))
    return lvl2.select("player_name", "team",
                       round_ratio("n", "days").alias("average_stints_per_game"),
                       round_ratio("s", "c").alias("avg_stint_length_seconds"))


def win_loss_summary(durations: DataFrame, team: DataFrame, games: DataFrame) -> DataFrame:
    """Per player and team: games, stints per game and stint length, overall,
    in wins and in losses, and the win-minus-loss differences.

    Stints are matched to results on (game_date, team name); a tie or missing
    score is a loss.  Level 1 collapses each player-team-date; the results are
    counted per (date, team) so a date with several result rows multiplies the
    contributions exactly as the row-level join would.  "Games" are distinct
    dates.  A side without games gives NULL ratios, and the differences are 0
    when either side is NULL.
    """
    results = (game_results(team, games)
               .groupBy("game_date", "team")
               .agg(F.count_if(F.col("result") == "win").alias("rw"),
                    F.count_if(F.col("result") == "loss").alias("rl")))
    day = _per_day(durations).join(results, ["game_date", "team"])
    rw, rl = F.col("rw"), F.col("rl")
    n, s, c = F.col("n"), F.col("s"), F.col("c")
    lvl2 = day.groupBy("player_name", "team").agg(
        F.count(F.lit(1)).alias("games"),
        F.sum(n * (rw + rl)).alias("n_all"), F.sum(s * (rw + rl)).alias("s_all"),
        F.sum(c * (rw + rl)).alias("c_all"),
        F.count_if(rw > 0).alias("games_won"),
        F.sum(n * rw).alias("n_w"), F.sum(s * rw).alias("s_w"), F.sum(c * rw).alias("c_w"),
        F.count_if(rl > 0).alias("games_lost"),
        F.sum(n * rl).alias("n_l"), F.sum(s * rl).alias("s_l"), F.sum(c * rl).alias("c_l"))
    return lvl2.select(
        "player_name", "team", "games",
        round_ratio("n_all", "games").alias("avg_stints_per_game"),
        round_ratio("s_all", "c_all").alias("avg_stint_length_seconds"),
        "games_won",
        round_ratio("n_w", "games_won").alias("avg_stints_wins"),
        round_ratio("s_w", "c_w").alias("avg_stint_length_wins"),
        "games_lost",
        round_ratio("n_l", "games_lost").alias("avg_stints_losses"),
        round_ratio("s_l", "c_l").alias("avg_stint_length_losses"),
        round_diff_of_ratios("s_w", "c_w", "s_l", "c_l").alias("diff_avg_stint_length"),
        round_diff_of_ratios("n_w", "games_won", "n_l", "games_lost").alias("diff_avg_stints_per_game"))


# ---------------------------------------------------------------------------
# Q-13 .. Q-15 serving queries over the summary
# ---------------------------------------------------------------------------

SUMMARY_COLS = ["player_name", "team", "games", "avg_stints_per_game", "avg_stint_length_seconds",
                "games_won", "avg_stints_wins", "avg_stint_length_wins",
                "games_lost", "avg_stints_losses", "avg_stint_length_losses",
                "diff_avg_stint_length", "diff_avg_stints_per_game"]


def team_list(summary: DataFrame) -> DataFrame:
    """Distinct teams of the summary, sorted."""
    return summary.select("team").distinct().orderBy(F.asc_nulls_last("team"))


def stint_summary(summary: DataFrame, team: str | None = None) -> DataFrame:
    """The summary columns, optionally for one team (None or '' = all teams)."""
    if team:
        summary = summary.where(F.col("team") == F.lit(team))
    return summary.select(*SUMMARY_COLS).orderBy(F.asc_nulls_last("player_name"))


def scatter_points(summary: DataFrame, team: str | None = None) -> DataFrame:
    """Chart points: x = games, y = win-minus-loss stint length, label = player."""
    return chart_columns(stint_summary(summary, team))


def chart_columns(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("player_name").alias("label"), "team",
        F.col("games").alias("x"), F.col("diff_avg_stint_length").alias("y"))
