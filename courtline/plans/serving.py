"""Serving queries over the built tables: the data behind the two dashboards.

* stint data  (team list, per-player summary, scatter points) read from the
  stored ``final_summary`` table, so a team filter is pushed into the scan;
* schedule calendars (scout and coach) as sorted event records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.plans import schedule, stints
from courtline.sources.ingest import read_table


def stored_summary(spark: SparkSession, summary_path: str) -> DataFrame:
    return read_table(spark, summary_path)


def team_list(spark: SparkSession, summary_path: str) -> DataFrame:
    return stints.team_list(stored_summary(spark, summary_path))


def stint_data(spark: SparkSession, summary_path: str, team: str | None = None) -> DataFrame:
    """The summary rows (all teams, or one team when ``team`` is non-empty)."""
    return stints.stint_summary(stored_summary(spark, summary_path), team)


def stint_chart(spark: SparkSession, summary_path: str, team: str | None = None) -> DataFrame:
    return stints.scatter_points(stored_summary(spark, summary_path), team)


def scout_schedule(team: DataFrame, games: DataFrame) -> DataFrame:
    return schedule.calendar(schedule.schedule_difficulty(team, games))


def coach_schedule(team: DataFrame, games: DataFrame, team_name: str) -> DataFrame:
    """The coach's calendar for ``team_name`` (the team's full name)."""
    return schedule.calendar(schedule.opponent_difficulty(team, games, team_name))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object (column name -> value, NULLs included), built on the executors."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """Write a result as JSON Lines (distributed; nothing passes through the driver)."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def register_query_views(spark: SparkSession, frames: dict[str, DataFrame]) -> list[str]:
    """Register the model tables and every query result as lazy session views.

    ``frames`` holds the typed model tables (team, game_schedule, player,
    lineup).  Afterwards e.g. ``spark.sql("SELECT * FROM home_back_to_back")``
    plans the same DataFrame as the function call.  Only the two small
    checkpointed intermediates (per-team standings, rest candidates) are
    computed while registering; every other view stays lazy.
    """
    team, games = frames["team"], frames["game_schedule"]
    player, lineup = frames["player"], frames["lineup"]
    intervals = stints.stint_intervals(lineup, games, team, player)
    durations = stints.stint_durations(intervals)
    summary = stints.win_loss_summary(durations, team, games)
    views = {
        **frames,
        "basic_queries": schedule.team_standings(team, games),
        "home_back_to_back": schedule.back_to_back(team, games, "home"),
        "away_back_to_back": schedule.back_to_back(team, games, "away"),
        "longest_rest": schedule.longest_rest(team, games),
        "three_in_four": schedule.games_in_window(team, games),
        "game_results": schedule.game_results(team, games),
        "team_records": schedule.team_records(team, games),
        "wide_table": stints.lineup_wide(lineup, player),
        "stint_accumulation": stints.stint_intervals_table(intervals),
        "stints_results": stints.stint_results(intervals),
        "stint_durations": stints.stint_durations_table(durations),
        "stints_results_averages": stints.stint_averages(durations),
        "final_summary": summary,
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
