"""The batch build: every derived table of the model, written to storage.

Mirrors the start-up build of the original (standings, wide lineups, stint
results, stint averages, final summary) as one Spark job per table.  The two
intermediates that several tables read (the stint intervals and the stint
durations) are written once to the shared checkpoint folder and read back:
that cuts the lineage, so a lost executor recomputes from the written table
rather than from the raw lineup, and the interval windows run once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from courtline.plans import schedule, stints
from courtline.session import scratch_path
from courtline.sources.ingest import read_table, replace_table


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the session's checkpoint folder and return the stored copy."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_all(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Build and replace the derived tables in one step each; returns name -> folder of the new version.

    ``tables`` holds the typed model tables (team, game_schedule, player,
    lineup); an empty lineup yields empty lineup tables, as in the original.
    """
    team, games = tables["team"], tables["game_schedule"]
    player, lineup = tables["player"], tables["lineup"]
    out: dict[str, str] = {}

    def save(df: DataFrame, name: str) -> None:
        out[name] = replace_table(df, os.path.join(out_dir, name))

    save(schedule.team_standings(team, games), "basic_queries")
    save(stints.lineup_wide(lineup, player), "wide_table")

    intervals = materialize(stints.stint_intervals(lineup, games, team, player),
                            "temp_stint_accumulation")  # carries the NULL-name salt column
    save(stints.stint_results(intervals), "stints_results")
    durations = materialize(stints.stint_durations(intervals), "temp_stint_durations")
    save(stints.stint_averages(durations), "stints_results_averages")
    save(stints.win_loss_summary(durations, team, games), "final_summary")
    return out


def register_views(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Expose stored tables (name -> table or version folder) as session views for SQL, e.g.
    ``spark.sql("SELECT * FROM final_summary WHERE team = 'X'")``; filters on
    the views still push down into the Parquet scans."""
    for name, path in paths.items():
        read_table(spark, path).createOrReplaceTempView(name)
    return sorted(paths)


def schedule_reports(team: DataFrame, games: DataFrame) -> dict[str, DataFrame]:
    """The schedule density reports (lazy; the original only displays them)."""
    return {
        "home_back_to_back": schedule.back_to_back(team, games, "home"),
        "away_back_to_back": schedule.back_to_back(team, games, "away"),
        "longest_rest": schedule.longest_rest(team, games),
        "three_in_four": schedule.games_in_window(team, games),
    }
