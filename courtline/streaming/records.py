"""Team records maintained incrementally as new games arrive.

The original recomputes win/loss records from the whole schedule on every
calendar request.  Here the same totals (``record_totals``: a win for the
higher score, ties count as neither) are a Structured Streaming aggregate over
a folder of game files:

* source: Parquet files of typed ``game_schedule`` rows appearing in a folder;
* state: one (wins, losses) pair per team id -- bounded by the number of
  teams, whatever the number of games;
* sink: ``foreachBatch`` writes the named records (joined with the static team
  table) as a plain Parquet table, overwritten each trigger; a trigger that is
  killed while it writes is run again when the query restarts.

The checkpoint lives in the shared ``spark.checkpoint.dir`` so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from courtline.plans.schedule import record_totals
from courtline.session import scratch_path
from courtline.sources.schemas import TARGET


def records_stream(spark: SparkSession, games_dir: str) -> DataFrame:
    """Streaming (team_id, total_wins, total_losses) over the game files in ``games_dir``."""
    games = spark.readStream.schema(TARGET["game_schedule"]).parquet(games_dir)
    return record_totals(games)


def start_records(spark: SparkSession, games_dir: str, team: DataFrame, out_path: str,
                  name_col: str = "teamnickname", alias: str = "team_nickname",
                  available_now: bool = False, query_name: str = "team_records") -> StreamingQuery:
    """Start the query; every trigger rewrites ``out_path`` with the current records."""
    names = (team.select(F.col("teamid").alias("team_id"), F.col(name_col).alias(alias)))

    def write_batch(totals: DataFrame, epoch_id: int) -> None:
        named = totals.join(names, "team_id").select(
            "team_id", alias, "total_wins", "total_losses")
        named.write.mode("overwrite").parquet(out_path)

    writer = (records_stream(spark, games_dir).writeStream
              .outputMode("complete")
              .option("checkpointLocation",
                      scratch_path(spark, os.path.join("streams", query_name), per_application=False))
              .foreachBatch(write_batch)
              .queryName(query_name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
