"""Streaming records equal the batch records after each batch of new game files."""

import tempfile

from courtline.plans import schedule
from courtline.sources.schemas import TARGET
from courtline.streaming.records import start_records
from fixtures import GAMES, TEAM


def test_stream_matches_batch(spark):
    games_dir = tempfile.mkdtemp(prefix="courtline-games-")
    out = tempfile.mkdtemp(prefix="courtline-rec-") + "/records"
    team = spark.createDataFrame(TEAM, TARGET["team"])
    first, second = GAMES[:7], GAMES[7:]
    spark.createDataFrame(first, TARGET["game_schedule"]).write.mode("append").parquet(games_dir)
    q = start_records(spark, games_dir, team, out, available_now=True, query_name="rec_test")
    q.awaitTermination(120)
    batch1 = schedule.team_records(team, spark.createDataFrame(first, TARGET["game_schedule"]))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch1.collect()))

    spark.createDataFrame(second, TARGET["game_schedule"]).write.mode("append").parquet(games_dir)
    q = start_records(spark, games_dir, team, out, available_now=True, query_name="rec_test")
    q.awaitTermination(120)
    batch2 = schedule.team_records(team, spark.createDataFrame(GAMES, TARGET["game_schedule"]))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch2.collect()))
