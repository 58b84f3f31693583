"""Rewritten operators equal their plain window / self-join forms on random data."""

import datetime as dt
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtline.operators import density
from courtline.operators.ranking import global_rank


@pytest.mark.parametrize("hot", [0.0, 1 / 3])
def test_global_rank_equals_window_rank(spark, hot):
    rnd = random.Random(7)
    rows = [(i, 7 if rnd.random() < hot else rnd.choice([None] + list(range(25)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, v long")
    ours = global_rank(df, "v", "r", partitions=6).select("id", "r")
    plain = df.select("id", F.rank().over(Window.orderBy(F.desc_nulls_first("v"))).cast("long").alias("r"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))
    asc = global_rank(df, "v", "r", descending=False, partitions=5).select("id", "r")
    plain_asc = df.select("id", F.rank().over(Window.orderBy(F.asc_nulls_last("v"))).cast("long").alias("r"))
    assert sorted(map(tuple, asc.collect())) == sorted(map(tuple, plain_asc.collect()))


def _games(spark, seed, n=600, teams=6, hot_share=0.0):
    """Random games; with ``hot_share`` that fraction of games goes to team 0."""
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 0 if rnd.random() < hot_share else rnd.randrange(teams),
             base + dt.timedelta(days=rnd.randrange(40), hours=rnd.randrange(3)))
            for i in range(n)]
    return spark.createDataFrame(rows, "game_id long, team_id long, game_date timestamp_ntz")


def test_stretch_count_equals_self_join(spark):
    for seed, hot in ((1, 0.0), (2, 0.0), (5, 1 / 3)):
        g = _games(spark, seed, hot_share=hot)
        for n_games, days in ((3, 4), (2, 1), (4, 6)):
            dated = density.dates_per_key(g, "team_id", "game_date")
            ours = density.stretch_count(dated, "team_id", n_games, days, "k")
            w = Window.partitionBy("team_id").orderBy(F.to_date("game_date"))
            plain = (g.withColumn("d", F.to_date("game_date"))
                      .withColumn("d_end", F.lead("d", n_games - 1).over(w))
                      .where(F.datediff("d_end", "d") < days)
                      .groupBy("team_id").agg(F.count(F.lit(1)).alias("k")))
            assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect())), (seed, n_games)


@pytest.mark.parametrize("hot", [0.0, 1 / 3])
def test_consecutive_days_equals_lead(spark, hot):
    g = _games(spark, 3, hot_share=hot)
    dated = density.dates_per_key(g, "team_id", "game_date")
    ours = density.consecutive_day_count(dated, "team_id", "k")
    w = Window.partitionBy("team_id").orderBy(F.to_date("game_date"))
    plain = (g.withColumn("d", F.to_date("game_date")).withColumn("nd", F.lead("d").over(w))
              .where(F.datediff("nd", "d") == 1).groupBy("team_id").agg(F.count(F.lit(1)).alias("k")))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("hot", [0.0, 1 / 3])
def test_number_within_key_equals_row_number(spark, hot):
    g = _games(spark, 4, hot_share=hot)
    ours = density.number_within_key(g, "team_id", "game_date", "game_id", "n").select("game_id", "n")
    w = Window.partitionBy("team_id").orderBy(F.to_date("game_date"), "game_id")
    plain = g.select("game_id", F.row_number().over(w).cast("long").alias("n"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("when", [dt.datetime(2024, 1, 3), None])
def test_number_within_key_with_one_date_or_none(spark, when):
    """All games of one key on one date, or on no date, over several sort partitions."""
    spread = [(10_000 + i, i % 3, dt.datetime(2024, 1, 1 + i % 5)) for i in range(60)]
    hot = [(i, 7, when) for i in range(2000)]
    g = spark.createDataFrame(spread + hot + [(50_000, None, when)],
                              "game_id long, team_id long, game_date timestamp_ntz").repartition(5)
    ours = density.number_within_key(g, "team_id", "game_date", "game_id", "n")
    assert ours.columns.count("game_id") == 1 and not [c for c in ours.columns if c.startswith("__")]
    w = Window.partitionBy("team_id").orderBy(F.asc_nulls_last(F.to_date("game_date")), "game_id")
    plain = g.where("team_id IS NOT NULL").select("game_id", F.row_number().over(w).cast("long").alias("n"))
    assert sorted(map(tuple, ours.select("game_id", "n").collect())) == sorted(map(tuple, plain.collect()))


def test_copies_expand_in_blocks(spark):
    n = density.COPIES_AT_ONCE
    rows = [("a", 1), ("b", n), ("c", n + 1), ("d", 2 * n + 5)]
    out = density.expand_copies(spark.createDataFrame(rows, "k string, copies long"))
    assert out.columns == ["k"]
    assert dict(map(tuple, out.groupBy("k").count().collect())) == dict(rows)


def test_number_within_key_of_nothing(spark):
    g = _games(spark, 6).limit(0)
    assert density.number_within_key(g, "team_id", "game_date", "game_id", "n").count() == 0


def test_driver_table_properties(spark):
    """SURVEY section 5 properties on the driver tables at sf0.01."""
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    q = E.queries()
    st = q["team_standings"](spark, sf).agg(
        F.sum("games_played").alias("gp"), F.sum("wins").alias("w"), F.sum("losses").alias("l"),
        F.sum("home_games").alias("h"), F.sum("away_games").alias("a")).first()
    games = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert st.gp == 2 * games and st.h == games and st.a == games   # every id maps to a team
    assert st.w == st.l                                            # one win and one loss per decided game
    intervals = q["stint_intervals"](spark, sf).count()
    stint_rows = q["stint_results"](spark, sf).count()
    assert 0 < stint_rows <= intervals
    res = q["game_results"](spark, sf).groupBy("result").count().collect()
    assert sum(r["count"] for r in res) == 2 * games
