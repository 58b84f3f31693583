"""Stint chain and lineup pivot on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from courtline.oracle import COACH_TEAM
from courtline.plans import stints
from duck_model import check, duck_con
from fixtures import EDGE_LINEUP, PIVOT_LINEUP, STINT_GAMES, STINT_LINEUP, frames, pandas_tables


def _intervals(m):
    return stints.stint_intervals(m["lineup"], m["game_schedule"], m["team"], m["player"])


def _durations(m):
    return stints.stint_durations(_intervals(m))


def _summary(m):
    return stints.win_loss_summary(_durations(m), m["team"], m["game_schedule"])


QUERIES = {
    "opponent_key_join": lambda m: stints.opponent_key_join(m["lineup"], m["game_schedule"], m["team"]),
    "stint_intervals": lambda m: stints.stint_intervals_table(_intervals(m)),
    "stint_results": lambda m: stints.stint_results(_intervals(m)),
    "stint_durations": lambda m: stints.stint_durations_table(_durations(m)),
    "stint_averages": lambda m: stints.stint_averages(_durations(m)),
    "win_loss_summary": _summary,
    "team_list": lambda m: stints.team_list(_summary(m)),
    "stint_summary_all": lambda m: stints.stint_summary(_summary(m)),
    "stint_summary_team": lambda m: stints.stint_summary(_summary(m), COACH_TEAM),
    "scatter_points": lambda m: stints.scatter_points(_summary(m)),
}


@pytest.fixture(scope="module")
def basic(spark):
    return frames(spark, games=STINT_GAMES, lineup=STINT_LINEUP)


@pytest.fixture(scope="module")
def edge(spark):
    return frames(spark, games=STINT_GAMES, lineup=EDGE_LINEUP)


def test_expected_stints(basic):
    got = sorted((r.game_date.day, r.player_name, r.period, r.stint_number, r.stint_start_time,
                  r.stint_end_time, r.stint_seconds)
                 for r in _durations(basic).collect())
    assert got == [
        (1, "Ann Lee", 1, 1, "12:00", "08:00", 240),
        (1, "Ann Lee", 1, 2, "05:00", "02:00", 180),
        (1, "Ann Lee", 2, 1, "12:00", "00:00", 720),
        (1, "Bob Ray", 1, 1, "12:00", "05:00", 420),
        (3, "Ann Lee", 1, 1, "12:00", "00:00", 720),
    ]


def test_expected_summary(basic):
    rows = {r.player_name: r for r in _summary(basic).collect()}
    a = rows["Ann Lee"]
    assert (a.games, a.avg_stints_per_game, a.avg_stint_length_seconds) == (2, 2.0, 465.0)
    assert (a.games_won, a.avg_stints_wins, a.avg_stint_length_wins) == (1, 3.0, 380.0)
    assert (a.games_lost, a.avg_stints_losses, a.avg_stint_length_losses) == (1, 1.0, 720.0)
    assert (a.diff_avg_stint_length, a.diff_avg_stints_per_game) == (-340.0, 2.0)
    b = rows["Bob Ray"]
    assert (b.games, b.avg_stints_per_game, b.avg_stint_length_seconds) == (1, 1.0, 420.0)
    assert (b.games_won, b.avg_stints_wins, b.avg_stint_length_wins) == (0, None, None)
    assert (b.games_lost, b.avg_stints_losses, b.avg_stint_length_losses) == (1, 1.0, 420.0)
    assert (b.diff_avg_stint_length, b.diff_avg_stints_per_game) == (0.0, 0.0)


def test_averages(basic):
    rows = {r.player_name: r for r in stints.stint_averages(_durations(basic)).collect()}
    assert (rows["Ann Lee"].average_stints_per_game, rows["Ann Lee"].avg_stint_length_seconds) == (2.0, 465.0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_basic_matches_plain_sql(basic, name):
    con = duck_con(pandas_tables(games=STINT_GAMES, lineup=STINT_LINEUP))
    check(con, name, QUERIES[name](basic))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_matches_plain_sql(edge, name):
    con = duck_con(pandas_tables(games=STINT_GAMES, lineup=EDGE_LINEUP))
    check(con, name, QUERIES[name](edge))


def test_same_name_players_merge_when_numbering(edge):
    # 103 shares 101's name: its 590..550 interval falls inside 101's first stint
    # span and is numbered in the same name partition
    rows = [r for r in _intervals(edge).collect()
            if r.player_name == "Ann Lee" and r.game_id == 10 and r.period == 1]
    assert len(rows) == 5


def test_lineup_pivot(spark):
    m = frames(spark, lineup=PIVOT_LINEUP)
    wide = stints.lineup_wide(m["lineup"], m["player"])
    got = sorted((r.team_id, r.lineup_num, r.player1, r.player2, r.player3, r.player4, r.player5)
                 for r in wide.collect())
    assert got == [
        (1, 2, "Ann Lee", "Bob Ray", "Ann Lee", "Dee Fox", "Eve Gus"),
        (2, 2, "Bob Ray", "Ann Lee", None, "Dee Fox", "Eve Gus"),
        (2, 3, "Ann Lee", "Bob Ray", "Ann Lee", "Dee Fox", "Eve Gus"),
    ]
    con = duck_con(pandas_tables(lineup=PIVOT_LINEUP))
    check(con, "lineup_wide", wide)


def test_lineup_pivot_with_a_player_id_held_twice(spark):
    """Numbers come first: the id counts twice, keeps one slot and shows its greatest name."""
    from courtline.operators.pivot import pivot_fixed_groups
    rows = spark.createDataFrame([(1, m) for m in (1, 2, 3, 4)], "g int, m int")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "e")], "m int, name string")
    got = pivot_fixed_groups(rows, ["g"], "m", names, F.col("name"))
    assert [tuple(r) for r in got.collect()] == [(1, "a", "b", "c", "e", None)]


def test_lineup_pivot_deals_its_rows_by_their_number(spark, monkeypatch):
    """Twice the rows, twice the tasks; copies of a row, NULL keys and constant keys stay right."""
    from courtline.operators import pivot
    monkeypatch.setattr(pivot, "ROWS", 100, raising=False)
    names = spark.createDataFrame([(m, f"n{m}") for m in range(5)], "m int, name string")
    for groups in (200, 400):
        rows = (spark.range(groups * 5).selectExpr("nullif(id div 5, 7) AS g", "1 AS h", "CAST(id % 5 AS INT) AS m")
                .unionByName(spark.range(groups * 3).selectExpr("3L AS g", "1 AS h", "2 AS m")))
        got = pivot.pivot_fixed_groups(rows, ["g", "h"], "m", names, F.col("name"))
        assert got.rdd.getNumPartitions() == groups * 8 // 100
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == groups and set(rows) == {
            (None if g == 7 else g, 1, "n0", "n1", "n2", "n3", "n4") for g in range(groups)}
