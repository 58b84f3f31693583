"""Schedule queries on hand-made edge cases vs the plain-form SQL in DuckDB."""

import pytest

from courtline.oracle import COACH_TEAM
from courtline.plans import schedule
from duck_model import check, duck_con
from fixtures import frames, pandas_tables

QUERIES = {
    "team_standings": lambda m: schedule.team_standings(m["team"], m["game_schedule"]),
    "role_left_join": lambda m: schedule.team_games(m["team"], m["game_schedule"], "left"),
    "role_inner_join": lambda m: schedule.team_games(m["team"], m["game_schedule"], "inner"),
    "home_back_to_back": lambda m: schedule.back_to_back(m["team"], m["game_schedule"], "home"),
    "away_back_to_back": lambda m: schedule.back_to_back(m["team"], m["game_schedule"], "away"),
    "longest_rest": lambda m: schedule.longest_rest(m["team"], m["game_schedule"]),
    "three_in_four": lambda m: schedule.games_in_window(m["team"], m["game_schedule"]),
    "game_numbers": lambda m: schedule.game_numbers(m["team"], m["game_schedule"]),
    "game_results": lambda m: schedule.game_results(m["team"], m["game_schedule"]),
    "team_records": lambda m: schedule.team_records(m["team"], m["game_schedule"]),
    "schedule_difficulty": lambda m: schedule.schedule_difficulty(m["team"], m["game_schedule"]),
    "opponent_difficulty": lambda m: schedule.opponent_difficulty(m["team"], m["game_schedule"], COACH_TEAM),
}


@pytest.fixture(scope="module")
def model(spark):
    return frames(spark)


@pytest.fixture(scope="module")
def con():
    return duck_con(pandas_tables())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_plain_sql(spark, model, con, name):
    check(con, name, QUERIES[name](model))


def test_standings_edge_cases(model):
    rows = {r["teamid"]: r for r in schedule.team_standings(model["team"], model["game_schedule"]).collect()}
    # self-game counts twice in games played, one win and one loss; tie is neither
    t1 = rows[1]
    assert (t1.games_played, t1.home_games, t1.away_games) == (8, 5, 3)
    assert (t1.wins, t1.losses) == (3, 3)
    # team without games: zeros, NULL percentage, last rank
    t6 = rows[6]
    assert (t6.games_played, t6.wins, t6.losses, t6.win_percentage) == (0, 0, 0, None)
    assert t6.rank_games_played == 6
    # 15 games, one with an orphan away team: 2 * 15 - 1 team-games
    assert sum(r.games_played for r in rows.values()) == 29


def test_results_tie_and_null_are_losses(model):
    rows = [(r.game_id, r.team_id, r.result)
            for r in schedule.game_results(model["team"], model["game_schedule"]).collect()]
    res = {(g, t): v for g, t, v in rows if g != 5}
    assert res[(2, 2)] == res[(2, 1)] == "loss"
    assert res[(4, 3)] == res[(4, 1)] == "loss"
    assert sorted(v for g, _, v in rows if g == 5) == ["loss", "win"]  # self-game: two rows


def test_longest_rest_keeps_ties(model):
    got = sorted((r.team_id, r.rest_days) for r in
                 schedule.longest_rest(model["team"], model["game_schedule"]).collect())
    # team 3: 2024-01-03 -> 2024-01-20 is the single longest gap
    assert got == [(3, 17)]


def test_longest_rest_all_same_day_keeps_duplicates(spark):
    from courtline.sources import schemas
    from fixtures import TEAM, ts
    games = [(1, 1, 2, 1, 0, ts("2024-01-01 10:00:00")), (2, 1, 2, 1, 0, ts("2024-01-01 12:00:00")),
             (3, 1, 2, 1, 0, ts("2024-01-01 14:00:00"))]
    t = spark.createDataFrame(TEAM, schemas.TARGET["team"])
    g = spark.createDataFrame(games, schemas.TARGET["game_schedule"])
    got = sorted((r.team_id, r.rest_days) for r in schedule.longest_rest(t, g).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (2, 0)]
