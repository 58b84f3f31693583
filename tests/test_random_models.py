"""Randomised model tables: every query equals the plain-form SQL in DuckDB.

Generated with fixed seeds.  Cases the original leaves undefined (rows whose
window order ties) are excluded by construction: a player always plays for one
team, and (player name, game, period, time_in, time_out) is unique.
"""

import datetime as dt
import random

import pytest

from courtline.oracle import COACH_TEAM
from courtline.plans import schedule, stints
from courtline.sources import schemas
from duck_model import check, duck_con

TEAMS = [
    (1, COACH_TEAM, "T1", "Ones", "NBA"),
    (2, "Twos", "T2", "Twos", "NBA"),
    (3, "Threes", "T3", "Ones", "NBA"),     # shares a nickname
    (4, "Fours", "T4", "Fours", "GLG"),
    (5, "Fives", "T5", "Fives", "GLG"),
    (6, "Twos", "T6", "Sixes", "GLG"),      # shares a full name with team 2
    (7, "Sevens", "T7", "Sevens", "GLG"),
]
PLAYERS = [(100 + i, f"P{i % 9}", None if i == 5 else f"L{i % 4}") for i in range(1, 15)]


def make(seed, hot=False):
    """Random model tables; ``hot`` puts team 1 in about a third of the games,
    player 101 in about a third of the lineup rows, and copies everywhere."""
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    games = []
    for gid in range(1, 45):
        home = 1 if hot and rnd.random() < 1 / 3 else rnd.choice([1, 2, 3, 4, 5, 6, 7, 8])  # 8: no team
        away = home if rnd.random() < 0.05 else rnd.choice([1, 2, 3, 4, 5, 6, 7])
        hs = None if rnd.random() < 0.05 else rnd.randint(95, 100)
        as_ = rnd.randint(95, 100)
        when = None if rnd.random() < 0.04 else base + dt.timedelta(days=rnd.randrange(25), hours=rnd.choice([12, 19]))
        games.append((gid, home, away, hs, as_, when))
    player_team = {p[0]: rnd.choice([1, 2, 3, 4, 5, 6, 7]) for p in PLAYERS}
    player_team[999] = 2                                      # unknown player id
    name_of = {p[0]: (None if p[2] is None else f"{p[1]} {p[2]}") for p in PLAYERS}
    lineup, seen, seen_key = [], set(), set()
    for n in range(260):
        gid = rnd.randrange(1, 45)
        pid = 101 if hot and rnd.random() < 1 / 3 else rnd.choice(list(player_team))
        team = player_team[pid]
        period = None if rnd.random() < 0.02 else rnd.randint(1, 4)
        tin = None if rnd.random() < 0.03 else rnd.randrange(0, 721, 30)
        tout = None if tin is None or rnd.random() < 0.03 else max(0, tin - rnd.randrange(0, 301, 30))
        key = (name_of.get(pid, f"u{pid}"), gid, period, tin, tout)
        if key in seen_key and (pid, gid, period, tin, tout) not in seen:
            continue
        seen_key.add(key)
        seen.add((pid, gid, period, tin, tout))
        lineup.append((team, pid, n, period, tin, tout, gid))
        if rnd.random() < (0.3 if hot else 0.05):           # an exact copy under another number
            lineup.append((team, pid, n + 1000, period, tin, tout, gid))
    return games, lineup


SCHEDULE = {
    "team_standings": lambda m: schedule.team_standings(m["team"], m["game_schedule"]),
    "role_left_join": lambda m: schedule.team_games(m["team"], m["game_schedule"], "left"),
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


def _dur(m):
    return stints.stint_durations(stints.stint_intervals(m["lineup"], m["game_schedule"], m["team"], m["player"]))


STINTS = {
    "opponent_key_join": lambda m: stints.opponent_key_join(m["lineup"], m["game_schedule"], m["team"]),
    "stint_intervals": lambda m: stints.stint_intervals_table(
        stints.stint_intervals(m["lineup"], m["game_schedule"], m["team"], m["player"])),
    "stint_results": lambda m: stints.stint_results(
        stints.stint_intervals(m["lineup"], m["game_schedule"], m["team"], m["player"])),
    "stint_durations": lambda m: stints.stint_durations_table(_dur(m)),
    "stint_averages": lambda m: stints.stint_averages(_dur(m)),
    "win_loss_summary": lambda m: stints.win_loss_summary(_dur(m), m["team"], m["game_schedule"]),
    "lineup_wide": lambda m: stints.lineup_wide(m["lineup"], m["player"]),
}


@pytest.fixture(scope="module", params=[(11, False), (29, False), (47, True)])
def world(request, spark):
    import pandas as pd
    games, lineup = make(*request.param)
    T = schemas.TARGET
    m = {"team": spark.createDataFrame(TEAMS, T["team"]),
         "game_schedule": spark.createDataFrame(games, T["game_schedule"]),
         "player": spark.createDataFrame(PLAYERS, T["player"]),
         "lineup": spark.createDataFrame(lineup, T["lineup"])}
    def pdf(rows, schema):
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields], dtype=object)
    con = duck_con({"team": pdf(TEAMS, T["team"]), "game_schedule": pdf(games, T["game_schedule"]),
                    "lineup_games": pdf(games, T["game_schedule"]), "player": pdf(PLAYERS, T["player"]),
                    "part_player": pdf(PLAYERS, T["player"]), "lineup": pdf(lineup, T["lineup"]),
                    "lineup5": pdf(lineup, T["lineup"])})
    return m, con


@pytest.mark.parametrize("name", sorted(SCHEDULE) + sorted(STINTS))
def test_random_model_matches_plain_sql(world, name):
    m, con = world
    fn = SCHEDULE.get(name) or STINTS[name]
    check(con, name, fn(m))
