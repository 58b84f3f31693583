"""Hand-made model tables with the edge cases the driver data lacks."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from courtline.oracle import COACH_TEAM
from courtline.sources import schemas


def ts(s):
    return None if s is None else dt.datetime.fromisoformat(s)


TEAM = [
    # teamid, teamname, teamnameshort, teamnickname, leaguelk
    (1, COACH_TEAM, "AAA", "Hawks", "NBA"),
    (2, "Bravo", "BBB", "Hawks", "NBA"),      # nickname shared with team 1
    (3, "Charlie", "CCC", "Cats", "NBA"),
    (4, "Delta", "DDD", "Dogs", "GLG"),
    (5, "Echo", "EEE", "Eels", "GLG"),
    (6, "Foxtrot", "FFF", "Foxes", "GLG"),    # no games at all
]

GAMES = [
    # game_id, home_id, away_id, home_score, away_score, game_date
    (1, 1, 2, 100, 90, ts("2024-01-01 19:00:00")),
    (2, 2, 1, 95, 95, ts("2024-01-02 19:00:00")),     # tie
    (3, 1, 3, 100, 101, ts("2024-01-03 19:00:00")),
    (4, 3, 1, None, 90, ts("2024-01-03 21:00:00")),   # NULL score, same day for 1 and 3
    (5, 1, 1, 100, 90, ts("2024-01-05 12:00:00")),    # self-game
    (6, 4, 2, 80, 85, ts("2024-01-10 19:00:00")),
    (7, 2, 4, 88, 70, ts("2024-01-11 19:00:00")),
    (8, 4, 99, 90, 80, ts("2024-01-12 19:00:00")),    # orphan away team
    (9, 5, 3, 100, 99, ts("2024-01-20 19:00:00")),
    (10, 3, 5, 70, 100, None),                         # NULL date
    (11, 1, 4, 101, 100, ts("2024-01-06 18:00:00")),
    (12, 1, 5, 90, 91, ts("2024-01-06 20:30:15.250000")),  # second game that day, fraction
    (13, 5, 2, 99, 98, ts("2024-01-16 19:00:00")),
    (14, 2, 5, 97, 96, ts("2024-01-23 19:00:00")),     # 7-day rest for team 5 ...
    (15, 3, 4, 90, 80, ts("2024-01-27 19:00:00")),     # ... and 7 for team 3 and 4 (ties at top)
]

PLAYER = [
    (101, "Ann", "Lee"),
    (102, "Bob", "Ray"),
    (103, "Ann", "Lee"),      # same name as 101
    (104, "Cid", None),       # NULL last name
    (105, "Dee", "Fox"),
    (106, "Eve", "Gus"),
    (107, "Flo", "Hal"),
]

STINT_GAMES = [
    (10, 1, 2, 100, 90, ts("2024-01-01 19:00:00")),
    (11, 2, 1, 95, 95, ts("2024-01-03 19:00:00")),
]

# team_id, player_id, lineup_num, period, time_in, time_out, game_id
STINT_LINEUP = [
    (1, 101, 1, 1, 720, 600, 10),
    (1, 101, 2, 1, 600, 480, 10),
    (1, 101, 3, 1, 300, 120, 10),
    (1, 101, 4, 2, 720, 0, 10),
    (2, 102, 1, 1, 720, 400, 10),
    (2, 102, 2, 1, 500, 300, 10),
    (1, 101, 1, 1, 720, 0, 11),
]

EDGE_LINEUP = STINT_LINEUP + [
    (1, 101, 5, 1, 720, 600, 10),   # duplicate interval under another lineup number
    (1, 103, 1, 1, 590, 550, 10),   # same-named player, separate id
    (1, 103, 2, 1, 400, 350, 10),
    (1, 104, 1, 1, 700, 650, 10),   # NULL name
    (2, 999, 1, 1, 700, 650, 10),   # unknown player
    (1, 105, 1, 2, 4000, 3599, 10),  # clock past an hour
    (2, 106, 1, 1, 100, 100, 11),
    (2, 106, 2, 1, 100, 50, 11),    # touches: same stint
]

# Groups for the pivot: sizes 4, 5, 6, one with an unknown player, one with a NULL name.
PIVOT_LINEUP = (
    [(1, p, 1, 1, 720, 600, 50) for p in (101, 102, 103, 105)]                 # 4 players
    + [(1, p, 2, 1, 600, 500, 50) for p in (101, 102, 103, 105, 106)]          # 5 players
    + [(1, p, 3, 1, 500, 400, 50) for p in (101, 102, 103, 105, 106, 107)]     # 6 players
    + [(2, p, 1, 1, 720, 600, 50) for p in (101, 102, 103, 105, 999)]          # unknown player
    + [(2, p, 2, 1, 600, 500, 50) for p in (102, 103, 104, 105, 106)]          # NULL name
    + [(2, p, 3, 1, 500, 400, 50) for p in (101, 999, 102, 103, 105, 106)]     # 6 with 1 unknown
    + [(2, 102, 2, 1, 600, 500, 50)]                                           # duplicate row
)


def frames(spark, games=GAMES, lineup=STINT_LINEUP):
    T = schemas.TARGET
    return {
        "team": spark.createDataFrame(TEAM, T["team"]),
        "game_schedule": spark.createDataFrame(games, T["game_schedule"]),
        "player": spark.createDataFrame(PLAYER, T["player"]),
        "lineup": spark.createDataFrame(lineup, T["lineup"]),
    }


def pandas_tables(games=GAMES, lineup=STINT_LINEUP, lineup_games=None):
    T = schemas.TARGET
    def pdf(rows, schema):
        df = pd.DataFrame(rows, columns=[f.name for f in schema.fields], dtype=object)
        return df
    g = pdf(games, T["game_schedule"])
    lg = pdf(lineup_games if lineup_games is not None else games, T["game_schedule"])
    lu = pdf(lineup, T["lineup"])
    pl = pdf(PLAYER, T["player"])
    return {
        "team": pdf(TEAM, T["team"]),
        "game_schedule": g,
        "player": pl,
        "lineup": lu,
        "lineup_games": lg,
        "lineup5": lu,
        "part_player": pl,
    }
