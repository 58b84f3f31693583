"""Source schemas of the six schedule-model tables.

Field names are given in their SOURCE case (JSON keys are case-sensitive for
Spark: a lower-case schema on ``teamId`` data reads all NULL).  ``TARGET``
gives the typed, lower-cased table each source conforms to.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


L, I, S, D = LongType(), IntegerType(), StringType(), DoubleType()

# As found in the JSON files.  Integral ids written with a fraction (e.g.
# ``1612709929.0``) are read as double and cast afterwards; timestamps arrive
# as text ``yyyy-MM-dd HH:mm:ss``.
SOURCE = {
    "team": _s(("teamId", L), ("leagueLk", S), ("teamName", S), ("teamNameShort", S),
               ("teamNickname", S)),
    "team_affiliate": _s(("nba_teamId", L), ("nba_abrv", S), ("glg_teamId", D), ("glg_abrv", S)),
    "game_schedule": _s(("game_id", L), ("home_id", L), ("home_score", I), ("away_id", L),
                        ("away_score", I), ("game_date", S)),
    "player": _s(("player_id", L), ("first_name", S), ("last_name", S)),
    "lineup": _s(("team_id", L), ("player_id", L), ("lineup_num", I), ("period", I),
                 ("time_in", I), ("time_out", I), ("game_id", L)),
    "roster": _s(("team_id", L), ("player_id", L), ("first_name", S), ("last_name", S),
                 ("position", S), ("contract_type", S)),
}

# Typed tables after lower-casing and conversion, in table column order.
TARGET = {
    "team": _s(("teamid", L), ("teamname", S), ("teamnameshort", S), ("teamnickname", S),
               ("leaguelk", S)),
    "team_affiliate": _s(("nba_teamid", L), ("nba_abrv", S), ("glg_teamid", L), ("glg_abrv", S)),
    "game_schedule": _s(("game_id", L), ("home_id", L), ("away_id", L), ("home_score", I),
                        ("away_score", I), ("game_date", TimestampNTZType())),
    "player": _s(("player_id", L), ("first_name", S), ("last_name", S)),
    "lineup": _s(("team_id", L), ("player_id", L), ("lineup_num", I), ("period", I),
                 ("time_in", I), ("time_out", I), ("game_id", L)),
    "roster": _s(("team_id", L), ("player_id", L), ("first_name", S), ("last_name", S),
                 ("position", S), ("contract_type", S)),
}

# Primary keys of the typed tables.
KEYS = {
    "team": ["teamid"],
    "team_affiliate": ["nba_teamid"],
    "game_schedule": ["game_id"],
    "player": ["player_id"],
    "lineup": ["team_id", "player_id", "lineup_num", "game_id"],
    "roster": ["team_id", "player_id"],
}

# File name of each table's source, in load order.
FILES = {
    "team": "team.json",
    "team_affiliate": "team_affiliate.json",
    "game_schedule": "game_schedule.json",
    "player": "player.json",
    "lineup": "lineup.json",
    "roster": "roster.json",
}

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
