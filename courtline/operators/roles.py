"""Role explode: one game row becomes one row per participating team.

The original queries join teams to games with ``teamid = home_id OR teamid =
away_id`` (a disjunctive join that Spark can only run as a nested loop) or
union a home scan with an away scan.  Both are expressed here as a single scan
with ``explode``, which turns the OR join into an equi-join on ``teamid`` and
reads the games once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_teams(games: DataFrame, out: str = "teamid",
                  home: str = "home_id", away: str = "away_id") -> DataFrame:
    """One row per (game, distinct participating team): the OR-join form.

    A game whose home and away ids are equal yields ONE row, exactly as the
    OR predicate matches a team once.  NULL ids yield rows with a NULL key,
    which no equi-join matches.
    """
    return games.withColumn(out, F.explode(F.array_distinct(F.array(F.col(home), F.col(away)))))


def explode_roles(games: DataFrame, role_cols: dict[str, tuple[str, str]],
                  keep: list[str], role_name: str | None = None) -> DataFrame:
    """UNION ALL of the home role and the away role, in one scan.

    ``role_cols`` maps an output column to its (home expression, away
    expression) pair of column names, e.g. ``{"team_id": ("home_id",
    "away_id"), "own": ("home_score", "away_score")}``.  Every game yields two
    rows, also when home equals away (UNION ALL keeps both).  ``keep`` columns
    are carried unchanged.  ``role_name`` adds a 'home'/'away' label column.
    """
    def side(label: str, idx: int):
        fields = [F.col(pair[idx]).alias(name) for name, pair in role_cols.items()]
        if role_name:
            fields.append(F.lit(label).alias(role_name))
        return F.struct(*fields)

    exploded = games.select(*[F.col(c) for c in keep],
                            F.explode(F.array(side("home", 0), side("away", 1))).alias("__role"))
    names = list(role_cols) + ([role_name] if role_name else [])
    return exploded.select(*keep, *[F.col(f"__role.{n}").alias(n) for n in names])
