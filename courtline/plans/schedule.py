"""Schedule queries: standings, density, game results, records and difficulty.

Inputs are DataFrames in the schedule model:
  team(teamid, teamname, teamnickname)
  game_schedule(game_id, home_id, away_id, home_score, away_score, game_date)
Nothing is collected.  ``team_standings`` and ``longest_rest`` checkpoint one
small intermediate when called, ``game_numbers`` and the ``*_order`` queries the
sorted rows; all other results are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.functions.scalars import (
    COACH_LEVELS, SCOUT_LEVELS, colour_bucket, event_title, iso_timestamp, round_ratio)
from courtline.operators import density
from courtline.operators.joins import join_role
from courtline.operators.ranking import global_ranks, numbered, top_k
from courtline.operators.roles import explode_roles, explode_teams
from courtline.session import checkpointed


# ---------------------------------------------------------------------------
# Team x game joins on "teamid = home_id OR teamid = away_id"
# ---------------------------------------------------------------------------

def team_games(team: DataFrame, games: DataFrame, how: str = "inner",
               cols: tuple[str, ...] = ("game_id", "home_id", "away_id", "game_date")) -> DataFrame:
    """The OR join of teams and games as an equi-join on the exploded role.

    ``how='left'`` keeps teams without games (game columns NULL).  It is built
    as the inner join plus the
    teams that no game names, found by an anti-join against the distinct team
    ids of the games (partially aggregated, so a hot team collapses map-side).
    """
    g = explode_teams(games.select(*cols))
    t = team.select("teamid", "teamname")
    matched = g.join(t, "teamid", "inner").select("teamid", "teamname", *cols)
    if how != "left":
        return matched
    played = g.select("teamid").where(F.col("teamid").isNotNull()).distinct()
    idle = t.join(played, "teamid", "left_anti")
    nulls = [F.lit(None).cast(games.schema[c].dataType).alias(c) for c in cols]
    return matched.unionByName(idle.select("teamid", "teamname", *nulls))


# ---------------------------------------------------------------------------
# Q-1 standings
# ---------------------------------------------------------------------------

def team_standings(team: DataFrame, games: DataFrame) -> DataFrame:
    """Games played, wins, losses, win percentage, home/away games and ranks.

    Games are aggregated per team before the teams are joined, so the join sees
    one row per team; ties count as neither win nor loss.  A self-game counts
    as one home and one away game.  Teams without games have zeros, a NULL
    percentage and the rank after all teams with games.
    """
    g = explode_teams(games.select("home_id", "away_id", "home_score", "away_score"))
    is_home = F.col("home_id") == F.col("teamid")
    is_away = F.col("away_id") == F.col("teamid")
    hs, aws = F.col("home_score"), F.col("away_score")
    per_team = g.groupBy("teamid").agg(
        F.count(F.when(is_home, 1)).alias("home_games"),
        F.count(F.when(is_away, 1)).alias("away_games"),
        F.sum(F.when(is_home & (hs > aws), 1).when(is_away & (aws > hs), 1).otherwise(0)).alias("wins"),
        F.sum(F.when(is_home & (hs < aws), 1).when(is_away & (aws < hs), 1).otherwise(0)).alias("losses"),
    )
    zero = F.lit(0).cast("long")
    stats = (team.select("teamid", "teamname")
                 .join(per_team, "teamid", "left")
                 .select("teamid", "teamname",
                         (F.coalesce("home_games", zero) + F.coalesce("away_games", zero)).alias("games_played"),
                         F.coalesce(F.col("wins").cast("long"), zero).alias("wins"),
                         F.coalesce(F.col("losses").cast("long"), zero).alias("losses"),
                         F.coalesce("home_games", zero).alias("home_games"),
                         F.coalesce("away_games", zero).alias("away_games")))
    # one row per team, read by the output and by the three rank tables
    stats = checkpointed(stats)
    ranked = global_ranks(stats, [("games_played", "rank_games_played"),
                                  ("home_games", "rank_home_games"),
                                  ("away_games", "rank_away_games")])
    return ranked.select(
        "teamid", "teamname", "games_played", "rank_games_played", "wins", "losses",
        F.when(F.col("games_played") > 0, round_ratio("wins", "games_played")).alias("win_percentage"),
        "home_games", "rank_home_games", "away_games", "rank_away_games")


def _standings_order() -> list:
    return [F.desc_nulls_last("win_percentage"), F.asc("teamid")]


def standings_report(standings: DataFrame) -> DataFrame:
    """Standings in display order: best percentage first, no-game teams last."""
    return standings.orderBy(*_standings_order())


def standings_order(team: DataFrame, games: DataFrame) -> DataFrame:
    """Every team's place in the display order of the standings."""
    placed = numbered(team_standings(team, games), _standings_order())
    return placed.select("position", "teamid", "win_percentage")


# ---------------------------------------------------------------------------
# Q-2 / Q-3 back-to-backs, Q-4 longest rest, Q-5 n games in m days
# ---------------------------------------------------------------------------

def back_to_back(team: DataFrame, games: DataFrame, role: str = "home", k: int = 20) -> DataFrame:
    """Top ``k`` teams by games in ``role`` followed by a ``role`` game the next day.

    Only games of the one role are considered.  Ties at the cut are broken by
    team id (the original leaves them open).
    """
    key = f"{role}_team"
    out = f"{role}_b2b_count"
    dated = density.dates_per_key(games.select(F.col(f"{role}_id").alias(key), "game_date"),
                                  key, "game_date")
    counts = density.consecutive_day_count(dated, key, out)
    named = counts.join(team.select(F.col("teamid").alias(key), "teamname"), key)
    return top_k(named.select(key, "teamname", out), k, [F.desc(out), F.asc(key)])


def longest_rest(team: DataFrame, games: DataFrame) -> DataFrame:
    """Every (team, game, next game) pair whose day gap is the largest of all.

    The gap is taken over all games of every team (home or away); ties are
    all kept.  The maximum is a scalar subquery, so the filter is distributed.
    """
    t = team.select(F.col("teamid").alias("team_id"), "teamname")
    rows = explode_teams(games.select("home_id", "away_id", "game_date"), out="team_id")
    dated = density.dates_per_key(rows, "team_id", "game_date").join(t.select("team_id"), "team_id")
    # each team's longest rests only, read by the maximum and by the filter
    cand = checkpointed(density.longest_rests(density.rest_candidates(dated, "team_id"), "team_id"))
    longest = cand.select(F.max("rest_days")).scalar()
    best = density.expand_copies(cand.where(F.col("rest_days") == longest))
    return (best.join(t, "team_id")
                .select("team_id", "teamname", "rest_days", "last_game_date", "next_game_date"))


def games_in_window(team: DataFrame, games: DataFrame, n_games: int = 3, days: int = 4,
                    out: str = "num_3_in_4s") -> DataFrame:
    """Per team, the runs of ``n_games`` consecutive games within fewer than ``days`` days.

    Runs may overlap; teams without any run are absent.
    """
    rows = explode_teams(games.select("home_id", "away_id", "game_date"), out="team_id")
    dated = density.dates_per_key(rows, "team_id", "game_date")
    counts = density.stretch_count(dated, "team_id", n_games, days, out)
    t = team.select(F.col("teamid").alias("team_id"), "teamname")
    return (counts.join(t, "team_id").select("team_id", "teamname", out)
                  .orderBy(F.desc(out), F.asc("team_id")))


def game_numbers(team: DataFrame, games: DataFrame) -> DataFrame:
    """Each team's games numbered 1..N by date, then game id."""
    rows = explode_teams(games.select("game_id", "home_id", "away_id", "game_date"), out="team_id")
    t = team.select(F.col("teamid").alias("team_id"), "teamname")
    rows = rows.join(t.select("team_id"), "team_id")
    numbered = density.number_within_key(rows, "team_id", "game_date", "game_id", "game_num")
    return (numbered.join(t, "team_id")
                    .select("team_id", "teamname", "game_id",
                            F.to_date("game_date").alias("game_date"), "game_num"))


# ---------------------------------------------------------------------------
# Q-11 game results, Q-16 records
# ---------------------------------------------------------------------------

def _role_scores(games: DataFrame, keep: list[str]) -> DataFrame:
    return explode_roles(
        games,
        {"team_id": ("home_id", "away_id"), "own": ("home_score", "away_score"),
         "other": ("away_score", "home_score")},
        keep=keep)


def game_results(team: DataFrame, games: DataFrame) -> DataFrame:
    """Each team's result of each game: 'win' if it scored more, else 'loss'.

    A tie or a missing score is a 'loss' for both teams here, unlike in the
    standings and records.  A self-game gives two rows.
    """
    roles = _role_scores(games.select("game_id", "game_date", "home_id", "away_id",
                                      "home_score", "away_score"), ["game_id", "game_date"])
    t = team.select(F.col("teamid").alias("team_id"), F.col("teamname").alias("team"))
    return (roles.join(t, "team_id")
                 .select("game_id", "game_date", "team_id", "team",
                         F.when(F.col("own") > F.col("other"), "win").otherwise("loss").alias("result")))


def record_totals(games: DataFrame) -> DataFrame:
    """(team_id, total_wins, total_losses) over home and away games; ties count as neither."""
    roles = _role_scores(games.select("home_id", "away_id", "home_score", "away_score"), [])
    return roles.groupBy("team_id").agg(
        F.sum(F.when(F.col("own") > F.col("other"), 1).otherwise(0)).cast("long").alias("total_wins"),
        F.sum(F.when(F.col("own") < F.col("other"), 1).otherwise(0)).cast("long").alias("total_losses"))


def team_records(team: DataFrame, games: DataFrame, name_col: str = "teamnickname",
                 alias: str = "team_nickname") -> DataFrame:
    """Win/loss totals per team with one of its names (nickname or full name)."""
    t = team.select(F.col("teamid").alias("team_id"), F.col(name_col).alias(alias))
    return record_totals(games).join(t, "team_id").select("team_id", alias, "total_wins", "total_losses")


# ---------------------------------------------------------------------------
# Q-17 / Q-18 schedule difficulty as calendar event records
# ---------------------------------------------------------------------------

def _records_dim(team: DataFrame, games: DataFrame) -> DataFrame:
    """One row per team with games: both names and the record totals."""
    t = team.select(F.col("teamid").alias("team_id"), "teamname", "teamnickname")
    return record_totals(games).join(t, "team_id")


def _with_roles(games: DataFrame, recs: DataFrame) -> DataFrame:
    g = games.select("game_id", "game_date", "home_id", "away_id")
    g = join_role(g, recs, "home_id", "team_id",
                  {"teamname": "home_name", "teamnickname": "home_team",
                   "total_wins": "home_wins", "total_losses": "home_losses"})
    return join_role(g, recs, "away_id", "team_id",
                     {"teamname": "away_name", "teamnickname": "away_team",
                      "total_wins": "away_wins", "total_losses": "away_losses"})


def event_records(df: DataFrame, diff_col: str, levels, *keep: str) -> DataFrame:
    """Calendar events: title, start, allDay, difficulty, teams, game id, colour; before them the columns ``keep``."""
    return df.select(
        *keep,
        event_title("home_team", "away_team", diff_col).alias("title"),
        iso_timestamp("game_date").alias("start"),
        F.lit(True).alias("allDay"),
        F.col(diff_col).alias("difficulty"),
        "home_team", "away_team", "game_id",
        colour_bucket(diff_col, levels).alias("color"))


def schedule_difficulty(team: DataFrame, games: DataFrame) -> DataFrame:
    """Scout view: every game with (home + away wins) - (home + away losses)."""
    g = _with_roles(games, _records_dim(team, games))
    diff = ((F.col("home_wins") + F.col("away_wins")) - (F.col("home_losses") + F.col("away_losses")))
    return event_records(g.withColumn("total_game_difficulty", diff),
                         "total_game_difficulty", SCOUT_LEVELS)


def opponent_difficulty(team: DataFrame, games: DataFrame, team_name: str) -> DataFrame:
    """Coach view: the games of ``team_name`` with the opponent's wins - losses.

    Records are computed over all games; only the listed games are filtered.
    """
    name = F.lit(team_name)
    # the ids of that name, evaluated once: only their games meet the records
    ids = team.where(F.col("teamname") == name).select(F.collect_set("teamid")).scalar()
    mine = games.where(F.array_contains(ids, F.col("home_id")) | F.array_contains(ids, F.col("away_id")))
    g = _with_roles(mine, _records_dim(team, games))
    g = g.where(name.isin(F.col("home_name"), F.col("away_name")))
    diff = F.when(F.col("home_name") == name, F.col("away_wins") - F.col("away_losses")) \
            .otherwise(F.col("home_wins") - F.col("home_losses"))
    return event_records(g.withColumn("opponent_difficulty", diff), "opponent_difficulty", COACH_LEVELS)


def team_calendars(team: DataFrame, games: DataFrame) -> DataFrame:
    """The coach view of every team at once: ``team_name``, then that team's events.

    ``home_name`` and ``away_name`` stay, so a filter on both teams' names meets the games before they are
    dealt to their teams.  A game between equal names is one event of that name, seen from the home side.
    """
    g = _with_roles(games, _records_dim(team, games))
    sides = F.array_distinct(F.array("home_name", "away_name"))
    g = g.select("*", F.explode(sides).alias("team_name")).where(F.col("team_name").isNotNull())
    diff = F.when(F.col("home_name") == F.col("team_name"), F.col("away_wins") - F.col("away_losses")) \
            .otherwise(F.col("home_wins") - F.col("home_losses"))
    return event_records(g.withColumn("opponent_difficulty", diff), "opponent_difficulty", COACH_LEVELS,
                         "team_name", "home_name", "away_name")


def calendar(events: DataFrame) -> DataFrame:
    """Events in date order, as served to the calendar."""
    return events.orderBy(*_calendar_order())


def _calendar_order() -> list:
    return [F.asc_nulls_last("start"), F.asc_nulls_last("game_id")]


def calendar_order(team: DataFrame, games: DataFrame) -> DataFrame:
    """Every event's place in the scout's calendar."""
    return numbered(schedule_difficulty(team, games), _calendar_order()).select("position", "game_id", "start")
