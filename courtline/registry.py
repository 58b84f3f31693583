"""The registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Each function builds the schedule-model views over the driver tables of
``sf_dir`` and returns the lazy result of one operator or composite query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.operators import quality
from courtline.plans import schedule, serving, sql_functions, stints
from courtline.sources import ingest, json_records, schemas
from courtline.session import checkpointed, scratch_path
from courtline.sources.adapters import COACH_TEAM, Tables

QueryFn = Callable[[SparkSession, str], DataFrame]


def _tg(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return fn(t.team(), t.game_schedule())
    run.__doc__ = fn.__doc__
    return run


def _lu(fn):
    """Run ``fn(tables)`` on the lineup views (lineup, its games, teams, players)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


def _lineup_games(t: Tables) -> DataFrame:
    """The lineup games, computed once per query: an aggregate of the events
    table with one row per game (at most five per calendar day), read by the
    interval joins and again by the results; written once, events is scanned
    once for it and adaptive execution knows its size exactly."""
    return checkpointed(t.lineup_games())


def _intervals(t: Tables, games: DataFrame | None = None) -> DataFrame:
    games = _lineup_games(t) if games is None else games
    return stints.stint_intervals(t.lineup(), games, t.team(), t.player())


def _durations(t: Tables, games: DataFrame | None = None) -> DataFrame:
    return stints.stint_durations(_intervals(t, games))


def _summary(t: Tables) -> DataFrame:
    games = _lineup_games(t)
    return stints.win_loss_summary(_durations(t, games), t.team(), games)


def _json_place(spark: SparkSession) -> str:
    return scratch_path(spark, f"json-load/{uuid.uuid4().hex}")


def _source_shaped(rows: DataFrame, name: str) -> DataFrame:
    by_name = {c.lower(): c for c in rows.columns}
    return rows.select(*[F.col(by_name[f.lower()]).alias(f) for f in schemas.SOURCE[name].names])


def _json_round_trip(name: str, source: Callable[[Tables], DataFrame]) -> QueryFn:
    """The JSON load end to end: a source-shaped table written as JSON lines, then loaded by ``load_tables``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = _json_place(spark)
        _source_shaped(source(Tables(spark, sf_dir)), name).write.json(f"{place}/in/{schemas.FILES[name]}")
        frames, _ = ingest.load_tables(spark, f"{place}/in", f"{place}/out", tables=[name])
        return frames[name]
    return run


def _array_load(spark: SparkSession, sf_dir: str) -> str:
    """The games, some of them bad, as pretty-printed arrays, loaded with the bad ones set aside."""
    place = _json_place(spark)
    games = _source_shaped(Tables(spark, sf_dir).games_source_with_bad_rows(), "game_schedule")
    json_records.write_array(games, f"{place}/in/{schemas.FILES['game_schedule']}")
    ingest.load_tables(spark, f"{place}/in", f"{place}/out", tables=["game_schedule"], set_aside=True)
    return f"{place}/out"


def json_array_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows of the array load, read through the committed version."""
    return ingest.stored_rows(spark, _array_load(spark, sf_dir), "game_schedule")


def json_quarantine_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rows of the array load: the game and why it was set aside."""
    return ingest.quarantine(spark, _array_load(spark, sf_dir), "game_schedule").select(
        F.get_json_object("record", "$.game_id").cast("long").alias("game_id"), "reason")


LOADS = {"team": Tables.team_source, "team_affiliate": Tables.team_affiliate_source,
         "game_schedule": Tables.games_source_with_bad_rows, "player": Tables.player, "lineup": Tables.lineup,
         "roster": Tables.roster_source}


def json_load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a reload of six stored tables that finds the games only: the others keep their rows."""
    place, t = _json_place(spark), Tables(spark, sf_dir)
    for name, source in LOADS.items():
        _source_shaped(source(t), name).write.json(f"{place}/in/{schemas.FILES[name]}")
    ingest.load_tables(spark, f"{place}/in", f"{place}/out", set_aside=True)
    _source_shaped(t.game_schedule_source(), "game_schedule").write.json(
        f"{place}/again/{schemas.FILES['game_schedule']}")
    _, status = ingest.load_tables(spark, f"{place}/again", f"{place}/out", set_aside=True, skip_failed=True)
    return status.drop("error")


def sql_stint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One team's summary through the SQL table function, the team as a bound parameter."""
    sql_functions.register_summary(spark, _summary(Tables(spark, sf_dir)))
    return spark.sql("SELECT * FROM stint_summary(:team)", args={"team": COACH_TEAM})


def sql_stint_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All teams' chart points through the SQL table function without its parameter."""
    sql_functions.register_summary(spark, _summary(Tables(spark, sf_dir)))
    return spark.sql("SELECT * FROM stint_chart()")


def sql_coach_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coach's calendar through the SQL table function."""
    t = Tables(spark, sf_dir)
    sql_functions.register_calendar(spark, t.team(), t.game_schedule())
    return spark.sql("SELECT * FROM coach_calendar(:team)", args={"team": COACH_TEAM})


def queries() -> dict[str, QueryFn]:
    return {
        "team_standings": _tg(schedule.team_standings),
        "role_left_join": _tg(lambda t, g: schedule.team_games(t, g, "left")),
        "role_inner_join": _tg(lambda t, g: schedule.team_games(t, g, "inner")),
        "home_back_to_back": _tg(lambda t, g: schedule.back_to_back(t, g, "home")),
        "away_back_to_back": _tg(lambda t, g: schedule.back_to_back(t, g, "away")),
        "longest_rest": _tg(schedule.longest_rest),
        "three_in_four": _tg(schedule.games_in_window),
        "game_numbers": _tg(schedule.game_numbers),
        "game_results": _tg(schedule.game_results),
        "team_records": _tg(schedule.team_records),
        "schedule_difficulty": _tg(schedule.schedule_difficulty),
        "opponent_difficulty": _tg(lambda t, g: schedule.opponent_difficulty(t, g, COACH_TEAM)),
        "lineup_wide": _lu(lambda t: stints.lineup_wide(t.lineup5(), t.part_player())),
        "opponent_key_join": _lu(lambda t: stints.opponent_key_join(t.lineup(), _lineup_games(t), t.team())),
        "stint_intervals": _lu(lambda t: stints.stint_intervals_table(_intervals(t))),
        "stint_results": _lu(lambda t: stints.stint_results(_intervals(t))),
        "stint_durations": _lu(lambda t: stints.stint_durations_table(_durations(t))),
        "stint_averages": _lu(lambda t: stints.stint_averages(_durations(t))),
        "win_loss_summary": _lu(_summary),
        "team_list": _lu(lambda t: stints.team_list(_summary(t))),
        "sql_stint_summary": sql_stint_summary,
        "sql_stint_chart": sql_stint_chart,
        "sql_coach_calendar": sql_coach_calendar,
        "stint_summary_all": _lu(lambda t: stints.stint_summary(_summary(t))),
        "stint_summary_team": _lu(lambda t: stints.stint_summary(_summary(t), COACH_TEAM)),
        "scatter_points": _lu(lambda t: stints.scatter_points(_summary(t))),
        "typed_game_schedule": _lu(lambda t: ingest.conform(
            ingest.lower_names(t.game_schedule_source()), schemas.TARGET["game_schedule"])),
        "typed_team_affiliate": _lu(lambda t: ingest.conform(
            ingest.lower_names(t.team_affiliate_source()), schemas.TARGET["team_affiliate"])),
        "json_load_games": _json_round_trip("game_schedule", Tables.game_schedule_source),
        "json_load_affiliates": _json_round_trip("team_affiliate", Tables.team_affiliate_source),
        "json_load_team": _json_round_trip("team", Tables.team_source),
        "json_load_player": _json_round_trip("player", Tables.player),
        "json_load_lineup": _json_round_trip("lineup", Tables.lineup),
        "json_load_roster": _json_round_trip("roster", Tables.roster_source),
        "json_array_games": json_array_games,
        "json_quarantine_games": json_quarantine_games,
        "json_load_status": json_load_status,
        "standings_order": _tg(schedule.standings_order),
        "calendar_order": _tg(schedule.calendar_order),
        "affiliate_records": _lu(lambda t: serving.json_rows(ingest.conform(
            ingest.lower_names(t.team_affiliate_source()), schemas.TARGET["team_affiliate"]))),
        "key_violations": _lu(lambda t: quality.key_violations(
            t.raw("lineitem"), ["l_orderkey", "l_linenumber"])),
        "distinct_rows": _lu(lambda t: quality.distinct_rows(
            t.raw("lineitem"), ["l_orderkey", "l_partkey"])),
    }
