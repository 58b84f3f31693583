"""The serving queries as SQL table functions."""

import tempfile

import pytest

from courtline.oracle import COACH_TEAM
from courtline.plans import build, schedule, serving, sql_functions, stints
from fixtures import STINT_GAMES, STINT_LINEUP, frames


@pytest.fixture(scope="module")
def stored(spark):
    m = frames(spark, games=STINT_GAMES, lineup=STINT_LINEUP)
    summary = build.build_all(spark, m, tempfile.mkdtemp(prefix="courtline-sql-"))["final_summary"]
    sql_functions.register(spark, serving.stored_summary(spark, summary), m["team"], m["game_schedule"])
    return m, serving.stored_summary(spark, summary)


def rows(df):
    return sorted(map(repr, df.collect()))


def call(spark, function, name):
    return spark.sql(f"SELECT * FROM {function}(:team)", args={"team": name})


def test_summary_and_chart_equal_the_dataframe_form(spark, stored):
    _, summary = stored
    for name in (None, "", COACH_TEAM, "Bravo", "nobody"):
        assert rows(call(spark, "stint_summary", name)) == rows(stints.stint_summary(summary, name))
        assert rows(call(spark, "stint_chart", name)) == rows(stints.scatter_points(summary, name))
    assert rows(spark.sql("SELECT * FROM stint_summary()")) == rows(stints.stint_summary(summary))


def test_calendar_equals_the_dataframe_form(spark, stored):
    team, games = stored[0]["team"], stored[0]["game_schedule"]
    names = [r.teamname for r in team.select("teamname").distinct().collect()]
    found = 0
    for name in [*names, "nobody"]:
        want = rows(schedule.opponent_difficulty(team, games, name)) if name is not None else []
        found += len(want)
        assert rows(call(spark, "coach_calendar", name)) == want
    assert found


def test_ties_of_names_and_games_against_oneself(spark):
    from fixtures import frames as plain
    m = plain(spark)
    sql_functions.register_calendar(spark, m["team"], m["game_schedule"])
    for r in m["team"].select("teamname").distinct().collect():
        want = rows(schedule.opponent_difficulty(m["team"], m["game_schedule"], r.teamname)) if r.teamname else []
        assert rows(call(spark, "coach_calendar", r.teamname)) == want


def test_a_quote_in_a_name_is_harmless(spark, stored):
    for name in ("O'Neil", "x' OR '1'='1", "'; DROP VIEW stint_summary_rows; --", "\\' OR 1=1"):
        for function in ("stint_summary", "stint_chart", "coach_calendar"):
            assert call(spark, function, name).count() == 0
    assert spark.sql("SELECT * FROM stint_summary()").count() == 2


def test_the_team_filter_reaches_the_scan(spark, stored):
    sql_functions.register_summary(spark, stored[1])
    plan = call(spark, "stint_summary", COACH_TEAM)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(team,{COACH_TEAM})" in plan
    plan = spark.sql("SELECT * FROM stint_chart()")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" not in plan and "games_won" not in plan
