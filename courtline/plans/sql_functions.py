"""The serving queries as SQL table functions with bound parameters.

``register`` makes two temporary table functions of a session over its tables:

* ``stint_summary([team])`` and ``stint_chart([team])``: the summary rows and chart points, of all teams if
  the team is left out, NULL or empty;
* ``coach_calendar(team)``: the calendar of the team of that full name; no rows for NULL or an unknown name.

Call them with ``spark.sql("SELECT * FROM stint_summary(:team)", args={"team": name})``.  The parameter is a
value, never a piece of the statement, so quotes in it are harmless.  It is put into the function's body when the
statement is analysed: the team filter reaches the scan of a stored summary as in the DataFrame form.  Rows come
unordered; the caller states the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtline.plans import schedule, stints

_ALL_OR_ONE = "coalesce(asked_team, '') = '' OR team = asked_team"
_ONE = "team_name = asked_team AND asked_team IN (home_name, away_name)"


def _function(spark: SparkSession, name: str, parameter: str, rows: DataFrame, columns: list[str], where: str) -> None:
    view = f"{name}_rows"
    rows.createOrReplaceTempView(view)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    names = ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter}) RETURNS TABLE({kinds}) "
              f"RETURN SELECT {names} FROM {view} WHERE {where}")


def register_summary(spark: SparkSession, summary: DataFrame) -> None:
    """``stint_summary`` and ``stint_chart`` over a summary, stored or not."""
    optional = "asked_team STRING DEFAULT NULL"
    _function(spark, "stint_summary", optional, summary, stints.SUMMARY_COLS, _ALL_OR_ONE)
    points = stints.chart_columns(summary)
    _function(spark, "stint_chart", optional, points, points.columns, _ALL_OR_ONE)


def register_calendar(spark: SparkSession, team: DataFrame, games: DataFrame) -> None:
    """``coach_calendar`` over the teams and games."""
    rows = schedule.team_calendars(team, games)
    events = [c for c in rows.columns if c not in ("team_name", "home_name", "away_name")]
    _function(spark, "coach_calendar", "asked_team STRING", rows, events, _ONE)


def register(spark: SparkSession, summary: DataFrame, team: DataFrame, games: DataFrame) -> None:
    register_summary(spark, summary)
    register_calendar(spark, team, games)
