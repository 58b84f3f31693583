"""Views of the driver's TPC-H-like tables in the shape of the schedule model.

The schedule model has six relations (team, game_schedule, player, lineup,
roster, team_affiliate).  The test and benchmark data are TPC-H-like tables, so
each model relation is defined here as a projection of one of them:

  team           supplier   teamid = s_suppkey, name = s_name, nickname by nation (shared)
  game_schedule  orders     ids taken modulo the number of teams
  player         customer   first_name = c_name, last_name = c_mktsegment
  lineup         events     one on-court interval per event
  lineup games   events     the games the event lineups belong to
  lineup5        lineitem   five-player groups for the pivot (players = parts)

Every view is a lazy projection: Catalyst prunes the scan to the columns a
query uses and pushes filters into the Parquet reader.  ``ADAPTER_SQL`` holds
the same definitions as DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


LINEUP_EPOCH = "2024-01-01"  # day 0 of the lineup game numbering
COACH_TEAM = "Supplier#000000003"  # the team of the registered coach and one-team queries


class Tables:
    """Lazy access to the driver tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One read per ``Tables``: its views share a listing, a later ``Tables`` lists anew."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # -- teams ---------------------------------------------------------------
    def team_count(self) -> Column:
        """Number of teams as a scalar subquery (evaluated once, not joined)."""
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    def team(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS teamid", "s_name AS teamname",
            "concat('Club ', CAST(s_nationkey AS STRING)) AS teamnickname")

    # -- games ---------------------------------------------------------------
    def game_schedule(self) -> DataFrame:
        n = self.team_count()
        return self.raw("orders").select(
            F.col("o_orderkey").alias("game_id"),
            F.pmod(F.col("o_custkey"), n).alias("home_id"),
            F.pmod(F.col("o_orderkey"), n).alias("away_id"),
            F.expr("CAST(pmod(floor(o_totalprice), 60) + 80 AS INT) AS home_score"),
            F.expr("CAST(pmod(floor(o_totalprice / 60), 60) + 80 AS INT) AS away_score"),
            F.col("o_orderdate").alias("game_date"),
        )

    # -- players -------------------------------------------------------------
    def player(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS player_id", "c_name AS first_name", "c_mktsegment AS last_name")

    # -- lineups (intervals on court) ------------------------------------------
    def _lineup_events(self) -> DataFrame:
        time_in = "(43200 - (pmod(hour(ts), 12) * 3600 + minute(ts) * 60 + second(ts)))"
        return self.raw("events").selectExpr(
            "2 * pmod(user_id, 5) + pmod(user_id div 5, 2) AS team_id",
            "user_id AS player_id",
            "event_id AS lineup_num",
            "CAST(1 + hour(ts) div 12 AS INT) AS period",
            f"CAST({time_in} AS INT) AS time_in",
            f"CAST(greatest(0, {time_in} - floor(value * 120)) AS INT) AS time_out",
            f"5 * CAST(datediff(to_date(ts), DATE'{LINEUP_EPOCH}') AS BIGINT) + pmod(user_id, 5) AS game_id",
            "CAST(to_date(ts) AS TIMESTAMP_NTZ) AS _day",
        )

    def lineup(self) -> DataFrame:
        return self._lineup_events().drop("_day")

    def lineup_games(self) -> DataFrame:
        """One game per lineup game id: home is the even team of the pair."""
        return (self._lineup_events()
                .groupBy("game_id")
                .agg(F.expr("CAST(count_if(team_id = 2 * pmod(game_id, 5)) AS INT) AS home_score"),
                     F.expr("CAST(count_if(team_id = 2 * pmod(game_id, 5) + 1) AS INT) AS away_score"),
                     F.min("_day").alias("game_date"))
                .selectExpr("game_id", "2 * pmod(game_id, 5) AS home_id",
                            "2 * pmod(game_id, 5) + 1 AS away_id",
                            "home_score", "away_score", "game_date"))

    # -- five-player groups for the pivot ------------------------------------------
    def lineup5(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS game_id",
            "pmod(l_orderkey, 2) AS team_id",
            "1 AS lineup_num",
            "CAST(1 + pmod(l_orderkey, 4) AS INT) AS period",
            "720 AS time_in",
            "0 AS time_out",
            "l_partkey AS player_id",
        )

    # -- source-shaped rows for the typed ingest (names as in the JSON files) ----
    def game_schedule_source(self) -> DataFrame:
        """Games as the JSON source has them: source-case keys, text timestamps."""
        return self.raw("orders").selectExpr(
            "o_orderkey AS Game_Id",
            "pmod(o_custkey, 1000) AS Home_Id",
            "CAST(pmod(floor(o_totalprice), 60) + 80 AS INT) AS Home_Score",
            "pmod(o_orderkey, 1000) AS Away_Id",
            "CAST(pmod(floor(o_totalprice / 60), 60) + 80 AS INT) AS Away_Score",
            "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS Game_Date")

    def team_affiliate_source(self) -> DataFrame:
        """Affiliations as the JSON source has them: ids written as doubles, some NULL."""
        return self.raw("supplier").selectExpr(
            "s_suppkey AS nba_teamId",
            "substr(s_name, -3) AS nba_abrv",
            "CASE WHEN pmod(s_nationkey, 5) = 0 THEN NULL "
            "ELSE CAST(s_suppkey + 1612709000 AS DOUBLE) END AS glg_teamId",
            "CASE WHEN pmod(s_nationkey, 5) = 0 THEN NULL ELSE substr(s_name, 1, 3) END AS glg_abrv")

    def team_source(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS teamId", "CASE WHEN pmod(s_suppkey, 2) = 0 THEN 'NBA' ELSE 'GLG' END AS leagueLk",
            "s_name AS teamName", "substr(s_name, -3) AS teamNameShort",
            "concat('Club \"', CAST(s_nationkey AS STRING), '\" {a}, [b]') AS teamNickname")

    def roster_source(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_nationkey AS team_id", "c_custkey AS player_id", "c_name AS first_name",
            "c_mktsegment AS last_name", "substr(c_mktsegment, 1, 1) AS position",
            "CASE WHEN c_acctbal < 0 THEN NULL ELSE 'Standard' END AS contract_type")

    def games_source_with_bad_rows(self) -> DataFrame:
        """The games with a text that is no timestamp in every 97th and a score beyond the type in every 89th."""
        good = self.game_schedule_source()
        return good.withColumns({
            "Game_Date": F.expr("CASE WHEN pmod(Game_Id, 97) = 0 THEN 'so}on, \"maybe\"' ELSE Game_Date END"),
            "Home_Score": F.expr("CASE WHEN pmod(Game_Id, 89) = 0 THEN 99999999999 "
                                 "ELSE CAST(Home_Score AS BIGINT) END")})

    def part_player(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS player_id", "p_name AS first_name", "p_brand AS last_name")


# ---------------------------------------------------------------------------
# The same views for the DuckDB oracle (tables pre-registered by the driver)
# ---------------------------------------------------------------------------

ADAPTER_SQL = {
    "team": """
        SELECT s_suppkey AS teamid, s_name AS teamname, 'Club ' || s_nationkey AS teamnickname
        FROM supplier""",
    "game_schedule": """
        SELECT o_orderkey AS game_id,
               o_custkey % (SELECT count(*) FROM supplier) AS home_id,
               o_orderkey % (SELECT count(*) FROM supplier) AS away_id,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 + 80 AS INTEGER) AS home_score,
               CAST(CAST(floor(o_totalprice / 60) AS BIGINT) % 60 + 80 AS INTEGER) AS away_score,
               o_orderdate AS game_date
        FROM orders""",
    "player": """
        SELECT c_custkey AS player_id, c_name AS first_name, c_mktsegment AS last_name
        FROM customer""",
    "lineup_ev": """
        SELECT 2 * (user_id % 5) + (user_id // 5) % 2 AS team_id,
               user_id AS player_id,
               event_id AS lineup_num,
               CAST(1 + hour(ts) // 12 AS INTEGER) AS period,
               CAST(43200 - ((hour(ts) % 12) * 3600 + minute(ts) * 60 + second(ts)) AS INTEGER) AS time_in,
               CAST(greatest(0, 43200 - ((hour(ts) % 12) * 3600 + minute(ts) * 60 + second(ts))
                                - CAST(floor(value * 120) AS BIGINT)) AS INTEGER) AS time_out,
               5 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + user_id % 5 AS game_id,
               CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_ts
        FROM events""",
    "lineup": """
        SELECT team_id, player_id, lineup_num, period, time_in, time_out, game_id
        FROM lineup_ev""",
    "lineup_games": """
        SELECT game_id,
               2 * (game_id % 5) AS home_id,
               2 * (game_id % 5) + 1 AS away_id,
               CAST(count(CASE WHEN team_id = 2 * (game_id % 5) THEN 1 END) AS INTEGER) AS home_score,
               CAST(count(CASE WHEN team_id = 2 * (game_id % 5) + 1 THEN 1 END) AS INTEGER) AS away_score,
               min(day_ts) AS game_date
        FROM lineup_ev
        GROUP BY game_id""",
    "lineup5": """
        SELECT l_orderkey AS game_id, l_orderkey % 2 AS team_id, 1 AS lineup_num,
               CAST(1 + l_orderkey % 4 AS INTEGER) AS period, 720 AS time_in, 0 AS time_out,
               l_partkey AS player_id
        FROM lineitem""",
    "part_player": """
        SELECT p_partkey AS player_id, p_name AS first_name, p_brand AS last_name
        FROM part""",
}

# Views each adapter depends on, in definition order.
_DEPENDS = {"lineup": ["lineup_ev"], "lineup_games": ["lineup_ev"]}


# When False, statements read model tables of the same names directly (used by
# the tests, which register small hand-made model tables in DuckDB).
USE_ADAPTERS = True


def with_views(names: list[str], body: str) -> str:
    """``WITH <adapter views> <body>`` for the oracle.

    ``body`` is either a SELECT, or starts with ``, name AS (...)`` to add
    further common table expressions after the adapter views.
    """
    if not USE_ADAPTERS:
        stripped = body.lstrip()
        return "WITH " + stripped[1:] if stripped.startswith(",") else body
    ordered: list[str] = []
    for name in names:
        for dep in _DEPENDS.get(name, []) + [name]:
            if dep not in ordered:
                ordered.append(dep)
    defs = ",\n".join(f"{n} AS ({ADAPTER_SQL[n]})" for n in ordered)
    return f"WITH {defs}\n{body}"
