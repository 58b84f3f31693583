"""SQL statements of every registered query, for DuckDB: a second opinion.

They follow the written rules of the model with other means than the Spark
plans: numbers are counts of what comes before, ranks are counts of what is
larger, neighbours are sought by minimum, and games are read as one list of
sides.  They are quadratic in places and meant for small tables.  Views over
the driver tables come from ``ADAPTER_SQL``.
"""

from __future__ import annotations

from courtline.sources import adapters
from courtline.sources.adapters import COACH_TEAM, with_views

TG = ["team", "game_schedule"]
LU = ["team", "player", "lineup", "lineup_games"]

# fixed values: difficulty thresholds and colours of the two calendars
SCOUT = [(10, "purple"), (5, "red"), (0, "#d4af37"), (-5, "#228b22"), (-10, "#006400")]
COACH = [(5, "purple"), (2.5, "red"), (0, "#d4af37"), (-2.5, "#228b22"), (-5, "#006400")]
DEFAULT_COLOUR = "#006400"


# the source-shaped tables once loaded and typed
TYPED_GAMES = """
SELECT o_orderkey AS game_id, o_custkey % 1000 AS home_id, o_orderkey % 1000 AS away_id,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 + 80 AS INTEGER) AS home_score,
       CAST(CAST(floor(o_totalprice / 60) AS BIGINT) % 60 + 80 AS INTEGER) AS away_score,
       strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS game_date
FROM orders"""

TYPED_AFFILIATES = """
SELECT s_suppkey AS nba_teamid, right(s_name, 3) AS nba_abrv,
       CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_suppkey + 1612709000 END AS glg_teamid,
       CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE left(s_name, 3) END AS glg_abrv
FROM supplier"""


LOADED = {
    "team": """
SELECT s_suppkey AS teamid, s_name AS teamname, right(s_name, 3) AS teamnameshort,
       'Club "' || s_nationkey || '" {a}, [b]' AS teamnickname,
       CASE WHEN s_suppkey % 2 = 0 THEN 'NBA' ELSE 'GLG' END AS leaguelk
FROM supplier""",
    "player": "SELECT c_custkey AS player_id, c_name AS first_name, c_mktsegment AS last_name FROM customer",
    "roster": """
SELECT CAST(c_nationkey AS BIGINT) AS team_id, c_custkey AS player_id, c_name AS first_name, c_mktsegment AS last_name,
       left(c_mktsegment, 1) AS position, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'Standard' END AS contract_type
FROM customer""",
}

# what the load of the games with planted bad rows keeps, and what it sets aside
GOOD_GAMES = f"SELECT * FROM ({TYPED_GAMES}) WHERE game_id % 97 <> 0 AND game_id % 89 <> 0"
BAD_GAMES = """
SELECT o_orderkey AS game_id,
       CASE WHEN o_orderkey % 89 = 0 THEN 'not an object of the table''s types'
            ELSE 'game_date: not a value of the table''s type' END AS reason
FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0"""


def _load_status() -> str:
    """All six tables loaded with set-aside rows, then a second load that finds the games only."""
    rows = {"team": "supplier", "team_affiliate": "supplier", "player": "customer", "lineup": "events",
            "roster": "customer"}
    kept = [f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {source}) AS rows, CAST(0 AS BIGINT) AS quarantined,
       CAST(1 AS BIGINT) AS version, 'kept' AS state""" for t, source in rows.items()]
    games = """SELECT 'game_schedule', (SELECT count(*) FROM orders), 0, 2, 'loaded'"""
    return "\nUNION ALL ".join([*kept, games])


def sql_ratio(num: str, den: str) -> str:
    """num / den rounded to two places, half away from zero, exact; NULL where den is 0 or NULL."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return (f"CASE WHEN {den} <> 0 THEN CAST(sign({n}) * sign({d}) "
            f"* ((200 * abs({n}) + abs({d})) // (2 * abs({d}))) AS DOUBLE) / 100 END")


def sql_colour(value: str, levels: list[tuple[float, str]]) -> str:
    """The colour of the highest threshold reached, looked up in a list of levels."""
    steps = ", ".join(f"CASE WHEN {value} >= {t} THEN '{c}' END" for t, c in levels)
    return f"coalesce({steps}, '{DEFAULT_COLOUR}')"


def sql_iso(ts: str) -> str:
    return f"replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')"


def sql_clock(seconds: str) -> str:
    """Minutes within the hour and seconds, as MI:SS."""
    return f"lpad(CAST(({seconds}) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({seconds}) % 60 AS VARCHAR), 2, '0')"


# One row per game and side: margin is positive for the side that scored more.
def _sides(games: str = "game_schedule") -> str:
    return f"""
, sides AS (
    SELECT game_id, game_date, role,
           CASE role WHEN 'home' THEN home_id ELSE away_id END AS side_id,
           CASE role WHEN 'home' THEN home_score - away_score ELSE away_score - home_score END AS margin
    FROM {games} CROSS JOIN (VALUES ('home'), ('away')) r(role))"""


_BALANCE = _sides() + """
, balance AS (
    SELECT side_id, count(*) FILTER (WHERE margin > 0) AS won, count(*) FILTER (WHERE margin < 0) AS lost FROM sides GROUP BY side_id)"""

# One row per team and day with a game (a game against itself counts once).
_DAYS = """
, played AS (
    SELECT DISTINCT game_id, side_id, game_date FROM (
        SELECT row_number() OVER () AS game_id, home_id, away_id, CAST(game_date AS DATE) AS game_date
        FROM game_schedule) g, unnest([home_id, away_id]) u(side_id)
    WHERE side_id IN (SELECT teamid FROM team))
, days AS (SELECT side_id, game_date AS d, count(*) AS m FROM played WHERE game_date IS NOT NULL GROUP BY ALL)"""


def _standings() -> str:
    def place(col: str) -> str:
        return f"(SELECT 1 + count(*) FROM t o WHERE o.{col} > t.{col})"
    return with_views(TG, _sides() + f"""
, t AS (
    SELECT teamid, teamname, count(*) FILTER (WHERE role = 'home') AS home_games, count(*) FILTER (WHERE role = 'away') AS away_games,
           count(role) AS games_played, count(*) FILTER (WHERE margin > 0) AS wins, count(*) FILTER (WHERE margin < 0) AS losses
    FROM team LEFT JOIN sides ON side_id = teamid GROUP BY teamid, teamname)
SELECT teamid, teamname, games_played, {place('games_played')} AS rank_games_played,
       CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses,
       {sql_ratio('wins', 'games_played')} AS win_percentage,
       CAST(home_games AS BIGINT) AS home_games, {place('home_games')} AS rank_home_games,
       CAST(away_games AS BIGINT) AS away_games, {place('away_games')} AS rank_away_games
FROM t""")


_PAIRS = """
, pairs AS (
    SELECT home_id AS teamid, * FROM game_schedule
    UNION ALL
    SELECT away_id AS teamid, * FROM game_schedule WHERE away_id IS DISTINCT FROM home_id)"""


def _role_join(how: str) -> str:
    return with_views(TG, _PAIRS + f"""
SELECT teamid, teamname, game_id, home_id, away_id, game_date FROM team {how} JOIN pairs USING (teamid)""")


def _back_to_back(role: str) -> str:
    return with_views(TG, f"""
, days AS (SELECT DISTINCT {role}_id AS k, CAST(game_date AS DATE) AS d FROM game_schedule)
SELECT teamid AS {role}_team, teamname, count(*) AS {role}_b2b_count
FROM team JOIN days ON k = teamid
WHERE (k, d + 1) IN (SELECT k, d FROM days)
GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 20""")


def _longest_rest() -> str:
    return with_views(TG, _DAYS + """
, gaps AS (
    SELECT a.side_id, a.d, min(b.d) AS n, 1 AS copies FROM days a JOIN days b ON a.side_id = b.side_id AND b.d > a.d
    GROUP BY a.side_id, a.d
    UNION ALL
    SELECT side_id, d, d, m - 1 FROM days WHERE m > 1)
SELECT side_id AS team_id, teamname, CAST(n - d AS BIGINT) AS rest_days, d AS last_game_date, n AS next_game_date
FROM gaps JOIN team ON teamid = side_id, range(copies)
WHERE n - d = (SELECT max(n - d) FROM gaps)""")


def _three_in_four() -> str:
    # a game opens a stretch if two more games of its team follow by the third day after it
    return with_views(TG, _DAYS + """
, ahead AS (
    SELECT a.side_id, a.d, a.m, coalesce(sum(b.m), 0) AS later
    FROM days a LEFT JOIN days b ON a.side_id = b.side_id AND b.d - a.d BETWEEN 1 AND 3 GROUP BY a.side_id, a.d, a.m)
SELECT side_id AS team_id, teamname, count(*) AS num_3_in_4s
FROM ahead JOIN team ON teamid = side_id, range(m) r(same_day)
WHERE same_day + later >= 2
GROUP BY ALL""")


def _game_numbers() -> str:
    return with_views(TG, _PAIRS + """
, dated AS (
    SELECT teamid, teamname, game_id, CAST(game_date AS DATE) AS game_date,
           coalesce(CAST(game_date AS DATE), DATE '9999-12-31') AS d,
           row_number() OVER () AS k FROM pairs JOIN team USING (teamid))
SELECT a.teamid AS team_id, a.teamname, a.game_id, a.game_date, 1 + count(b.k) AS game_num
FROM dated a LEFT JOIN dated b ON a.teamid = b.teamid AND (b.d, b.game_id, b.k) < (a.d, a.game_id, a.k)
GROUP BY a.k, a.teamid, a.teamname, a.game_id, a.game_date""")


def _game_results() -> str:
    return with_views(TG, _sides() + """
SELECT game_id, game_date, side_id AS team_id, teamname AS team,
       CASE WHEN margin > 0 THEN 'win' ELSE 'loss' END AS result
FROM sides JOIN team ON teamid = side_id""")


def _team_records() -> str:
    return with_views(TG, _BALANCE + """
SELECT teamid AS team_id, teamnickname AS team_nickname, CAST(won AS BIGINT) AS total_wins,
       CAST(lost AS BIGINT) AS total_losses
FROM balance JOIN team ON teamid = side_id""")


def _calendar(levels) -> str:
    return f"""
SELECT coalesce(home_team, 'None') || ' vs ' || coalesce(away_team, 'None') || ' (Diff: ' || difficulty || ')' AS title,
       {sql_iso('game_date')} AS start, true AS "allDay", difficulty, home_team, away_team, game_id,
       {sql_colour('difficulty', levels)} AS color
FROM rated"""


_RATED_TEAMS = _BALANCE + """
, rated_team AS (
    SELECT teamid, teamname, teamnickname, CAST(won - lost AS BIGINT) AS surplus
    FROM balance JOIN team ON teamid = side_id)"""


def _schedule_difficulty() -> str:
    return with_views(TG, _RATED_TEAMS + """
, rated AS (
    SELECT game_id, game_date, h.teamnickname AS home_team, a.teamnickname AS away_team,
           h.surplus + a.surplus AS difficulty
    FROM game_schedule, rated_team h, rated_team a WHERE h.teamid = home_id AND a.teamid = away_id)"""
                      + _calendar(SCOUT))


def _opponent_difficulty(team_name: str = COACH_TEAM) -> str:
    def seen_from(own: str, other: str, unless: str) -> str:
        return f"""
    SELECT game_id, game_date, h.teamnickname AS home_team, a.teamnickname AS away_team,
           {other}.surplus AS difficulty
    FROM game_schedule, rated_team h, rated_team a
    WHERE h.teamid = home_id AND a.teamid = away_id AND {own}.teamname = '{team_name}'{unless}"""
    at_home = seen_from("h", "a", "")
    away = seen_from("a", "h", f" AND h.teamname IS DISTINCT FROM '{team_name}'")
    return with_views(TG, _RATED_TEAMS + f"""
, rated AS ({at_home}
    UNION ALL {away})""" + _calendar(COACH))


def _lineup_wide() -> str:
    keys = "game_id, team_id, lineup_num, period, time_in, time_out"
    slots = ", ".join(f"max(name) FILTER (WHERE slot = {k}) AS player{k}" for k in range(1, 6))
    # a group's distinct members as one sorted list; the place in it is the slot
    return with_views(["lineup5", "part_player"], f"""
, named AS (SELECT player_id, max(first_name || ' ' || last_name) AS name, count(*) AS n
            FROM part_player GROUP BY player_id)
, members AS (SELECT {keys}, list_sort(list(DISTINCT player_id), 'ASC', 'NULLS LAST') AS ids FROM lineup5 GROUP BY ALL)
, placed AS (SELECT * EXCLUDE (ids), unnest(ids) AS player_id, generate_subscripts(ids, 1) AS slot FROM members)
SELECT {keys}, {slots}
FROM placed JOIN named USING (player_id) GROUP BY {keys} HAVING sum(n) = 5""")


# Every lineup row with both teams' names; the opponent is the away team for a
# home side, the home team for any other.
_ON_COURT = """
, opposed AS (
    SELECT l.*, g.game_date,
           CASE WHEN l.team_id = g.home_id THEN g.away_id ELSE g.home_id END AS opp_id
    FROM lineup l, lineup_games g WHERE g.game_id = l.game_id)
, on_court AS (
    SELECT opposed.*, o.teamname AS team, x.teamname AS opponent
    FROM opposed, team o, team x WHERE o.teamid = team_id AND x.teamid = opp_id)"""


def _opponent_key_join() -> str:
    return with_views(LU, _ON_COURT + """
SELECT game_id, team_id, player_id, lineup_num, opp_id, team, opponent FROM on_court""")


# Places of the intervals in a name's game period; a cut lies behind an
# interval if the same player's next one begins below its end; an interval's
# stint is one more than the cuts before it.
_STINTS = _ON_COURT + f"""
, spell AS (
    SELECT DISTINCT game_date, game_id, team_id, team, opponent, first_name || ' ' || last_name AS player_name,
           player_id, period, time_in, time_out
    FROM on_court JOIN player USING (player_id))
, placed AS (
    SELECT *, dense_rank() OVER (ORDER BY player_name, game_id, period) AS box,
           row_number() OVER (ORDER BY time_in DESC NULLS FIRST, time_out DESC NULLS FIRST, player_id, team_id) AS place
    FROM spell)
, follower AS (
    SELECT a.box, a.place, min(b.place) AS next_place
    FROM placed a JOIN placed b ON a.box = b.box AND a.player_id = b.player_id AND b.place > a.place GROUP BY ALL)
, cut AS (
    SELECT a.box, a.place FROM follower f JOIN placed a ON a.place = f.place JOIN placed b ON b.place = f.next_place
    WHERE b.time_in < a.time_out)
, stint AS (
    SELECT placed.*, 1 + (SELECT count(*) FROM cut WHERE cut.box = placed.box AND cut.place < placed.place)
           AS stint_number FROM placed)
, result AS (
    SELECT game_date, team, opponent, player_name, period, stint_number,
           {sql_clock('max(time_in)')} AS stint_start_time, {sql_clock('min(time_out)')} AS stint_end_time
    FROM stint GROUP BY game_id, game_date, team, opponent, player_name, period, stint_number)
, span AS (
    SELECT game_date, team, player_name, period, stint_number, max(time_in) - min(time_out) AS stint_seconds
    FROM stint GROUP BY ALL)
, duration AS (
    SELECT DISTINCT result.*, stint_seconds
    FROM result JOIN span USING (game_date, team, player_name, period, stint_number))
, daily AS (
    SELECT player_name, team, game_date, count(*) AS n, sum(stint_seconds) AS s, count(stint_seconds) AS c
    FROM duration GROUP BY ALL)"""


def _stints(select: str) -> str:
    return with_views(LU, _STINTS + "\n" + select)


def _summary(select: str) -> str:
    """One row per player and team from daily totals, weighted by the day's results of the team."""
    def diff(a: str, n: str, b: str, m: str) -> str:
        ratio = sql_ratio(f"(CAST({a} AS HUGEINT) * {m} - CAST({b} AS HUGEINT) * {n})", f"(CAST({n} AS HUGEINT) * {m})")
        return f"coalesce({ratio}, 0.0)"
    return with_views(LU, _STINTS + _sides("lineup_games").replace(", sides AS", ", day_sides AS") + f"""
, outcome AS (
    SELECT game_date, teamname AS team, count(*) FILTER (WHERE margin > 0) AS won, count(*) - count(*) FILTER (WHERE margin > 0) AS lost
    FROM day_sides JOIN team ON teamid = side_id GROUP BY ALL)
, total AS (
    SELECT player_name, team, count(*) AS games,
           count(*) FILTER (WHERE won > 0) AS games_won, count(*) FILTER (WHERE lost > 0) AS games_lost,
           sum(n * won) AS nw, sum(s * won) AS sw, sum(c * won) AS cw,
           sum(n * lost) AS nl, sum(s * lost) AS sl, sum(c * lost) AS cl
    FROM daily JOIN outcome USING (game_date, team) GROUP BY player_name, team)
, summary AS (
    SELECT player_name, team, CAST(games AS BIGINT) AS games,
           {sql_ratio('(nw + nl)', 'games')} AS avg_stints_per_game,
           {sql_ratio('(coalesce(sw, 0) + coalesce(sl, 0))', '(cw + cl)')} AS avg_stint_length_seconds,
           CAST(games_won AS BIGINT) AS games_won,
           {sql_ratio('nw', 'games_won')} AS avg_stints_wins, {sql_ratio('sw', 'cw')} AS avg_stint_length_wins,
           CAST(games_lost AS BIGINT) AS games_lost,
           {sql_ratio('nl', 'games_lost')} AS avg_stints_losses, {sql_ratio('sl', 'cl')} AS avg_stint_length_losses,
           {diff('sw', 'cw', 'sl', 'cl')} AS diff_avg_stint_length,
           {diff('nw', 'games_won', 'nl', 'games_lost')} AS diff_avg_stints_per_game
    FROM total)
""" + select)


def _stint_statements() -> dict[str, str]:
    return {
        "lineup_wide": _lineup_wide(),
        "opponent_key_join": _opponent_key_join(),
        "stint_intervals": _stints("SELECT game_date, game_id, team_id, team, opponent, player_name, "
                                   "period, time_in, time_out, stint_number FROM stint"),
        "stint_results": _stints("SELECT * FROM result"),
        "stint_durations": _stints("SELECT * FROM duration"),
        "stint_averages": _stints(f"""
SELECT player_name, team, {sql_ratio('sum(n)', 'count(*)')} AS average_stints_per_game,
       {sql_ratio('sum(s)', 'sum(c)')} AS avg_stint_length_seconds
FROM daily GROUP BY player_name, team"""),
        "win_loss_summary": _summary("SELECT * FROM summary"),
        "team_list": _summary("SELECT DISTINCT team FROM summary"),
        "stint_summary_all": _summary("SELECT * FROM summary"),
        "sql_stint_summary": _summary(f"SELECT * FROM summary WHERE team = '{COACH_TEAM}'"),
        "sql_stint_chart": _summary("SELECT player_name AS label, team, games AS x, "
                                    "diff_avg_stint_length AS y FROM summary"),
        "stint_summary_team": _summary(f"SELECT * FROM summary WHERE team = '{COACH_TEAM}'"),
        "scatter_points": _summary("SELECT player_name AS label, team, games AS x, "
                                   "diff_avg_stint_length AS y FROM summary"),
        "typed_game_schedule": TYPED_GAMES,
        "json_load_games": TYPED_GAMES,
        "typed_team_affiliate": TYPED_AFFILIATES,
        "json_load_affiliates": TYPED_AFFILIATES,
        **{f"json_load_{name}": sql for name, sql in LOADED.items()},
        "json_load_lineup": with_views(
            ["lineup"], "SELECT * REPLACE (CAST(lineup_num AS INTEGER) AS lineup_num) FROM lineup"),
        "json_array_games": GOOD_GAMES,
        "json_quarantine_games": BAD_GAMES,
        "json_load_status": _load_status(),
        "affiliate_records": """
SELECT '{"nba_teamid":' || s_suppkey || ',"nba_abrv":"' || right(s_name, 3) || '",' ||
       CASE WHEN s_nationkey % 5 = 0 THEN '"glg_teamid":null,"glg_abrv":null}'
            ELSE '"glg_teamid":' || s_suppkey + 1612709000 || ',"glg_abrv":"' || left(s_name, 3) || '"}' END AS json
FROM supplier""",
        "key_violations": """
SELECT l_orderkey, l_linenumber, count(*) AS n
FROM lineitem
GROUP BY l_orderkey, l_linenumber
HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
        "distinct_rows": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem",
    }


def model_statements() -> dict[str, str]:
    """The statements over model tables (team, game_schedule, player, lineup,
    lineup_games, lineup5, part_player) registered directly, without adapters."""
    adapters.USE_ADAPTERS = False
    try:
        return oracle_statements()
    finally:
        adapters.USE_ADAPTERS = True


def oracle_statements() -> dict[str, str]:
    return {
        "team_standings": _standings(),
        "role_left_join": _role_join("LEFT"),
        "role_inner_join": _role_join("INNER"),
        "home_back_to_back": _back_to_back("home"),
        "away_back_to_back": _back_to_back("away"),
        "longest_rest": _longest_rest(),
        "three_in_four": _three_in_four(),
        "game_numbers": _game_numbers(),
        "game_results": _game_results(),
        "team_records": _team_records(),
        "schedule_difficulty": _schedule_difficulty(),
        "opponent_difficulty": _opponent_difficulty(),
        "sql_coach_calendar": _opponent_difficulty(),
        "standings_order": f"""
SELECT row_number() OVER (ORDER BY win_percentage DESC NULLS LAST, teamid) AS position, teamid, win_percentage
FROM ({_standings()})""",
        "calendar_order": f"""
SELECT row_number() OVER (ORDER BY start NULLS LAST, game_id NULLS LAST) AS position, game_id, start
FROM ({_schedule_difficulty()})""",
        **_stint_statements(),
    }
