"""Batch build of the derived tables and the serving queries over them."""

import os
import tempfile

from courtline.oracle import COACH_TEAM
from courtline.plans import build, serving
from fixtures import STINT_GAMES, STINT_LINEUP, frames


def test_build_all_and_serve(spark):
    m = frames(spark, games=STINT_GAMES, lineup=STINT_LINEUP)
    out = tempfile.mkdtemp(prefix="courtline-build-")
    paths = build.build_all(spark, m, out)
    assert set(paths) == {"basic_queries", "wide_table", "stints_results",
                          "stints_results_averages", "final_summary"}
    assert spark.read.parquet(paths["stints_results"]).count() == 5
    # intermediates live in the checkpoint folder
    ckpt = spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(os.path.join(ckpt, spark.sparkContext.applicationId, "temp_stint_accumulation"))
    summary = paths["final_summary"]
    assert [r.team for r in serving.team_list(spark, summary).collect()] == ["Bravo", COACH_TEAM]
    rows = serving.stint_data(spark, summary, COACH_TEAM).collect()
    assert [r.player_name for r in rows] == ["Ann Lee"]
    assert serving.stint_data(spark, summary, "").count() == 2          # '' means all teams
    pts = {r.label: (r.x, r.y) for r in serving.stint_chart(spark, summary).collect()}
    assert pts == {"Ann Lee": (2, -340.0), "Bob Ray": (1, 0.0)}
    build.register_views(spark, paths)
    got = spark.sql("SELECT player_name, games FROM final_summary WHERE team = 'Bravo'").collect()
    assert [tuple(r) for r in got] == [("Bob Ray", 1)]


def test_empty_lineup_builds_empty_tables(spark):
    from courtline.sources.ingest import empty_table
    from courtline.sources.schemas import TARGET
    m = frames(spark, games=STINT_GAMES, lineup=STINT_LINEUP)
    m["lineup"] = empty_table(spark, TARGET["lineup"])
    paths = build.build_all(spark, m, tempfile.mkdtemp(prefix="courtline-build-"))
    assert spark.read.parquet(paths["final_summary"]).count() == 0
    assert spark.read.parquet(paths["basic_queries"]).count() == 6


def test_calendars_sorted(spark):
    from fixtures import GAMES
    m = frames(spark, games=GAMES)
    ev = serving.scout_schedule(m["team"], m["game_schedule"]).collect()
    # 15 games; the one with an unknown away team has no record and drops out,
    # the one without a date stays (NULL start, sorted last)
    assert len(ev) == 14 and ev[-1].start is None
    starts = [e.start for e in ev[:-1]]
    assert starts == sorted(starts)
    assert "2024-01-06T20:30:15.250000" in starts
    coach = serving.coach_schedule(m["team"], m["game_schedule"], COACH_TEAM).collect()
    assert sorted(e.game_id for e in coach) == [1, 2, 3, 4, 5, 11, 12]   # self-game once


def test_command_line_build_and_serve(spark, tmp_path):
    import json
    import os as _os
    from courtline.__main__ import main
    data = tmp_path / "json"
    data.mkdir()
    def dump(name, rows):
        (data / name).write_text(json.dumps(rows))
    dump("team.json", [{"teamId": 1, "leagueLk": "NBA", "teamName": "A", "teamNameShort": "A", "teamNickname": "As"},
                       {"teamId": 2, "leagueLk": "NBA", "teamName": "B", "teamNameShort": "B", "teamNickname": "Bs"}])
    dump("team_affiliate.json", [])
    dump("game_schedule.json", [{"game_id": 10, "home_id": 1, "home_score": 100, "away_id": 2,
                                 "away_score": 90, "game_date": "2024-01-01 19:00:00"}])
    dump("player.json", [{"player_id": 101, "first_name": "Ann", "last_name": "Lee"}])
    dump("lineup.json", [{"team_id": 1, "player_id": 101, "lineup_num": 1, "period": 1,
                          "time_in": 720, "time_out": 600, "game_id": 10}])
    dump("roster.json", [])
    out = str(tmp_path / "out")
    main(["build", "--data", str(data), "--out", out, "--master", "local[2]"])
    main(["stints", "--out", out, "--dest", str(tmp_path / "stints"), "--master", "local[2]"])
    main(["scout", "--out", out, "--dest", str(tmp_path / "scout"), "--master", "local[2]"])
    stint_rows = spark.read.json(str(tmp_path / "stints")).collect()
    assert [(r.player_name, r.games, r.avg_stint_length_seconds) for r in stint_rows] == [("Ann Lee", 1, 120.0)]
    ev = spark.read.json(str(tmp_path / "scout")).collect()
    assert [(e.title, e.color) for e in ev] == [("As vs Bs (Diff: 0)", "#d4af37")]
    assert _os.path.isdir(_os.path.join(out, "derived", "final_summary"))


def test_query_views_for_sql_users(spark):
    m = frames(spark, games=STINT_GAMES, lineup=STINT_LINEUP)
    names = serving.register_query_views(spark, m)
    assert "final_summary" in names and "home_back_to_back" in names
    got = spark.sql("SELECT player_name, games FROM final_summary ORDER BY player_name").collect()
    assert [tuple(r) for r in got] == [("Ann Lee", 2), ("Bob Ray", 1)]
    assert spark.sql("SELECT count(*) AS n FROM stints_results").first().n == 5
