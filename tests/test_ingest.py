"""Typed JSON ingest: source-case names, float keys, timestamps, key checks, failures."""

import json
import os
import tempfile

import pytest

from courtline.sources import ingest, schemas


def write_json_array(folder, name, rows):
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(json.dumps(rows))  # one top-level array on one line, like the seed files


@pytest.fixture()
def data_dir():
    d = tempfile.mkdtemp(prefix="courtline-json-")
    write_json_array(d, "team.json", [
        {"teamId": 10, "leagueLk": "NBA", "teamName": "Alpha", "teamNameShort": "ALP", "teamNickname": "Als"},
        {"teamId": 11, "leagueLk": "GLG", "teamName": "Beta", "teamNameShort": "BET", "teamNickname": "Bets"}])
    write_json_array(d, "team_affiliate.json", [
        {"nba_teamId": 10, "nba_abrv": "ALP", "glg_teamId": 1612709929.0, "glg_abrv": "CPS"},
        {"nba_teamId": 12, "nba_abrv": "GAM", "glg_teamId": None, "glg_abrv": None}])
    write_json_array(d, "game_schedule.json", [
        {"game_id": 1, "home_id": 10, "home_score": 101, "away_id": 11, "away_score": 99,
         "game_date": "2024-01-01 19:30:00"}])
    write_json_array(d, "player.json", [{"player_id": 5, "first_name": "Ann", "last_name": "Lee"}])
    write_json_array(d, "roster.json", [
        {"team_id": 10, "player_id": 5, "first_name": "Ann", "last_name": "Lee",
         "position": "G", "contract_type": "Standard"}])
    return d  # lineup.json deliberately absent


def test_load_with_missing_file_isolated(spark, data_dir):
    frames, status = ingest.load_tables(spark, data_dir, skip_failed=True)
    st = {r.table: (r.rows, r.error) for r in status.collect()}
    assert st["team"] == (2, None)
    assert st["game_schedule"] == (1, None)
    assert st["lineup"][0] == 0 and st["lineup"][1] is not None
    assert frames["lineup"].count() == 0
    assert frames["lineup"].schema == schemas.TARGET["lineup"]


def test_missing_file_raises_by_default(spark, data_dir):
    with pytest.raises(Exception):
        ingest.load_tables(spark, data_dir)


def test_types_names_and_values(spark, data_dir):
    frames, _ = ingest.load_tables(spark, data_dir, tables=["team", "team_affiliate", "game_schedule"])
    assert frames["team"].columns == ["teamid", "teamname", "teamnameshort", "teamnickname", "leaguelk"]
    aff = sorted(tuple(r) for r in frames["team_affiliate"].collect())
    assert aff == [(10, "ALP", 1612709929, "CPS"), (12, "GAM", None, None)]
    g = frames["game_schedule"].collect()[0]
    assert str(g.game_date) == "2024-01-01 19:30:00"
    assert frames["game_schedule"].schema == schemas.TARGET["game_schedule"]


def test_duplicate_key_reported(spark, data_dir):
    write_json_array(data_dir, "player.json", [
        {"player_id": 5, "first_name": "Ann", "last_name": "Lee"},
        {"player_id": 5, "first_name": "Bob", "last_name": "Ray"}])
    with pytest.raises(ValueError, match="primary key"):
        ingest.load_tables(spark, data_dir, tables=["player"])
    _, status = ingest.load_tables(spark, data_dir, tables=["player"], skip_failed=True)
    assert "primary key" in status.collect()[0].error


def test_writes_parquet_and_reads_back(spark, data_dir):
    out = tempfile.mkdtemp(prefix="courtline-out-")
    frames, _ = ingest.load_tables(spark, data_dir, out_dir=out, tables=["team"])
    assert os.path.isdir(os.path.join(out, "team"))
    assert frames["team"].count() == 2
    # replace, not append: a second load leaves the same rows
    frames, _ = ingest.load_tables(spark, data_dir, out_dir=out, tables=["team"])
    assert frames["team"].count() == 2


def test_non_integral_float_key_rejected(spark, data_dir):
    write_json_array(data_dir, "team_affiliate.json", [
        {"nba_teamId": 10, "nba_abrv": "ALP", "glg_teamId": 1.5, "glg_abrv": "X"}])
    # checked when the table is materialised (every column is evaluated on write)
    with pytest.raises(Exception, match="not an integer"):
        ingest.load_tables(spark, data_dir, out_dir=tempfile.mkdtemp(prefix="courtline-out-"),
                           tables=["team_affiliate"])


def test_queries_run_on_json_backed_tables(spark, data_dir):
    # size checks for broadcasts must work for non-Parquet sources too
    from courtline.plans import schedule
    frames, _ = ingest.load_tables(spark, data_dir, tables=["team", "game_schedule"])
    rows = {r.teamid: r for r in schedule.team_standings(frames["team"], frames["game_schedule"]).collect()}
    assert (rows[10].wins, rows[11].losses, rows[10].win_percentage) == (1, 1, 1.0)


def test_temp_table_and_assert_key(spark):
    from courtline.operators.quality import assert_key
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    ingest.temp_table(df, "kv")
    assert spark.sql("SELECT count(*) AS n FROM kv").first().n == 4
    with pytest.raises(ValueError, match="violated"):
        assert_key(df, ["k"], "kv")
    assert_key(df.where("k = 1"), ["k"], "kv")


def test_multi_line_document_and_failfast(spark, tmp_path):
    rows = [{"player_id": 1, "first_name": "Ann", "last_name": "Lee"},
            {"player_id": 2, "first_name": "Bob", "last_name": None}]
    (tmp_path / "player.json").write_text(json.dumps(rows, indent=2))      # one document over many lines
    df = ingest.load_table(spark, "player", str(tmp_path / "player.json"), multi_line=True)
    assert sorted(map(tuple, df.collect())) == [(1, "Ann", "Lee"), (2, "Bob", None)]
    (tmp_path / "bad.json").write_text('{"player_id": 1, "first_name": "Ann"\n')  # malformed record
    with pytest.raises(Exception):
        ingest.load_table(spark, "player", str(tmp_path / "bad.json")).collect()
