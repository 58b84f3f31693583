"""Loads that lose nothing: versions, failed and killed reloads, quarantine, split JSON arrays."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from courtline.sources import ingest, json_records, schemas, versions

PLAYERS = [{"player_id": i, "first_name": f"A{i}", "last_name": "L"} for i in range(5)]


def write(folder, rows, name="player.json"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(rows if isinstance(rows, str) else json.dumps(rows))
    return str(folder)


def ids(df):
    return sorted(r["player_id"] for r in df.collect())


# versions ----------------------------------------------------------------------

def test_a_table_is_replaced_in_one_step_even_by_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.replace(spark.range(3), path)
    held = versions.read(spark, path)
    versions.replace(versions.read(spark, path).selectExpr("id + 10 AS id"), path)
    assert sorted(r.id for r in versions.read(spark, path).collect()) == [10, 11, 12]
    assert sorted(r.id for r in held.collect()) == [0, 1, 2]                  # a reader keeps its version
    assert sorted(r.id for r in versions.read(spark, path, 1).collect()) == [0, 1, 2]
    assert [e["version"] for e in versions.history(spark, path)] == [2, 1]


def test_retire_removes_old_versions_and_orphans_only(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        versions.replace(spark.range(n), path)
    orphan = versions.stage(spark.range(9), path).rsplit("/", 1)[1]
    assert len(versions.retire(spark, path, keep=2)) == 1
    assert versions.read(spark, path, 2).count() == 2
    assert orphan in os.listdir(f"{path}/versions")
    assert orphan in versions.retire(spark, path, keep=1, orphans=True)
    assert versions.read(spark, path).count() == 3


def test_a_write_that_fails_half_way_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(spark.range(4), path)
    broken = spark.range(0, 100, numPartitions=4).select(
        F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        versions.replace(broken, path)
    assert versions.read(spark, path).count() == 4


# reloads -----------------------------------------------------------------------

@pytest.mark.parametrize("broken", ['[{"player_id": 1, "first_name": "A"', '[{"player_id": "x"}]', None])
def test_failed_reload_keeps_the_rows(spark, tmp_path, broken):
    data, out = write(tmp_path / "in", PLAYERS), str(tmp_path / "out")
    ingest.load_tables(spark, data, out, tables=["player"])
    os.remove(f"{data}/player.json") if broken is None else write(tmp_path / "in", broken)
    with pytest.raises(Exception):
        ingest.load_tables(spark, data, out, tables=["player"])
    frames, status = ingest.load_tables(spark, data, out, tables=["player"], skip_failed=True)
    row = status.first()
    assert (row.rows, row.version, row.state) == (5, 1, "kept") and row.error
    assert ids(frames["player"]) == ids(ingest.stored_rows(spark, out, "player")) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("step", ["stage", "commit", "_check_keys"])
def test_load_killed_at_any_step_keeps_the_rows(spark, tmp_path, monkeypatch, step):
    class Killed(BaseException):
        pass

    def killed(*args, **kwargs):
        if step == "commit":
            versions.latest(*args[:2])
        raise Killed

    data, out = write(tmp_path / "in", PLAYERS), str(tmp_path / "out")
    ingest.load_tables(spark, data, out, tables=["player"])
    write(tmp_path / "in", PLAYERS[:2])
    monkeypatch.setattr(ingest if step == "_check_keys" else versions, step, killed)
    with pytest.raises(Killed):
        ingest.load_tables(spark, data, out, tables=["player"], skip_failed=True)
    monkeypatch.undo()
    assert ids(ingest.stored_rows(spark, out, "player")) == [0, 1, 2, 3, 4]
    ingest.load_tables(spark, data, out, tables=["player"])
    assert ids(ingest.stored_rows(spark, out, "player")) == [0, 1]


def test_bad_records_are_set_aside_with_file_and_position(spark, tmp_path):
    good = {"game_id": 1, "home_id": 1, "home_score": 9, "away_id": 2, "away_score": 8, "game_date": "2024-01-01 19:30:00"}
    rows = [good, {**good, "game_id": 2, "game_date": "2024-02-31 19:30:00"}, {**good, "game_id": 3, "home_score": "x}"},
            {**good, "game_id": 4, "game_date": None}, {**good, "game_id": 5, "away_id": 2.5}]
    text = json.dumps(rows, indent=1)[:-1] + ', 17, {"game_id": 6'
    data, out = write(tmp_path / "in", text, "game_schedule.json"), str(tmp_path / "out")
    frames, status = ingest.load_tables(spark, data, out, tables=["game_schedule"], set_aside=True)
    assert sorted(r.game_id for r in frames["game_schedule"].collect()) == [1, 4]
    assert (status.first().rows, status.first().state) == (2, "loaded")
    bad = ingest.quarantine(spark, out, "game_schedule").collect()
    assert status.first().quarantined == len(bad)
    raw = text.encode()
    for r in bad:
        assert r["file"].endswith("/in/game_schedule.json") and r["reason"]
        assert raw[r["position"]:].startswith(r["record"].encode())
    found = [json.loads(r["record"])["game_id"] for r in bad if r["reason"] != ingest.CUT_OFF]
    assert sorted(found) == [2, 3, 5]
    assert any('{"game_id": 6' in r["record"] for r in bad)


# arrays ------------------------------------------------------------------------

def odd_value(rng):
    return rng.choice(["", "}", "{", '"', "\\", '\\"}', "[1,{", "é€😀", "a\nb", "},\n{", "x" * rng.randint(0, 900)])


@pytest.fixture()
def small_ranges(spark):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1, 4])
@pytest.mark.parametrize("seed", range(3))
def test_array_split_by_bytes_equals_the_whole(spark, small_ranges, tmp_path, indent, seed):
    rng = random.Random(seed)
    rows = [{"player_id": i, "first_name": odd_value(rng), "last_name": odd_value(rng),
             "more": {"a": [odd_value(rng)], "b": {"c": None}}} for i in range(60)]
    text = json.dumps(rows, indent=indent, ensure_ascii=bool(seed % 2))
    path = f"{write(tmp_path / 'in', text)}/player.json"
    records = json_records.read_records(spark, path)
    assert records.rdd.getNumPartitions() > 5
    got = records.collect()
    raw = text.encode()
    assert all(r.complete for r in got)
    assert sorted((json.loads(r.record)["player_id"], r.record) for r in got) == sorted(
        (x["player_id"], raw[r.position:r.position + len(r.record.encode())].decode())
        for r in got for x in [json.loads(r.record)])
    by_id = {json.loads(r.record)["player_id"]: json.loads(r.record) for r in got}
    assert by_id == {x["player_id"]: x for x in rows}
    sorted_out = ingest.sort_out(spark, "player", path)
    whole = ingest.load_table(spark, "player", path, multi_line=True)
    assert sorted(map(tuple, ingest.good_rows(sorted_out, "player").collect())) == sorted(map(tuple, whole.collect()))


def test_a_record_longer_than_many_ranges(spark, small_ranges, tmp_path):
    rows = [{"player_id": 1, "first_name": "x}{" * 3000, "last_name": "a"}, {"player_id": 2, "first_name": "b", "last_name": None}]
    path = f"{write(tmp_path / 'in', json.dumps(rows, indent=2))}/player.json"
    got = ingest.good_rows(ingest.sort_out(spark, "player", path), "player").collect()
    assert sorted(map(tuple, got)) == [(1, "x}{" * 3000, "a"), (2, "b", None)]


def test_written_arrays_read_back(spark, tmp_path):
    rows = [(i, f'n"{i}"', None if i % 3 else "}") for i in range(100)]
    df = spark.createDataFrame(rows, schemas.SOURCE["player"]).repartition(3)
    json_records.write_array(df, str(tmp_path / "player.json"))
    got = ingest.good_rows(ingest.sort_out(spark, "player", str(tmp_path / "player.json")), "player")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == rows


# lines -------------------------------------------------------------------------

def test_lines_need_no_reading_of_their_strings(spark, small_ranges, tmp_path, monkeypatch):
    """Every line's place and text, over many ranges and files; the first pass only sums lengths."""
    def unread(text, inside):
        raise AssertionError("a line was scanned")
    monkeypatch.setattr(json_records, "_summaries", unread)
    rng = random.Random(4)
    lines, want = {}, []
    for name in ("a", "b"):
        raw = b""
        for i in range(200):
            record = rng.choice([b"", b"   ", b'{"player_id": %d}' % i, "{\"first_name\": \"é€😀}\"}".encode(), b"{", b"}",
                                 b"[1]", b'{"first_name": "\xff\xc3"}', b"{" + b"x" * rng.randint(0, 900) + b"}"])
            lead = rng.choice([b"", b" ", b"\t \x0b\x0c"])
            if record.strip():
                want.append((len(raw) + len(lead), record.decode("utf-8", "replace"),
                             record[:1] == b"{" and record[-1:] == b"}"))
            raw += lead + record + rng.choice([b"", b"  \r", b"\x0c\t"]) + b"\n"
        lines[name] = raw
        os.makedirs(tmp_path / "in", exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_bytes(raw)
    records = json_records.read_records(spark, str(tmp_path / "in"), "lines")
    assert records.rdd.getNumPartitions() > 5
    got = records.collect()
    assert sorted((r.position, r.record, r.complete) for r in got) == sorted(want)
    for r in got:
        text = lines[r.file.rsplit("/", 1)[1][0]][r.position:]
        assert text.decode("utf-8", "replace").startswith(r.record)
