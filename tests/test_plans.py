"""Plan properties, checked on sf0.001 plans; no join asks for a broadcast by itself."""

import contextlib
import io
import re

import pytest

from courtline import registry

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_text(fn(spark, SF)) for name, fn in registry.queries().items()}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_nested_loop_cartesian_or_python(plans, name):
    p = plans[name]
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in p, f"{name}: {bad}"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_scans_are_pruned(plans, name):
    # every scan reads a strict subset of its table's columns, or at most the
    # columns the query needs (no table read in full for a narrow projection)
    full = {"lineitem": 11, "orders": 6, "events": 6, "customer": 5, "part": 6}
    for table, n in full.items():
        for m in re.finditer(rf"{table}\.parquet.*?ReadSchema: struct<([^>]*)>", p := plans[name], re.S):
            cols = m.group(1).split(",")
            assert len(cols) < n or name in ("distinct_rows",), (name, table, cols)


STINT_QUERIES = ["stint_intervals", "stint_results", "stint_durations"]


@pytest.mark.parametrize("name", STINT_QUERIES)
def test_stint_chain_shuffles_once_after_joins(plans, name):
    p = plans[name]
    # one repartition on (player_name, game_date); windows and aggregates reuse it
    assert len(re.findall(r"hashpartitioning\(player_name#\d+, game_date", p)) == 1, name
    assert "rangepartitioning" not in p


def test_no_query_hints_a_broadcast(spark):
    for name, fn in registry.queries().items():
        if name in ("team_standings", "standings_order", "calendar_order"):     # offsets: one row per range partition, a proven bound
            continue
        logical = fn(spark, SF)._jdf.queryExecution().logical().toString()
        assert "strategy=broadcast" not in logical, name


def test_records_are_joined_after_the_games_are_filtered(plans):
    assert "array_contains" in plans["opponent_difficulty"]
