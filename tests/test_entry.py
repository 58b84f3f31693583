"""Driver contract: entry() runs; every registered query equals its oracle at sf0.001."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from courtline import registry
from compare import compare, duck

SF = os.environ.get("COURTLINE_TEST_SF", "/root/testdata/sf0.001")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["teamid", "teamname", "games_played"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(registry.queries()) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, name):
    ok, n, _, detail = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, detail


DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_column_types_match_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    ours = {f.name: DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in sdf.schema.fields}
    rel = con.sql(E.oracle_sql()[name])
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert ours == theirs


@pytest.fixture()
def other_session_settings(spark):
    """A different session zone and ANSI off, restored afterwards."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    yield spark
    for k, v in saved.items():
        spark.conf.set(k, v)


def test_results_independent_of_zone_and_ansi(other_session_settings, con):
    spark = other_session_settings
    bad = [n for n, fn in registry.queries().items()
           if not compare(spark, con, n, fn, E.oracle_sql()[n], SF)[0]]
    assert bad == []


def test_model_queries_do_without_the_libraries_of_optional_parts():
    code = ("import sys; sys.modules['xxhash'] = None\n"
            "import __spark_entry__ as E; from courtline import registry\n"
            "assert set(E.queries()) == set(registry.queries()) == set(E.oracle_sql())")
    root = os.path.dirname(os.path.abspath(E.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env={**os.environ, "PYTHONPATH": root})
