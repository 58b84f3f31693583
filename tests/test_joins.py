"""Every query gives the same rows whether or not adaptive execution may broadcast."""

import pytest

from courtline import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in keys}
    yield lambda: [spark.conf.set(k, "-1") for k in keys]
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows_without_broadcasts(spark, no_broadcast, name):
    fn = registry.queries()[name]
    key = lambda r: tuple(map(repr, r))
    free = sorted(map(key, fn(spark, SF).collect()))
    no_broadcast()
    assert sorted(map(key, fn(spark, SF).collect())) == free


def test_new_rows_are_seen_in_the_same_session(spark, tmp_path):
    from courtline.sources.adapters import Tables
    path = str(tmp_path / "part.parquet")
    spark.range(5).write.parquet(path)
    assert Tables(spark, str(tmp_path)).raw("part").count() == 5
    spark.range(7).write.mode("append").parquet(path)
    assert Tables(spark, str(tmp_path)).raw("part").count() == 12
