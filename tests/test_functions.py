import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtline.functions import scalars as S


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_round_ratio_half_away_from_zero(spark):
    rows = [(29, 200), (-29, 200), (-1, 8), (10, 16), (3, 16), (1, 3), (2, 3), (5, 0), (5, None), (0, 7)]
    got = one(spark, rows, "a long, b long", S.round_ratio("a", "b"))
    assert got == [0.15, -0.15, -0.13, 0.63, 0.19, 0.33, 0.67, None, None, 0.0]


def test_round_diff_of_ratios(spark):
    # 1520/4 - 720/1 = -340 ; either side undefined gives 0
    rows = [(1520, 4, 720, 1), (3, 1, 1, 1), (420, 1, 0, 0), (None, 0, 5, 1)]
    got = one(spark, rows, "a long, b long, c long, d long", S.round_diff_of_ratios("a", "b", "c", "d"))
    assert got == [-340.0, 2.0, 0.0, 0.0]


def test_clock_mmss(spark):
    got = one(spark, [(720,), (59,), (0,), (3600,), (None,), (4000,)], "s int", S.clock_mmss("s"))
    assert got == ["12:00", "00:59", "00:00", "00:00", None, "06:40"]


def test_scout_colours(spark):
    vals = [(10,), (9,), (5,), (0,), (-1,), (-5,), (-6,), (-11,)]
    got = one(spark, vals, "d long", S.colour_bucket("d", S.SCOUT_LEVELS))
    assert got == ["purple", "red", "red", "#d4af37", "#228b22", "#228b22", "#006400", "#006400"]


def test_coach_colours_fractional_threshold(spark):
    vals = [(5,), (3,), (2,), (0,), (-2,), (-3,), (-5,), (-9,)]
    got = one(spark, vals, "d long", S.colour_bucket("d", S.COACH_LEVELS))
    assert got == ["purple", "red", "#d4af37", "#d4af37", "#228b22", "#006400", "#006400", "#006400"]


def test_iso_timestamp_and_title(spark):
    rows = [(dt.datetime(2024, 1, 2, 19, 0), "A", "B", 5),
            (dt.datetime(2024, 1, 2, 19, 0, 1, 250000), None, "B", -3)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, h string, a string, d long")
    got = df.select(S.iso_timestamp("t"), S.event_title("h", "a", "d")).collect()
    assert [tuple(r) for r in got] == [("2024-01-02T19:00:00", "A vs B (Diff: 5)"),
                                      ("2024-01-02T19:00:01.250000", "None vs B (Diff: -3)")]


def test_full_name_null_propagates(spark):
    got = one(spark, [("Ann", "Lee"), ("Cid", None)], "f string, l string", S.full_name("f", "l"))
    assert got == ["Ann Lee", None]


def test_int_div_exact(spark):
    big = 2 ** 52 + 3
    got = one(spark, [(big, 7), (13, 5), (0, 3)], "a long, b long", S.int_div("a", "b"))
    assert got == [big // 7, 2, 0]


def test_round_ratio_equals_decimal_half_up(spark):
    """Exact NUMERIC rounding vs Python's Decimal ROUND_HALF_UP on random integers."""
    import random
    from decimal import ROUND_HALF_UP, Decimal
    rnd = random.Random(3)
    rows = [(rnd.randint(-10**9, 10**9), rnd.choice([1, 2, 3, 7, 8, 16, 200, 3 * 10**6, rnd.randint(1, 10**9)]))
            for _ in range(3000)]
    rows += [(k * 5, 1000) for k in range(-30, 31)]          # exact .xx5 ties
    got = one(spark, rows, "a long, b long", S.round_ratio("a", "b"))
    want = [float((Decimal(a) / Decimal(b)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
            if abs(Decimal(a) / Decimal(b)) < 10**12 else None for a, b in rows]
    # Decimal division is exact to 28 digits here, enough for these magnitudes
    assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]


def test_diff_of_averages_single_rounding(spark):
    from decimal import ROUND_HALF_UP, Decimal
    rows = [(1, 8, 0, 1), (7, 3, 2, 3), (1000001, 3, 1, 2), (-5, 4, 5, 8)]
    got = one(spark, rows, "a long, b long, c long, d long", S.round_diff_of_ratios("a", "b", "c", "d"))
    want = [float((Decimal(a) / Decimal(b) - Decimal(c) / Decimal(d)).quantize(
        Decimal("0.01"), rounding=ROUND_HALF_UP)) for a, b, c, d in rows]
    assert got == want


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_ratios_beyond_64_bit_products(spark, ansi):
    from courtline.functions.scalars import round_diff_of_ratios, round_ratio
    saved = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(10**12, 10**9, 10**12, 2 * 10**9, 9 * 10**18)],
                                   "a long, b long, c long, d long, e long")
        got = df.select(round_diff_of_ratios("a", "b", "c", "d").alias("x"), round_ratio("e", "a").alias("y")).first()
        assert tuple(got) == (500.0, 9000000.0)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", saved)
