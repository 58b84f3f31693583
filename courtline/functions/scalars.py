"""Column expressions shared by the plans.

Every helper takes column names (or SQL expression text) and returns one
built-in Spark SQL expression, so it stays inside whole-stage code generation
and costs one call to build; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def q(name: str) -> str:
    """A column name quoted for SQL text; expressions are passed through."""
    return f"`{name}`" if _IDENT.match(name) else f"({name})"


def int_div_sql(a: str, b: str) -> str:
    """Exact integral division (Spark's ``div``) of two integral expressions."""
    return f"(CAST({q(a)} AS BIGINT) div CAST({q(b)} AS BIGINT))"


def int_div(a: str, b: str) -> Column:
    """Floor division of two non-negative integral columns, as a long."""
    return F.expr(int_div_sql(a, b))


# ---------------------------------------------------------------------------
# Exact decimal rounding of ratios (NUMERIC semantics, half away from zero)
# ---------------------------------------------------------------------------

def round_ratio_sql(num: str, den: str, digits: int = 2) -> str:
    n, d = f"CAST({q(num)} AS DECIMAL(38,0))", f"CAST({q(den)} AS DECIMAL(38,0))"
    s = 10 ** digits
    return (f"CASE WHEN {d} IS NULL OR {d} = 0 THEN CAST(NULL AS DOUBLE) ELSE "
            f"signum({n}) * signum({d}) * CAST(((2 * {s} * abs({n}) + abs({d})) div (2 * abs({d}))) AS DOUBLE)"
            f" / {s}.0D END")


def round_ratio(num: str, den: str, digits: int = 2) -> Column:
    """ROUND(num / den, digits), exact, half away from zero, returned as double.

    ``num`` and ``den`` are integral; products are DECIMAL(38,0), exact below 10**38.  With s = 10**digits the rounded quotient
    is ``sign * ((2*s*|num| + |den|) div (2*|den|)) / s``; only the final step
    divides in floating point, so the result is the double nearest to the
    exactly rounded decimal.  NULL or zero denominator gives NULL (the NULLIF
    guard of the original queries).
    """
    return F.expr(round_ratio_sql(num, den, digits))


def round_diff_of_ratios(num_a: str, den_a: str, num_b: str, den_b: str,
                         digits: int = 2) -> Column:
    """ROUND(COALESCE(num_a/den_a - num_b/den_b, 0), digits), exact.

    The difference is formed as one fraction (na*db - nb*da) / (da*db) so there
    is a single rounding.  If either side is undefined (NULL or zero
    denominator) the result is 0, as with the COALESCE of the original.
    """
    na, da, nb, db = (f"CAST({q(c)} AS DECIMAL(38,0))" for c in (num_a, den_a, num_b, den_b))
    undefined = (f"{da} IS NULL OR {da} = 0 OR {db} IS NULL OR {db} = 0 "
                 f"OR {na} IS NULL OR {nb} IS NULL")
    diff = round_ratio_sql(f"{na} * {db} - {nb} * {da}", f"{da} * {db}", digits)
    return F.expr(f"CASE WHEN {undefined} THEN 0.0D ELSE {diff} END")


# ---------------------------------------------------------------------------
# Names, dates and clock text
# ---------------------------------------------------------------------------

def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """``first || ' ' || last``; NULL if either part is NULL (unlike concat_ws)."""
    return F.expr(f"concat({q(first)}, ' ', {q(last)})")


def clock_mmss(seconds: str) -> Column:
    """Seconds as ``MI:SS`` text: minutes within the hour, so 3600 gives ``00:00``.

    NULL stays NULL.  Pure integer arithmetic, independent of the session zone.
    """
    s = f"CAST({q(seconds)} AS BIGINT)"
    return F.expr(f"CASE WHEN {s} IS NULL THEN CAST(NULL AS STRING) "
                  f"ELSE format_string('%02d:%02d', pmod({s} div 60, 60), pmod({s}, 60)) END")


def iso_timestamp(ts: str) -> Column:
    """ISO-8601 text of a timestamp without zone, ``yyyy-MM-ddTHH:mm:ss[.ffffff]``.

    The fraction is printed only when it is not zero, as Python's isoformat does.
    """
    t = q(ts)
    whole = f"date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    frac = f"date_format({t}, 'SSSSSS')"
    return F.expr(f"CASE WHEN {frac} = '000000' THEN {whole} ELSE concat({whole}, '.', {frac}) END")


# ---------------------------------------------------------------------------
# Difficulty colour buckets and event titles
# ---------------------------------------------------------------------------

# Threshold -> colour, checked from the highest threshold down;
# the first threshold the difficulty reaches wins, anything below all of them
# gets the default colour.
SCOUT_LEVELS = [(10, "purple"), (5, "red"), (0, "#d4af37"), (-5, "#228b22"), (-10, "#006400")]
COACH_LEVELS = [(5, "purple"), (2.5, "red"), (0, "#d4af37"), (-2.5, "#228b22"), (-5, "#006400")]
DEFAULT_COLOUR = "#006400"


def colour_bucket(value: str, levels=SCOUT_LEVELS, default: str = DEFAULT_COLOUR) -> Column:
    """First colour whose threshold ``value`` reaches, else ``default``."""
    whens = " ".join(f"WHEN {q(value)} >= {t} THEN '{c}'" for t, c in levels)
    return F.expr(f"CASE {whens} ELSE '{default}' END")


def py_text_sql(c: str) -> str:
    """Text of a value as Python's str() prints it: NULL becomes ``None``."""
    return f"coalesce(CAST({q(c)} AS STRING), 'None')"


def event_title(home: str, away: str, diff: str) -> Column:
    """``"{home} vs {away} (Diff: {diff})"``."""
    return F.expr(f"concat({py_text_sql(home)}, ' vs ', {py_text_sql(away)}, "
                  f"' (Diff: ', {py_text_sql(diff)}, ')')")
