"""Typed JSON ingest, key checks and table sinks (the batch load of the model).

* ``read_json``     JSON source with an explicit source-case schema (SRC-1)
* ``lower_names``   lower-case every column name (SRC-2)
* ``conform``       cast to the typed table, parsing timestamps (SRC-3, SRC-4)
* ``sort_out``      good rows and bad ones with file, position and reason (SRC-4, SRC-7)
* ``load_table`` / ``load_tables``  the multi-table load with a status row per
                    table and optional per-table failure isolation (SRC-7, Q-19)
* ``replace_table`` replace a stored table in one step (SRC-5, SNK-1)
* ``temp_table``    session view of an intermediate (SNK-2)
* ``empty_table``   typed empty table for an absent optional source (SNK-3)

Files are JSON Lines (one object, or one array of objects, per line) or arrays.
``read_json`` splits them by line; a pretty-printed array is one task there with
``multi_line=True``.  ``sort_out`` splits both layouts into byte ranges
(``json_records``).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from courtline.operators.quality import key_violations
from courtline.sources import json_records, schemas, versions


def read_json(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False,
              mode: str = "FAILFAST") -> DataFrame:
    """Read JSON with ``schema`` (source-case field names); malformed records fail by default."""
    return (spark.read.schema(schema)
                 .option("mode", mode)
                 .option("multiLine", multi_line)
                 .json(path))


def lower_names(df: DataFrame) -> DataFrame:
    """Every column name in lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def conform(df: DataFrame, target: StructType, ts_format: str = schemas.TIMESTAMP_FORMAT) -> DataFrame:
    """Select the ``target`` columns in order, cast to the target types.

    Text timestamps are parsed with ``ts_format``; fractional numbers bound for
    an integer column (``1612709929.0``) are cast exactly when integral and
    rejected otherwise, as the database would.
    """
    cols = []
    for field in target.fields:
        c = F.col(field.name)
        src_type = df.schema[field.name].dataType
        if isinstance(field.dataType, TimestampNTZType) and src_type.simpleString() == "string":
            c = F.to_timestamp_ntz(c, F.lit(ts_format))
        elif isinstance(field.dataType, LongType) and src_type.simpleString() == "double":
            c = F.when(c.isNull() | (c == F.floor(c)), c.cast("long")).otherwise(
                F.raise_error(F.concat(F.lit(f"{field.name}: not an integer: "), c.cast("string"))))
        cols.append(c.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """A typed table with no rows (for an absent optional source)."""
    return spark.createDataFrame([], schema)


def load_table(spark: SparkSession, name: str, path: str, multi_line: bool = False) -> DataFrame:
    """One model table from its JSON source: read, lower-case, conform."""
    raw = read_json(spark, path, schemas.SOURCE[name], multi_line=multi_line)
    return conform(lower_names(raw), schemas.TARGET[name])


#: what a row of a sorted-out load holds besides the table's columns; all NULL for a good row
BAD_FIELDS = [StructField("__file", StringType()), StructField("__position", LongType()),
              StructField("__record", StringType()), StructField("__reason", StringType())]
CUT_OFF, WRONG_TYPE = "not a complete object", "not an object of the table's types"


def _checked(field: StructField, src_type: str) -> tuple[Column, Column]:
    """(value or NULL, whether the source value is one that the type does not take)."""
    c = F.col(field.name)
    if isinstance(field.dataType, TimestampNTZType) and src_type == "string":
        value = F.when(c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), c.try_cast(field.dataType))
    elif isinstance(field.dataType, LongType) and src_type == "double":
        value = F.when(c == F.floor(c), c.try_cast("long"))
    else:
        value = c.try_cast(field.dataType)
    return value, c.isNotNull() & value.isNull()


def sort_out(spark: SparkSession, name: str, path: str, layout: str = "auto") -> DataFrame:
    """Every record of a table's JSON source: the typed columns, then file, position, record and reason if it is bad.

    A record is bad if it is no complete JSON object, if a value has not the
    type of the source schema, or if it does not fit the table's type
    (timestamps as ``schemas.TIMESTAMP_FORMAT``, whole numbers written with a
    fraction).  Its columns are NULL; nothing is dropped.
    """
    target = schemas.TARGET[name]
    source = StructType(schemas.SOURCE[name].fields + [StructField("__corrupt", StringType())])
    records = json_records.read_records(spark, path, layout)
    parsed = records.withColumn("r", F.from_json("record", source, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    rows = parsed.select("file", "position", "record", "complete", F.col("r.__corrupt").isNotNull().alias("corrupt"),
                         F.col("r").isNull().alias("none"),
                         *[F.col(f"r.{f}").alias(f"__src_{f.lower()}") for f in schemas.SOURCE[name].names])
    kinds = {f.name.lower(): f.dataType.simpleString() for f in schemas.SOURCE[name].fields}
    values, faults = {}, []
    for field in target.fields:
        value, wrong = _checked(StructField(f"__src_{field.name}", field.dataType), kinds[field.name])
        values[field.name] = value
        faults.append(F.when(wrong, F.lit(f"{field.name}: not a value of the table's type")))
    reason = F.coalesce(F.when(~F.col("complete"), F.lit(CUT_OFF)),
                        F.when(F.col("corrupt") | F.col("none"), F.lit(WRONG_TYPE)), *faults)
    rows = rows.withColumn("__reason", reason)
    bad = F.col("__reason").isNotNull()
    return rows.select(*[F.when(~bad, v).alias(n) for n, v in values.items()],
                       F.when(bad, F.col("file")).alias("__file"), F.when(bad, F.col("position")).alias("__position"),
                       F.when(bad, F.col("record")).alias("__record"), "__reason")


def good_rows(sorted_out: DataFrame, name: str) -> DataFrame:
    return sorted_out.where(F.col("__reason").isNull()).select(*schemas.TARGET[name].names)


def bad_rows(sorted_out: DataFrame) -> DataFrame:
    """file, position (byte offset), record, reason of the rows that a load set aside."""
    return sorted_out.where(F.col("__reason").isNotNull()).select(
        *[F.col(f"__{c}").alias(c) for c in ("file", "position", "record", "reason")])


def replace_table(df: DataFrame, path: str) -> str:
    """Replace the stored table at ``path`` by ``df`` in one step; returns the new version's folder."""
    return versions.replace(df, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the stored table at ``path``, or of a version's folder."""
    if versions.latest(spark, path) is None:
        return spark.read.parquet(path)
    return versions.read(spark, path)


def temp_table(df: DataFrame, name: str) -> DataFrame:
    """Register ``df`` as a session view ``name`` (the temporary table)."""
    df.createOrReplaceTempView(name)
    return df


def _check_keys(df: DataFrame, name: str, out_dir: str | None) -> None:
    """Raise if ``df`` violates its primary key; all violations are stored when there is a place for them."""
    bad = key_violations(df, schemas.KEYS[name])
    total = bad.count()
    if not total:
        return
    where = ""
    if out_dir:
        place = os.path.join(out_dir, "_violations", name)
        replace_table(bad, place)
        where = f"; all of them in {place}"
    first = [tuple(r) for r in bad.orderBy(*bad.columns).limit(3).collect()]
    raise ValueError(f"primary key {schemas.KEYS[name]} violated by {total} keys, the first being {first}{where}")


STATUS_SCHEMA = "table string, rows long, quarantined long, version long, state string, error string"


def _stored_schema(name: str) -> StructType:
    return StructType(schemas.TARGET[name].fields + BAD_FIELDS)


def stored_rows(spark: SparkSession, out_dir: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a table that ``load_tables`` stored (the newest version by default)."""
    return good_rows(versions.read(spark, os.path.join(out_dir, name), version, _stored_schema(name)), name)


def quarantine(spark: SparkSession, out_dir: str, name: str, version: int | None = None) -> DataFrame:
    """file, position, record, reason: what that version's load set aside."""
    return bad_rows(versions.read(spark, os.path.join(out_dir, name), version, _stored_schema(name)))


def load_tables(spark: SparkSession, data_dir: str, out_dir: str | None = None,
                tables: list[str] | None = None, skip_failed: bool = False,
                check_keys: bool = True, multi_line: bool = False, set_aside: bool = False,
                layout: str = "auto"):
    """Load the model tables from ``data_dir`` (files named as in ``schemas.FILES``).

    Returns ``(frames, status)``: a dict of typed DataFrames (of the stored
    tables when ``out_dir`` is given, so later queries scan Parquet) and a status
    DataFrame: table, rows, quarantined, version, state, error.

    With ``set_aside`` bad records do not fail the load: the good rows go on and
    the bad ones are stored in the same version, with file, position and reason
    (``quarantine``).  Otherwise the first bad record fails its table.

    A table is staged as a version that nobody reads, its keys are checked there,
    and only then is it committed (``versions``).  Duplicate or NULL primary keys
    are failures; all violating keys with their counts go to
    ``out_dir/_violations/<table>`` and their number into the status.  The first
    failure raises; with ``skip_failed`` the load goes on with the other
    tables.  A table that failed keeps the rows of its last good load (state
    ``kept``) and is empty if there was none (state ``empty``).
    """
    names = tables or list(schemas.FILES)
    frames: dict[str, DataFrame] = {}
    status: list[tuple] = []
    for name in names:
        path = os.path.join(data_dir, schemas.FILES[name])
        target = os.path.join(out_dir, name) if out_dir else None
        version, error = None, None
        try:
            if set_aside:
                loaded = sort_out(spark, name, path, layout)
            else:
                typed = load_table(spark, name, path, multi_line=multi_line)
                loaded = typed.select(*typed.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in BAD_FIELDS])
            if target:
                folder = versions.stage(loaded, target)
                loaded = spark.read.schema(_stored_schema(name)).parquet(folder)
            df = good_rows(loaded, name)
            if check_keys:
                _check_keys(df, name, out_dir)
            bad = F.count("__reason")
            counts = loaded.agg((F.count(F.lit(1)) - bad).alias("rows"), bad.alias("bad")).first()
            rows, quarantined, state = counts["rows"], counts["bad"], "loaded"
            if target:
                version = versions.commit(spark, target, folder, rows)
        except Exception as exc:  # noqa: BLE001 - reported per table when skipping
            if not skip_failed:
                raise
            error = f"{type(exc).__name__}: {exc}"
            last = versions.latest(spark, target) if target else None
            if last:
                df, rows, version = stored_rows(spark, out_dir, name), last["rows"], last["version"]
                quarantined, state = quarantine(spark, out_dir, name).count(), "kept"
            else:
                df = empty_table(spark, schemas.TARGET[name])
                rows, quarantined, state = 0, 0, "empty"
        frames[name] = df
        status.append((name, rows, quarantined, version, state, error))
    return frames, spark.createDataFrame(status, STATUS_SCHEMA)
