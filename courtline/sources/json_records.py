"""Splittable reader of the objects of JSON files, with the place of each (SRC-1).

The layouts are ``array`` (a file is one array of objects, printed on one line
or over many) and ``lines`` (one object a line).  Spark's text source cuts the
files into byte ranges, whichever store they are in; here its separator is the
closing brace for arrays, so an object ends where a fragment ends.

Whether a brace is text or structure depends on everything before it.  A first
pass reads each range once and says what it does to the reader's state (inside
a string or not, and how many objects are open) for both possible beginnings.
These summaries, one row per range, are chained per file, which gives the true
state and byte offset at each range's start.  Lines need the offsets only, so
their first pass sums lengths.  The second pass cuts the records.
A record that runs over the end of a range is put together from its pieces, at
most two per range and file.

Rows: file, position (byte offset of the record's first byte), record (its
text) and complete.  What is no complete object (text between objects, a record
that the end of its file or line cuts off) comes as a row that is not complete, so nothing
is lost.  JSON has no line break inside a string: a string left open
ends with its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtline.session import ship_sources

RECORD_SCHEMA = "file string, position long, record string, complete boolean"
_CLOSED = re.compile(rb'"(?:[^"\\\n]|\\.)*["\n]', re.S)
_REST_OF_STRING = re.compile(rb'(?:[^"\\\n]|\\.)*(["\n])?', re.S)
_BETWEEN = re.compile(rb"(?:\xef\xbb\xbf)?[\s,\[\]]*")
_LOWEST = -(1 << 60)


def scan(text: bytes, inside: bool) -> tuple[int, bool]:
    """(opening braces outside strings, whether the text ends inside a string)."""
    if inside:
        m = _REST_OF_STRING.match(text)
        if m.group(1) is None:
            return 0, True
        text = text[m.end():]
    if b'"' in text:
        text = _CLOSED.sub(b" ", text)
        at = text.find(b'"')
        if at >= 0:
            return text.count(b"{", 0, at), True
    return text.count(b"{"), False


@dataclass
class Effect:
    """What a run of fragments does to the number of open objects: d becomes max(d + add, least)."""

    inside: bool
    add: int = 0
    least: int = _LOWEST

    def fragment(self, text: bytes, ended: bool) -> None:
        opens, self.inside = scan(text, self.inside)
        close = int(ended and not self.inside)
        self.add += opens - close
        self.least = max(self.least + opens - close, 0)


def _fragments(spark: SparkSession, path: str, layout: str) -> DataFrame:
    text = spark.read.option("lineSep", "}" if layout == "array" else "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("_metadata.file_size").alias("size"), "value")


def layout_of(spark: SparkSession, path: str) -> str:
    """``array`` if the first character of the files is a bracket, else ``lines``."""
    head = (_fragments(spark, path, "array")
            .select(F.substring(F.ltrim(F.regexp_replace(F.substring("value", 1, 4096), r"^[\s\x{FEFF}]+", "")), 1, 1)
                    .alias("c")).filter("c <> ''").first())
    return "array" if head is None or head["c"] == "[" else "lines"


def _summaries(fragments: DataFrame) -> DataFrame:
    """One row per range: bytes, and the effect on the state for both beginnings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, effects = None, 0, ()

        def row() -> pa.RecordBatch:
            out, into = effects
            return pa.RecordBatch.from_pylist([{
                "file": key[0], "start": key[1], "size": key[2], "bytes": n, "end0": out.inside, "add0": out.add,
                "least0": out.least, "end1": into.inside, "add1": into.add, "least1": into.least}])
        for b in batches:
            values = b.column(3).cast(pa.binary())
            for file, start, size, v in zip(*(b.column(i).to_pylist() for i in range(3)), values.to_pylist()):
                if (file, start, size) != key:
                    if key:
                        yield row()
                    key, n, effects = (file, start, size), 0, (Effect(False), Effect(True))
                n += len(v) + 1
                for e in effects:
                    e.fragment(v, True)
        if key:
            yield row()
    return fragments.mapInArrow(run, "file string, start long, size long, bytes long, end0 boolean, add0 long, "
                                     "least0 long, end1 boolean, add1 long, least1 long")


def _sizes(fragments: DataFrame) -> DataFrame:
    """``_summaries`` where an end of line is structure wherever it stands: bytes only, and no state."""
    none = [F.lit(v).alias(f"{n}{k}") for k in (0, 1) for n, v in (("end", False), ("add", 0), ("least", 0))]
    return (fragments.groupBy("file", "start", "size")
            .agg(F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("bytes"))
            .select("file", "start", "size", "bytes", *none))


def _starts(summaries: list) -> dict[tuple[str, int], tuple[int, bool, int, bool, int]]:
    """(file, start) -> byte offset, inside a string, open objects, last range of the file, its end."""
    out: dict = {}
    rows = sorted(summaries, key=lambda r: (r["file"], r["start"]))
    offset, inside, depth = 0, False, 0
    for i, r in enumerate(rows):
        if i == 0 or rows[i - 1]["file"] != r["file"]:
            offset, inside, depth = 0, False, 0
        last = i + 1 == len(rows) or rows[i + 1]["file"] != r["file"]
        out[r["file"], r["start"]] = (offset, inside, depth, last, offset + r["bytes"])
        k = int(inside)
        depth = max(depth + r[f"add{k}"], r[f"least{k}"])
        inside = r[f"end{k}"]
        offset += r["bytes"]
    return out


def _array_records(fragments: DataFrame, starts) -> DataFrame:
    """Rows of records, and of pieces of records that cross a range's end (kind 0: whole, 1: head, 2: tail)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, inside, depth, last, end, size = None, 0, False, 0, False, 0, 0
        held: list[bytes] = []       # the open record
        began = 0                    # its place
        foreign = False              # it began in an earlier range
        rows: list[tuple] = []

        def emit(position: int, record: bytes, complete: bool, kind: int) -> None:
            rows.append((key[0], key[1], position, record.decode("utf-8", "replace"), complete, kind))

        def finish() -> None:
            """The range is over; what is open goes on in the next one, if the file does."""
            if held or foreign:
                text = b"".join(held)
                if last and not foreign:
                    emit(began, text, False, 0)
                else:
                    emit(began, text, not last, 1 if foreign and last else 2 if not foreign else 3)

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 names=["file", "start", "position", "record", "complete", "kind"])
                rows.clear()

        for b in batches:
            files, begins, sizes = (b.column(i).to_pylist() for i in range(3))
            for file, start, whole, v in zip(files, begins, sizes, b.column(3).cast(pa.binary()).to_pylist()):
                if (file, start) != key:
                    if key:
                        finish()
                    key, size = (file, start), whole
                    at, inside, depth, last, end = starts.value[key]
                    held, began, foreign = [], at, inside or depth > 0
                # the separator after the file's last fragment is there only if the sizes say so
                ended = True
                if last and at + len(v) + 1 == end:
                    # (a compressed file's size says nothing: then an open record counts as closed)
                    ended = end == size or (end != size + 1 and bool(held or foreign or b"{" in v))
                text = v + b"}" if ended else v
                opens, inside = scan(v, inside)
                close = int(ended and not inside)
                if held or foreign:
                    held.append(text)
                else:
                    brace = v.find(b"{")
                    between = v if brace < 0 else v[:brace]
                    if opens and _BETWEEN.fullmatch(between):
                        held, began = [text[brace:]], at + brace
                    elif opens:
                        held, began = [text], at
                    elif not _BETWEEN.fullmatch(text):
                        emit(at, text, False, 0)
                depth = max(depth + opens - close, 0)
                if depth == 0 and not inside and (held or foreign):
                    record = b"".join(held)
                    emit(began, record, not foreign and record[:1] == b"{", 1 if foreign else 0)
                    held, foreign = [], False
                at += len(v) + 1
            yield from out()
        if key:
            finish()
        yield from out()
    return fragments.mapInArrow(run, "file string, start long, position long, record string, complete boolean, kind int")


def _put_together(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: a tail (2) of one range, middles (3) and the head (1) of a later one."""
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == 2, 1).otherwise(0))
    grouped = pieces.withColumn("first", F.last(F.when(F.col("kind") == 2, F.col("position")), ignorenulls=True)
                                .over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = grouped.groupBy("file", F.col("first").alias("position")).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"),
        F.max(F.when(F.col("kind") == 1, F.col("record"))).alias("head"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "")
    # its last piece closes it, unless the file ended first
    return whole.select("file", "position", text.alias("record"),
                        (F.endswith(F.coalesce("head", F.lit("")), F.lit("}")) & F.startswith(text, F.lit("{")))
                        .alias("complete"))


_SPACE = " \t\n\r\x0b\x0c"


def _line_records(fragments: DataFrame, starts) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            file, begin, line = b.column(0), b.column(1), b.column(3)
            ends = np.cumsum(pc.binary_length(line).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at_line = np.concatenate([[0], ends[:-1]])            # offsets in the batch, then in the file
            new = np.flatnonzero(pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(begin[1:], begin[:-1]))
                                 .to_numpy(zero_copy_only=False)) + 1
            stops = [*new.tolist(), b.num_rows]
            for a, z in zip([0, *stops], stops):
                here = file[a].as_py(), begin[a].as_py()
                if here != key:
                    key, at = here, starts.value[here][0]
                size = int(ends[z - 1] - at_line[a])
                at_line[a:z] += at - int(at_line[a])
                at += size
            try:
                line.validate(full=True)
                left = pc.ascii_ltrim(line, characters=_SPACE)
            except pa.ArrowInvalid:                               # bytes that are no UTF-8
                raw = [v.lstrip() for v in line.cast(pa.binary()).to_pylist()]
                lead = pc.subtract(pc.binary_length(line), pa.array([len(v) for v in raw], pa.int32()))
                left = pa.array([v.decode("utf-8", "replace") for v in raw], pa.string())
            else:
                lead = pc.subtract(pc.binary_length(line), pc.binary_length(left))
            text = pc.ascii_rtrim(left, characters=_SPACE)
            rows = pa.RecordBatch.from_arrays(
                [file, pa.array(at_line + lead.to_numpy(zero_copy_only=False)), text,
                 pc.and_(pc.starts_with(text, "{"), pc.ends_with(text, "}"))],
                names=["file", "position", "record", "complete"])
            yield rows.filter(pc.greater(pc.binary_length(text), 0))
    return fragments.mapInArrow(run, RECORD_SCHEMA)


def read_records(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """file, position, record, complete: the objects of the JSON files at ``path``, and what is none.

    The summaries (one row of ten numbers per byte range of the text source)
    go through the driver: some 200,000 rows for 100 TB in ranges of 512 MB.
    """
    ship_sources(spark)
    if layout == "auto":
        layout = layout_of(spark, path)
    fragments = _fragments(spark, path, layout)
    summaries = _summaries(fragments) if layout == "array" else _sizes(fragments)
    starts = spark.sparkContext.broadcast(_starts(summaries.collect()))
    if layout == "lines":
        return _line_records(fragments, starts)
    parts = _array_records(fragments, starts)
    whole = parts.filter("kind = 0").select("file", "position", "record", "complete")
    return whole.unionByName(_put_together(parts.filter("kind > 0")))


def write_array(df: DataFrame, path: str) -> None:
    """Write ``df`` as JSON files of one pretty-printed array each, one file per partition."""
    ship_sources(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in batches:
            lines = []
            for v in b.column(0).to_pylist():
                lines.append(before + "\n" + v)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[", "]"] if before == "[" else ["]"])], names=["value"])
    text = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}))
    text.mapInArrow(run, "value string").write.text(path)
