"""Repeated substrings of at least ``MIN_MATCH`` bytes, found by sampled suffixes and their names.

The steps follow the difference-cover construction of a suffix array: sort
sampled tuples, name them, recurse where names do not decide, place the other
suffixes by their distance to a sampled one, and compare equal prefixes.  The
cover, however, is chosen by content and not modulo three: the sampled position
of a suffix is the place of the least hash of a 32-byte tuple within its first
400 bytes.  Like a difference cover, it makes two suffixes that agree on 400
bytes meet in sampled positions at the same distance; unlike it, it samples one
position in 140 and not two in three.  Sorting triples at two positions in three
shuffles five times the text (measured, compressed) before any recursion, for
orders that a 400-byte question never asks for.

1. Every suffix with 400 bytes left in its document has a sampled position at
   some distance d.  A sampled position's suffixes are cut into pieces of
   ``SPAN`` neighbouring distances.  A piece has a core, the bytes that all its
   400-byte prefixes share, and a frame, the bytes that any of them covers;
   core and frame are named by hashes.
2. Cores that occur once are dropped: their suffixes repeat nowhere.  Frames
   that occur twice or more settle their piece: all its prefixes repeat.
3. Frames that occur once beside other frames of the same core are not settled
   by names.  One piece per frame goes on: its 400-byte prefixes are named one by
   one by 128-bit hashes, and equal ones are counted.
4. Starts of repeated prefixes are runs; their 400-byte spans are united per
   text and cut out.

All counting is by aggregation, so a passage in a third of all documents is
merged before it moves.  Texts that occur more than once are cut once.

Defined results: null counts as empty; texts under 400 bytes have no matches;
repeated rows are copies, so their texts of 400 bytes or more go whole; an empty
table gives an empty result; null doc_ids stay null; extra columns play no part.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm.common import ship, stored

MIN_MATCH = 400
TUPLE = 32             # bytes whose hash picks a sampled position
SPAN = 100             # distances of a piece; divides MIN_MATCH
_SLAB = 1 << 17        # suffixes looked at together
_PIECES = 1 << 15      # pieces after which a batch of documents ends
_NAMES = 1 << 16       # prefixes named in one batch, whatever their texts' lengths
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if n not in _POWERS:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[n] = tuple(both)
    return _POWERS[n]


def _slab_samples(s: np.ndarray, match: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a slab, with the first and the last suffix that each one serves."""
    up, down = _powers(_SLAB + match)
    n, width = len(s), match - k + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(s.astype(np.uint64) * up[:n], out=total[1:])
    h = (total[k:] - total[:-k]) * down[:n - k + 1]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    m = len(h)
    key = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)      # least hash, then leftmost
    blocks = np.full(-(-m // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:m] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - match + 1
    place = (np.minimum(behind[:count], ahead[width - 1:width - 1 + count]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.concatenate((first[1:], [count])) - 1


def samples(text: bytes, match: int = MIN_MATCH, k: int = TUPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a whole text, each with the first and last suffix it serves."""
    s = np.frombuffer(text, np.uint8)
    count = len(s) - match + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    parts = []
    for a in range(0, count, _SLAB):
        z = min(count, a + _SLAB)
        parts.append([x + a for x in _slab_samples(s[a:z + match - 1], match, k)])
    place, first, last = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:                       # a position served from both sides of a slab's edge
        new = np.concatenate(([True], place[1:] != place[:-1]))
        at = np.flatnonzero(new)
        place, first = place[at], first[at]
        last = last[np.concatenate((at[1:], [len(new)])) - 1]
    return place, first, last


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def text_pieces(text: bytes, match: int = MIN_MATCH, span: int = SPAN) -> tuple[list, list, list, list]:
    """Core names, frame names, core starts and distance ranges (low * span + high) of a text's pieces."""
    digest = xxhash.xxh3_64_intdigest
    cores, frames, starts, ranges = [], [], [], []
    for p, lo, hi in zip(*(x.tolist() for x in samples(text, match))):
        for j in range((p - hi) // span, (p - lo) // span + 1):
            c = p - j * span
            left = max(0, c - span + 1)
            cores.append(_signed(digest(text[c:c + match + 1 - span], j)))   # pieces of other distances never meet
            frames.append(_signed(digest(text[left:c + match], c - left)))
            starts.append(c)
            ranges.append(max(0, p - hi - j * span) * span + min(span - 1, p - lo - j * span))
    return cores, frames, starts, ranges


def piece_batches(batch: pa.RecordBatch, match: int = MIN_MATCH, span: int = SPAN) -> Iterator[pa.RecordBatch]:
    """The rows of ``pieces`` for a batch of rid, doc_id and text, in batches that end at 256 texts or ``_PIECES`` pieces."""
    texts = batch.column(2).cast(pa.binary())
    done = 0
    while done < batch.num_rows:
        shas, sizes, ends = [], [], [0]
        lists: tuple[list, ...] = ([], [], [], [])
        while done + len(shas) < batch.num_rows and len(shas) < 256 and ends[-1] < _PIECES:
            text = texts[done + len(shas)].as_py() or b""
            shas.append(hashlib.sha256(text).digest())
            sizes.append(len(text))
            for all_, mine in zip(lists, text_pieces(text, match, span)):
                all_.extend(mine)
            ends.append(len(lists[0]))
        b = batch.slice(done, len(shas))
        done += len(shas)
        at = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()),
             *[pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in zip(
                 lists, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]],
            names=["rid", "doc_id", "sha", "n_bytes", "core", "frame", "start", "range"])


def pieces(docs: DataFrame, match: int = MIN_MATCH, span: int = SPAN) -> DataFrame:
    """One row per document: rid, doc_id, sha, n_bytes and its pieces as arrays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"rid long, doc_id {kind}, sha binary, n_bytes long, "
              "core array<long>, frame array<long>, start array<long>, range array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from piece_batches(b, match, span)
    return (docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
            .mapInArrow(run, schema))


def packed_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, sha and compressed text for a batch of doc_id and text, 256 rows at once."""
    compress = zstandard.ZstdCompressor(level=1).compress
    texts = batch.column(1).cast(pa.binary())
    for a in range(0, batch.num_rows, 256):
        shas, packed = [], []
        for text in texts.slice(a, 256):
            text = text.as_py() or b""
            shas.append(hashlib.sha256(text).digest())
            packed.append(compress(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(a, 256), pa.array(shas, pa.binary()), pa.array(packed, pa.binary())],
            names=["__d", "__s", "packed"])


def _with_text(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (sha, any_id, ...) joined to one row of ``docs`` with that text, compressed for the shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from packed_batches(b)
    source = docs.select("doc_id", "text").mapInArrow(run, f"__d {kind}, __s binary, packed binary")
    return wanted.join(source, (F.col("sha") == F.col("__s")) & F.col("any_id").eqNullSafe(F.col("__d")))


def name_batches(batch: pa.RecordBatch, match: int = MIN_MATCH, span: int = SPAN) -> Iterator[pa.RecordBatch]:
    """The rows of ``prefix_names`` for a batch of packed texts and their wanted pieces, ``_NAMES`` or few more at once."""
    unpack = zstandard.ZstdDecompressor().decompress
    digest = xxhash.xxh3_128_digest
    asked = batch.column(1).flatten()
    rid, start, ranges, opens = (asked.field(x).to_numpy(zero_copy_only=False)
                                 for x in ("rid", "start", "range", "open"))
    low, high = np.divmod(ranges.astype(np.int64), span)
    first, count = start - high, high - low + 1

    def rows(a: int, z: int, names: bytearray) -> pa.RecordBatch:
        n = count[a:z]
        both = np.frombuffer(names, "<i8").reshape(-1, 2)
        starts = np.repeat(first[a:z] - (np.cumsum(n) - n), n) + np.arange(len(both))
        return pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.repeat(rid[a:z], n)),
             pa.array(starts), pa.array(np.repeat(opens[a:z], n))], names=["h1", "h2", "rid", "start", "open"])

    done, names = 0, bytearray()             # pieces given out; names of those after them
    ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).tolist()
    for packed, a, z in zip(batch.column(0), [0, *ends], ends):
        text = unpack(packed.as_py())
        for piece in range(a, z):
            i = int(first[piece])
            for j in range(i, i + int(count[piece])):
                names += digest(text[j:j + match])
            if len(names) >= 16 * _NAMES:
                yield rows(done, piece + 1, names)
                done, names = piece + 1, bytearray()
    if names:
        yield rows(done, ends[-1], names)


def prefix_names(wanted: DataFrame, docs: DataFrame, match: int, span: int) -> DataFrame:
    """(h1, h2, rid, start, open) for every 400-byte prefix of the wanted pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from name_batches(b, match, span)
    return (_with_text(wanted, docs).select("packed", "asked")
            .mapInArrow(run, "h1 long, h2 long, rid long, start long, open boolean"))


def cut(text: bytes, runs: list[tuple[int, int]], match: int = MIN_MATCH) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs, and SHA-256 of the rest, for runs of starts (first, count)."""
    kept, at, removed, spans, end = [], 0, 0, 0, -1
    for first, count in sorted(runs):
        z = first + count - 1 + match
        if first > end:
            kept.append(text[at:first])
            spans += 1
            removed += z - first
            end = at = z
        elif z > end:
            removed += z - end
            end = at = z
    kept.append(text[at:])
    return removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()


def _free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_starts(docs: DataFrame, rows: DataFrame, texts: DataFrame, match: int, span: int) -> DataFrame:
    """(rid, first, count): runs of starts whose 400-byte prefix starts elsewhere too."""
    spark = docs.sparkSession
    every = rows.select("rid", F.explode(F.arrays_zip("core", "frame", "start", "range")).alias("p")).select(
        "rid", "p.core", "p.frame", "p.start", "p.range")
    cores = stored(every.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("a"),
                                             F.max("frame").alias("b"))
                   .filter("n > 1").select("core", (F.col("a") != F.col("b")).alias("mixed")), "suffix-cores")
    alive = stored(every.join(cores, "core"), "suffix-alive")
    _free(spark)
    frames = stored(alive.groupBy("core", "frame", "mixed").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start", "range")).alias("one")), "suffix-frames")
    settled = (alive.join(frames.filter("n > 1").select("core", "frame"), ["core", "frame"])
               .select("rid", (F.col("start") - F.col("range") % span).alias("first"),
                       (F.col("range") % span - F.expr(f"range div {span}") + 1).cast("long").alias("count")))
    settled = stored(settled, "suffix-settled")
    asked = (frames.filter("mixed").select("one.*", (F.col("n") == 1).alias("open"))
             .join(rows.select("rid", "sha"), "rid")
             .groupBy("sha").agg(F.collect_list(F.struct("rid", "start", "range", "open")).alias("asked"))
             .join(texts.select("sha", "any_id"), "sha"))
    names = stored(prefix_names(stored(asked, "suffix-asked"), docs, match, span), "suffix-names")
    _free(spark)
    twice = stored(names.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open"))
                   .filter("n > 1 and open").select("h1", "h2"), "suffix-twice")
    single = (names.filter("open").join(twice, ["h1", "h2"])
              .select("rid", F.col("start").alias("first"), F.lit(1).cast("long").alias("count")))
    return settled.unionByName(single)


def remove_repeats(docs: DataFrame, match: int = MIN_MATCH, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    rows = stored(pieces(docs, match, span), "suffix-rows")
    # one row stands for all copies of a text
    texts = stored(rows.groupBy("sha").agg(F.min("rid").alias("rid"), F.min_by("doc_id", "rid").alias("any_id")),
                   "suffix-texts")
    starts = repeated_starts(docs, rows, texts, match, span)
    runs = (starts.join(texts, "rid").groupBy("sha", "any_id")
            .agg(F.collect_list(F.struct("first", "count")).alias("runs")))
    runs = stored(runs, "suffix-runs")
    _free(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            got = [cut(unpack.decompress(p.as_py()), [(r["first"], r["count"]) for r in rs.as_py()], match)
                   for p, rs in zip(b.column(1), b.column(2))]
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.string())], names=["sha", "n_removed", "n_spans", "kept_sha256"])
    done = (_with_text(runs, docs).select("sha", "packed", "runs")
            .mapInArrow(run, "sha binary, n_removed long, n_spans long, kept_sha256 string")
            .dropDuplicates(["sha"]))
    done = stored(done, "suffix-done")
    return (rows.select("doc_id", "sha", "n_bytes").join(done, "sha", "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                    F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256")))
