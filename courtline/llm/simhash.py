"""SimHash near-dedup over a byte-position inverted index with count filtering.

A document's fingerprint has bit b set if more than half of its shingle hashes
have it set.  Two fingerprints link at ``max_bits`` or fewer differing bits.

``max_bits`` differing bits touch at most ``max_bits`` of the eight bytes, so
linked fingerprints share at least ``8 - max_bits`` positional bytes: the
guaranteed minimum of the count filter.  A posting list of the index is a
choice of byte positions with their values.  The choices form a family such
that every set of the guaranteed size contains one of them, so every link meets
in at least one posting list; lists of three bytes are 65,536 times shorter
than lists of one.  Pairs of a list are tallied (shared positional bytes),
those below the minimum fall out, and the rest are verified bit by bit, all
inside the join condition, so that only links leave the join, each from the
first list in which it meets.

Identical fingerprints are one node, whatever their number.  Components come
from large-star / small-star rounds.

Defined results: null or blank text has fingerprint zero and links like any
other; fewer words than the shingle length make one shingle of the whole
sequence; repeated rows share a node; a component's id is its smallest
doc_id (null only if all its doc_ids are null); extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import connected_components, ship, stored, unused

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
_GRAMS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as an unsigned integer."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _GRAMS_AT_ONCE):
        to = min(n, at + _GRAMS_AT_ONCE)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(
            starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist())], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = 0
    for b in np.flatnonzero(2 * ones > n).tolist():
        value |= 1 << b
    return value


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, sha): fp is the fingerprint's 64 bits as a signed long, sha the text's SHA-256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1).cast(pa.binary())]
            fps = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fps.view(np.int64)),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                ["doc_id", "fp", "sha"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, sha binary")


def posting_family(minimum: int) -> list[tuple[int, ...]]:
    """Choices of byte positions such that every ``minimum`` of the 8 bytes include one.

    For a minimum of four, Turan's construction gives 20 triples: the positions
    are dealt into three parts; taken are the triples inside a part and those
    with two positions in a part and one in the next.  For other minima the
    choices are all sets of that size.
    """
    if minimum != 4:
        return list(combinations(range(8), max(1, minimum)))
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        n = [sum(part[i] == p for i in t) for p in range(3)]
        if 3 in n or any(n[p] == 2 and n[(p + 1) % 3] == 1 for p in range(3)):
            out.append(t)
    return out


def _mask(positions) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): every pair of different fingerprints within ``max_bits`` bits, once."""
    minimum = 8 - max_bits
    if minimum < 1:
        raise ValueError("a byte index guarantees no shared byte beyond 7 bits")
    masks = [_mask(t) for t in posting_family(minimum)]
    index = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
        for i, m in enumerate(masks)])).alias("k")).select("fp", "k.list", "k.bytes")
    a = index.select("list", "bytes", F.col("fp").alias("u"))
    b = index.select("list", "bytes", F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    tally = sum((x.bitwiseAND(F.lit(_mask((i,)))) == 0).cast("int") for i in range(8))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return (a.join(b, (a["list"] == b["list"]) & (a["bytes"] == b["bytes"]) & (F.col("u") < F.col("v"))
                   & (tally >= minimum) & (F.bit_count(x) <= max_bits) & (first == a["list"]))
            .select("u", "v"))


def _grouped(docs: DataFrame, words_per_shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, fp, sha, component_id), one row per row of ``docs``."""
    ship(docs.sparkSession)
    rows = stored(fingerprints(docs, words_per_shingle), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    comp = connected_components(links(nodes, max_bits), "simhash-cc")
    label = nodes.join(comp, nodes["fp"] == comp["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id")
    best = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = stored(label.join(best, "root").select("fp", "root", "component_id"), "simhash-labels")
    return rows.join(label, "fp")


def near_groups(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS,
                max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of ``docs``."""
    return _grouped(docs, words_per_shingle, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each near-duplicate group: smallest doc_id, then smallest text hash.

    Rows equal in both doc_id and text are one document here (exact dedup, which
    comes before, leaves one of them).  Null doc_ids sort last.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "sha")
    id_, digest = unused(docs, "__d", "__s")
    keep = (_grouped(docs, words_per_shingle, max_bits).groupBy("root").agg(F.min(order).alias("k"))
            .select(F.col("k.doc_id").alias(id_), F.col("k.sha").alias(digest)))
    keep = stored(keep, "simhash-keep")
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (sha == F.col(digest)), "left_semi")
