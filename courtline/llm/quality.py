"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are the shapes of its words (letter case, digits and symbols in
runs), pairs of neighbouring shapes, shapes of repeated words, and its short
words.  Term weights are log counts times the inverse document frequency over
all documents.  Latent-semantic vectors come from the singular value
decomposition of the labelled sample's term matrix.

The sample holds at most ``MAX_PER_CLASS`` labelled rows of each label, those of
smallest id hash with crc32(doc_id as text) mod 3 != 1; the other fold is never
learned from.  Its vectors are broadcast (a fixed bound of rows and dimensions).
Every document's cosine to every sample vector is computed exactly, in blocks;
the ``NEIGHBOURS`` nearest vote with weight (similarity ** 4), each class scaled
to its share among the labelled rows of the learning folds.

Defined results: null, empty and term-free texts get the share of label 1; so
does every text if there are no labels; repeated rows get equal scores; extra
columns play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import ship

MAX_PER_CLASS = 2000
DIMENSIONS = 2048
RANK = 48
NEIGHBOURS = 25
BLOCK = 512
_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def _slot(kind: int, raw: bytes) -> int:
    return zlib.crc32(raw, kind) % DIMENSIONS


def _shapes(raw: bytes) -> list[bytes]:
    """The words of a text as shapes: runs of one kind of character become one."""
    kinds = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    first = np.ones(len(kinds), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    return kinds[first].tobytes().split()


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a text's terms, slots ascending."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    shapes = _shapes(raw)
    counts: Counter = Counter()
    for s, n in Counter(shapes).items():
        counts[_slot(1, s)] += n
    for (a, b), n in Counter(zip(shapes, shapes[1:])).items():
        counts[_slot(2, a + b" " + b)] += n
    again = sum(map(eq, words, words[1:]))
    if again:
        counts[_slot(3, b"again")] += again
    for w, n in Counter(words).items():
        if len(w) <= 4:
            counts[_slot(4, w)] += n
    slots = np.fromiter(sorted(counts), np.int64, len(counts))
    return slots, np.array([counts[s] for s in slots.tolist()], float)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each term slot, over all documents, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMENSIONS + 1, np.int64)      # the last counts documents
        for b in batches:
            for t in b.column(0):
                seen[term_counts(t.as_py())[0]] += 1
            seen[DIMENSIONS] += b.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])
    rows = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS)
    total = 0
    for r in rows:
        if r["slot"] == DIMENSIONS:
            total = r["n"]
        else:
            df[r["slot"]] = r["n"]
    return df, total


class VotingModel:
    """Term weights, the latent projection, and the sample's vectors and labels."""

    def __init__(self, idf, projection, vectors, labels, share):
        self.idf, self.projection, self.vectors = idf, projection, vectors
        self.labels, self.share = labels, share

    def terms(self, texts) -> np.ndarray:
        x = np.zeros((len(texts), DIMENSIONS), np.float32)
        for i, t in enumerate(texts):
            slots, counts = term_counts(t)
            x[i, slots] = np.log1p(counts) * self.idf[slots]
        return _unit(x)

    def scores(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        scale = np.where(self.labels == 1, self.share / max(self.labels.mean(), 1e-9),
                         (1 - self.share) / max(1 - self.labels.mean(), 1e-9))
        for a in range(0, len(texts), BLOCK):
            v = _unit(self.terms(texts[a:a + BLOCK]) @ self.projection)
            cosine = v @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0) ** 4 * scale[near]
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            some = total > 0
            out[a:a + BLOCK][some] = (vote[some] / total[some])
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> VotingModel:
    """Learn from a bounded sample; corpus frequencies come from all documents."""
    ship(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = labels.select("doc_id", "quality").dropna().filter(fold != 1).dropDuplicates(["doc_id"])
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    share = good / (good + bad) if good + bad else 0.5
    ids = [tuple(r) for value in (0, 1) for r in known.filter(F.col("quality") == value)
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class).collect()]
    empty = VotingModel(np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1)),
                        np.zeros(0), share)
    if not ids:
        return empty
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 0.1

    @F.pandas_udf("struct<s: array<int>, c: array<double>>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        got = [term_counts(t) for t in texts]
        return pd.DataFrame({"s": [g[0].tolist() for g in got], "c": [g[1].tolist() for g in got]})
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")
    got = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
           .select("doc_id", "quality", counted(F.col("text")).alias("t"))
           .groupBy("doc_id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("quality").alias("q")))
    rows = sorted(got.toLocalIterator(), key=lambda r: r["doc_id"])
    rows = [r for r in rows if r["t"]["s"]]
    if not rows:
        return empty
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        slots = np.array(r["t"]["s"], np.int64)
        x[i, slots] = np.log1p(np.array(r["t"]["c"])) * idf[slots]
    x = _unit(x)
    values, right = np.linalg.eigh((x.T @ x).astype(np.float64))     # right singular vectors of x
    projection = right[:, np.argsort(-values)[:RANK]].astype(np.float32)
    return VotingModel(idf, projection, _unit(x @ projection), np.array([r["q"] for r in rows], float), share)


def score(text: Column, spark, model: VotingModel) -> Column:
    shared = spark.sparkContext.broadcast(model)     # MAX_PER_CLASS * 2 vectors of RANK numbers at most

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))
    return run(text)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``."""
    model = fit(docs, labels)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return (docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
                        score(F.col("text"), docs.sparkSession, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
