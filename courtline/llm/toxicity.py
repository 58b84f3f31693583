"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct words and their first four, five and six
letters, hashed; a feature's value is log(1 + number of distinct words that
have it).  One weight vector is shared by all thresholds: with score s and
ordered thresholds t1 < t2 < ..., P(grade >= k) = sigmoid(s - t_k), and the
expected severity is the sum of these over k.

The model is fitted on at most ``MAX_PER_CLASS`` labelled rows of each label
(those of smallest id hash, a fixed sample), from the folds with
crc32(doc_id as text) mod 5 != 0; the rest is held out.  Labels tell toxic from
not toxic; a toxic row's grade 1 to 3 is the third of the toxic rows in which
the density of its label-bound words falls.  All documents are scored, whole.

Defined results: null or empty text has no features and gets the model's base
score; without labels of both kinds every text has severity 0; repeated rows
get equal scores; extra columns play no part.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import ship

MAX_PER_CLASS = 3000
HASH_BITS = 20
MIN_DOCS = 4          # a feature must occur in so many sampled texts
MAX_FEATURES = 2048   # the features most strongly bound to the label are fitted
GRADES = 4            # 0 to 3
_WORD = re.compile(r"\w+")
_CACHE_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    raw = word.encode("utf-8", "surrogatepass")
    mask = (1 << HASH_BITS) - 1
    out = [zlib.crc32(raw) & mask]
    for k in (4, 5, 6):
        if len(word) >= k:
            out.append(zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), k) & mask)
    return out


class OrdinalModel:
    """Chosen features, their shared weights and the ordered thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one column each."""
        z = np.clip(score[:, None] - self.thresholds[None, :], -60, 60)
        return 1 / (1 + np.exp(-z))


def _design(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, hashes in enumerate(rows):
        at = np.searchsorted(features, hashes)
        at[at == len(features)] = 0
        ok = features[at] == hashes if len(features) else np.zeros(len(hashes), bool)
        np.add.at(x[i], at[ok], 1)
    return np.log1p(x)


def choose_features(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features most bound to the label, ascending, with their z scores."""
    size = 1 << HASH_BITS
    seen = [np.zeros(size, np.int32), np.zeros(size, np.int32)]
    for hashes, label in zip(rows, toxic):
        seen[int(label)][np.unique(hashes)] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    total = seen[0] + seen[1]
    idx = np.flatnonzero(total >= MIN_DOCS)
    p1, p0, p = seen[1][idx] / n1, seen[0][idx] / n0, total[idx] / (n1 + n0)
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    best = np.argsort(-np.abs(z), kind="stable")[:MAX_FEATURES]
    order = best[np.argsort(idx[best])]
    return idx[order].astype(np.int64), z[order]


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, features: np.ndarray,
                    z: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic; 1 to 3 by thirds of the density of label-bound words."""
    strong = features[z > 0.5 * max(1.0, z.max(initial=0.0))]
    density = np.array([np.isin(h, strong).mean() if len(h) else 0.0 for h in rows])
    grades = np.zeros(len(rows), np.int64)
    mine = toxic == 1
    if mine.any():
        cuts = np.quantile(density[mine], [1 / 3, 2 / 3])
        grades[mine] = 1 + np.searchsorted(cuts, density[mine], side="left")
    return grades


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 400,
                rate: float = 0.05, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam on the whole sample."""
    n, m = x.shape
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    gaps = np.maximum(np.diff(first), 0.05)
    par = np.concatenate([np.zeros(m), first[:1], np.log(gaps)])
    m1, m2 = np.zeros_like(par), np.zeros_like(par)
    low, high = grades - 1, grades          # thresholds below and above a row's grade
    for step in range(1, steps + 1):
        w, t0, g = par[:m], par[m], np.exp(par[m + 1:])
        t = t0 + np.concatenate([[0.0], np.cumsum(g)])
        s = x @ w.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None, :], -30, 30)))
        above = np.where(low >= 0, p[np.arange(n), np.maximum(low, 0)], 1.0)
        over = np.where(high < n_grades - 1, p[np.arange(n), np.minimum(high, n_grades - 2)], 0.0)
        like = np.maximum(above - over, 1e-9)
        da, do = above * (1 - above) / like, over * (1 - over) / like
        da, do = np.where(low >= 0, da, 0.0), np.where(high < n_grades - 1, do, 0.0)
        ds = -(da - do) / n                 # derivative of the mean loss by the score
        dt = np.zeros(n_grades - 1)
        np.add.at(dt, np.maximum(low, 0), np.where(low >= 0, da, 0.0) / n)
        np.add.at(dt, np.minimum(high, n_grades - 2), np.where(high < n_grades - 1, -do, 0.0) / n)
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate([x.T @ ds.astype(np.float32) + ridge * w, [tail[0]], tail[1:] * g])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        par -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    w, t0, g = par[:m], par[m], np.exp(par[m + 1:])
    return w, t0 + np.concatenate([[0.0], np.cumsum(g)])


def _hashes_column(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [h for w in set(words_of(t)) for h in word_features(w)])
    return hashes(text)


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> OrdinalModel:
    """Fit on a bounded sample: at most ``max_per_class`` rows of each label reach the driver."""
    ship(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select("doc_id", "toxic").dropna().filter(fold != 0)
    sample = None
    for value in (0, 1):
        part = (known.filter(F.col("toxic") == value).dropDuplicates(["doc_id"])
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class))
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * max_per_class rows of two numbers: a proven bound
    ids = sample.collect()
    none = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 60.0))
    if len({r["toxic"] for r in ids}) < 2:
        return none
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    # a repeated doc_id counts once, so the bound holds for the texts as well
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
             .select("doc_id", "toxic", F.xxhash64("text").alias("x"), _hashes_column(F.col("text")).alias("h"))
             .groupBy("doc_id").agg(F.min_by("h", F.struct(F.size("h"), "x")).alias("h"), F.max("toxic").alias("toxic")))
    got = sorted(texts.toLocalIterator(), key=lambda r: r["doc_id"])
    if len({r["toxic"] for r in got}) < 2:
        return none
    rows = [np.array(r["h"], np.int64) for r in got]
    toxic = np.array([r["toxic"] for r in got], np.int64)
    features, z = choose_features(rows, toxic)
    grades = severity_grades(rows, toxic, features, z)
    w, t = fit_ordinal(_design(rows, features), grades, GRADES)
    return OrdinalModel(features, w, t)


SCORE_TYPE = "struct<expected_severity: double, p_toxic: double, grade: int>"


def severity(text: Column, model: OrdinalModel) -> Column:
    """Struct column: expected severity, P(grade >= 1) and the median grade of each text."""
    by_hash = {int(h): i for i, h in enumerate(model.features)}
    weights = model.weights

    def score_of(text: str | None, cache: dict[str, tuple[int, ...]]) -> float:
        counts: dict[int, int] = {}
        for word in set(words_of(text)):
            got = cache.get(word)
            if got is None:
                if len(cache) >= _CACHE_WORDS:
                    cache.clear()
                got = cache[word] = tuple(by_hash[h] for h in word_features(word) if h in by_hash)
            for i in got:
                counts[i] = counts.get(i, 0) + 1
        return float(sum(weights[i] * np.log1p(n) for i, n in counts.items()))

    @F.pandas_udf(SCORE_TYPE)
    def run(texts: pd.Series) -> pd.DataFrame:
        cache = _CACHES.setdefault(model_id, {})
        p = model.probabilities(np.array([score_of(t, cache) for t in texts], np.float64))
        return pd.DataFrame({"expected_severity": p.sum(axis=1), "p_toxic": p[:, 0],
                             "grade": (p >= 0.5).sum(axis=1).astype(np.int32)})
    model_id = zlib.crc32(model.features.tobytes() + model.weights.tobytes())
    return run(text)


_CACHES: dict[int, dict] = {}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, toxic; one row per row of ``docs``."""
    model = fit(docs, labels)
    return (docs.select("doc_id", severity(F.col("text"), model).alias("s"))
            .select("doc_id", "s.*", (F.col("s.grade") >= 1).alias("toxic")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose median grade is 0, all columns as they were."""
    model = fit(docs, labels)
    return docs.filter(severity(F.col("text"), model)["grade"] < 1)
