"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

Tokens are words between ASCII white space, A-Z lower-cased, and one end token
per document (the empty string stands for it in tables).

1. Token counts are aggregated over all learning documents and stored.
2. The commonest tokens are classes of their own; every other token belongs to
   one of ``TAIL`` classes by its last two characters.  In a tail class a token
   has probability (c + 1) / (class tokens + class types + 1).
3. The model predicts a token's class from the two classes before it: a context
   vector, the sum of their vectors each times its position's matrix, is
   multiplied with all class vectors.  Training is data-parallel: every task
   runs NCE over all its learning tokens from the common start, the results are
   averaged by tokens, and this is repeated ``ROUNDS`` times.
4. Scoring takes one matrix product for the normalisers of all pairs of
   contexts, so a document's score is a proper log10 probability over all
   classes.  Counts of the commonest tokens are broadcast (a fixed bound in rows
   and token length); all other tokens, once per document and token, join the
   stored counts.  The commonest are found from a histogram of counts, so the
   driver gets the bound's rows, however many partitions hold them.

Defined results: null and empty texts are one end token; a null doc_id hashes as
the empty text (a learning document); with no learning documents all counts are
zero and the model is uniform over classes; repeated rows get equal scores;
extra columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import ship, stored

FOLDS, HELD_OUT = 7, 2
HEAD = 960             # tokens that are classes of their own
TAIL = 64              # classes of the other tokens
DIM = 24
NOISE = 48             # noise words of a batch
BATCH = 4096
ROUNDS = 2
KNOWN = 65_536         # tokens whose counts are broadcast
KNOWN_CHARS = 64       # longer tokens are never broadcast
HELD = 1 << 17         # distinct tokens that a task counts before it hands them on
HELD_BYTES = 1 << 26   # and bytes of text


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % FOLDS == HELD_OUT


def _strings(words: list[bytes]) -> pa.Array:
    try:
        return pa.array(words, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:                            # bytes that are no UTF-8
        return pa.array([w.decode("utf-8", "replace") for w in words], pa.string())


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c, class) over the learning documents; class is the token's tail class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [_strings(list(held)), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                text = text.as_py() or b""
                held.update(text.lower().split())
                held[b""] += 1
                size += len(text)
                if len(held) > HELD or size > HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()
    counts = (docs.filter(~held_out()).select("text").mapInArrow(run, "token string, n long")
              .groupBy("token").agg(F.sum("n").alias("c")))
    ending = F.encode(F.right("token", F.lit(2)), "UTF-8")
    return counts.withColumn("class", (F.crc32(ending) % TAIL).cast("int"))


def tail_class(token: str) -> int:
    return zlib.crc32(token[-2:].encode()) % TAIL


def tail_classes(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w[-2:]) % TAIL if w[-2:].isascii() else tail_class(w.decode("utf-8", "replace"))
                     for w in words], np.int64)


class Vocabulary:
    """The broadcast part: classes and counts of the commonest tokens, sizes of the tail classes."""

    def __init__(self, common: list[tuple[str, int]], tail: dict[int, tuple[int, int]], end_count: int):
        head = [("", end_count)] + [t for t in common if t[0]][:HEAD - 1]
        self.class_of = {t.encode(): i for i, (t, _) in enumerate(head)}
        self.head_counts = np.array([c for _, c in head] + [0] * (HEAD - len(head)), float)
        self.size = HEAD + TAIL
        for t, c in head[1:]:                          # head tokens leave their tail class
            k = tail_class(t)
            n, v = tail.get(k, (0, 0))
            tail[k] = (n - c, v - 1)
        if end_count:
            k = tail_class("")
            n, v = tail.get(k, (0, 0))
            tail[k] = (n - end_count, v - 1)
        sizes = [tail.get(k, (0, 0)) for k in range(TAIL)]
        self.tail_counts = np.array([n for n, _ in sizes], float)
        self.tail_log = [math.log10(n + v + 1) for n, v in sizes]
        # token -> (class, log10(c + 1), log10 of its class's size or None for head tokens, c > 0)
        self.known = {b"": (0, math.log10(end_count + 1), None, end_count > 0)}
        for t, c in common:
            raw = t.encode()
            if not raw:
                continue
            if raw in self.class_of:
                self.known[raw] = (self.class_of[raw], math.log10(c + 1), None, True)
            else:
                k = tail_class(t)
                self.known[raw] = (HEAD + k, math.log10(c + 1), self.tail_log[k], True)

        # the same as arrays: a token's number, then one entry per known token
        self.number = {raw: i for i, raw in enumerate(self.known)}
        rows = list(self.known.values())
        self.classes = np.array([r[0] for r in rows], "<u2")
        self.logs = np.array([r[1] for r in rows])
        self.tail_logs = np.array([0.0 if r[2] is None else r[1] for r in rows])
        self.tail_sizes = np.array([r[2] or 0.0 for r in rows])
        self.counted = np.array([r[3] for r in rows], np.int64)
        # one row of sums per known token, and a last one of zeros for number -1
        self.sums = np.zeros((len(rows) + 1, 4))
        self.sums[:-1] = np.column_stack([self.counted, self.logs, self.tail_logs, self.tail_sizes])

    def unigram(self) -> np.ndarray:
        n = np.concatenate([self.head_counts, self.tail_counts]) + 0.5
        return n / n.sum()


def encoded(docs: DataFrame, vocabulary) -> DataFrame:
    """Per document: its classes, the sums that known tokens give, and its other tokens once each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"rid long, doc_id {kind}, held_out boolean, n_tokens long, classes binary, known_n long, "
              "known_log double, tail_log double, tail_size double, rest array<struct<token: string, n: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        tail_log = np.array(vocab.tail_log)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                words: list[bytes] = []
                ends = []
                for text in b.column(3).cast(pa.binary()):
                    words += (text.as_py() or b"").lower().split()
                    words.append(b"")
                    ends.append(len(words))
                at = np.fromiter(map(vocab.number.get, words, repeat(-1)), np.int64, len(words))
                stops = np.array(ends)
                firsts = np.concatenate([[0], stops[:-1]])
                sums = np.add.reduceat(vocab.sums.take(at, axis=0), firsts, axis=0)
                classes = vocab.classes[at]
                # the other tokens: their tail classes, and once per document
                other = np.flatnonzero(at < 0)
                names = [words[i] for i in other.tolist()]
                tails = tail_classes(names)
                classes[other] = HEAD + tails
                bounds = np.searchsorted(other, stops)
                doc = np.repeat(np.arange(len(ends)), np.diff(bounds, prepend=0))
                sums[:, 3] += np.bincount(doc, tail_log[tails], len(ends))
                tokens, times, lists, a = [], [], [0], 0
                for z in bounds.tolist():
                    once = Counter(names[a:z])
                    tokens += once
                    times += once.values()
                    lists.append(len(tokens))
                    a = z
                rest = pa.ListArray.from_arrays(
                    pa.array(lists, pa.int32()),
                    pa.StructArray.from_arrays([_strings(tokens), pa.array(times, pa.int64())], ["token", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(stops - firsts),
                     pa.array([classes[i:j].tobytes() for i, j in zip(firsts.tolist(), ends)], pa.binary()),
                     pa.array(sums[:, 0].astype(np.int64)), *[pa.array(sums[:, j].copy()) for j in (1, 2, 3)], rest],
                    names=["rid", "doc_id", "held_out", "n_tokens", "classes", "known_n", "known_log", "tail_log",
                           "tail_size", "rest"])
    return docs.select("rid", "doc_id", "held_out", "text").mapInArrow(run, schema)


class Parameters:
    """Context vectors R, class vectors Q with bias, and one matrix per context position."""

    def __init__(self, table: np.ndarray, size: int):
        self.size = size
        self.table = table.astype(np.float32)          # rows: R, Q, C1, C2; last column of Q's rows: bias

    @classmethod
    def start(cls, unigram: np.ndarray) -> Parameters:
        size = len(unigram)
        rng = np.random.default_rng(7)
        table = np.zeros((2 * size + 2 * DIM, DIM + 1), np.float32)
        table[:2 * size, :DIM] = rng.normal(0, 0.1, (2 * size, DIM))
        table[size:2 * size, DIM] = np.log(unigram)
        table[2 * size:2 * size + DIM, :DIM] = np.eye(DIM)
        table[2 * size + DIM:, :DIM] = 0.5 * np.eye(DIM)
        return cls(table, size)

    def parts(self):
        v = self.size
        return (self.table[:v, :DIM], self.table[v:2 * v, :DIM], self.table[v:2 * v, DIM],
                self.table[2 * v:2 * v + DIM, :DIM], self.table[2 * v + DIM:, :DIM])


def contexts(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, class before it, class before that) of all tokens; class 0 (end) stands before a text."""
    sizes = np.array([len(c) for c in classes], np.int64)
    w = np.concatenate([np.zeros(0, np.int64), *classes]).astype(np.int64)
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    c1, c2 = np.zeros_like(w), np.zeros_like(w)
    c1[1:], c2[2:] = w[:-1], w[:-2]
    c1[firsts] = c2[firsts] = 0
    c2[firsts[sizes[sizes > 0] > 1] + 1] = 0
    return w, c1, c2


def _scatter(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` that have the same index."""
    order = np.argsort(index.astype(np.uint16), kind="stable")     # classes fit 16 bits
    at = index[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros((size, values.shape[1]), np.float32)
    out[at[first]] = np.add.reduceat(values.take(order, axis=0), first, axis=0)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In place; an overflowing exponential gives the right limit."""
    with np.errstate(over="ignore"):
        np.negative(z, out=z)
        np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def nce_step(par: Parameters, squares: np.ndarray, w, c1, c2, noise, log_kp, rate: float) -> None:
    """One Adagrad step on a batch of tokens against shared noise words.

    Equal contexts share their products: vectors meet the position matrices once per class before they are dealt
    to tokens, and gradients are summed per class before they meet them again.
    """
    r, q, bias, m1, m2 = (np.ascontiguousarray(x) for x in par.parts())
    v, n = par.size, len(w)
    h = (r @ m1).take(c1, axis=0)
    h += (r @ m2).take(c2, axis=0)
    qw, qn = q.take(w, axis=0), q[noise]
    up = _sigmoid(np.einsum("ij,ij->i", h, qw) + (bias - log_kp)[w])[:, None]
    up -= 1
    down = h @ qn.T
    down += bias[noise] - log_kp[noise]
    down = _sigmoid(down)
    dh = down @ qn
    dh += np.multiply(up, qw, out=qw)
    grad = np.zeros_like(par.table)
    gq = grad[v:2 * v]
    gq[:] = _scatter(w, np.concatenate([up * h, up], 1), v)
    np.add.at(gq, noise, np.concatenate([down.T @ h, down.sum(0)[:, None]], 1))
    g1, g2 = _scatter(c1, dh, v), _scatter(c2, dh, v)
    grad[:v, :DIM] = g1 @ m1.T + g2 @ m2.T
    grad[2 * v:2 * v + DIM, :DIM] = r.T @ g1
    grad[2 * v + DIM:, :DIM] = r.T @ g2
    grad /= n
    squares += grad * grad
    grad *= rate
    root = np.sqrt(squares)
    root += 1e-6
    grad /= root
    par.table -= grad


def examples(classes: list[np.ndarray], rng: np.random.Generator) -> Iterator[tuple]:
    """Every token with its two contexts, once, in batches of random order."""
    rows = np.stack(contexts(classes), 1).astype(np.uint16)        # classes fit 16 bits
    order = rng.permutation(len(rows))
    for a in range(0, len(rows), BATCH):
        yield tuple(rows.take(order[a:a + BATCH], axis=0).T.astype(np.int64))


def train(rows: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS) -> Parameters:
    """Rounds of local NCE over all learning tokens, averaged over tasks by tokens."""
    spark = rows.sparkSession
    par = Parameters.start(unigram)
    cols = [f"v{j}" for j in range(DIM + 1)]
    schema = "i int, n double, " + ", ".join(f"{c} double" for c in cols)
    learning = rows.filter(~F.col("held_out")).select("classes")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((par.table, unigram))
        rate = 0.1 / (k + 1)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            table, unigram = shared.value
            mine = Parameters(table.copy(), len(unigram))
            squares = np.full(mine.table.shape, 1e-4, np.float32)
            log_kp = np.log(NOISE * unigram).astype(np.float32)
            rng = np.random.default_rng(k)
            ladder = np.cumsum(unigram)
            seen = 0
            for b in batches:
                for w, c1, c2 in examples([np.frombuffer(c.as_py(), "<u2") for c in b.column(0)], rng):
                    seen += len(w)
                    noise = np.minimum(np.searchsorted(ladder, rng.random(NOISE)), len(unigram) - 1)
                    nce_step(mine, squares, w, c1, c2, noise, log_kp, rate)
            if seen:
                # what a task adds is its parameters times its tokens
                out = mine.table.astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(out), dtype=np.int32)), pa.array(np.full(len(out), float(seen))),
                     *[pa.array(out[:, j].copy()) for j in range(DIM + 1)]], names=["i", "n", *cols])
        got = (learning.mapInArrow(run, schema).groupBy("i")
               .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]).collect())
        for row in got:                                 # a fixed number of rows
            par.table[row["i"]] = np.array([row[c] for c in cols]) / row["n"]
    return par


class Predictions:
    """Natural log probabilities of classes after their contexts, normalised over all classes.

    A logit is a sum of one term per context position and the class's bias, so the sum of exponentials over all
    classes is a product of matrices: one product gives the normalisers of all pairs of contexts.
    """

    def __init__(self, par: Parameters):
        r, q, bias, m1, m2 = (x.astype(np.float64) for x in par.parts())
        self.first = (r @ m1) @ q.T + bias
        self.second = (r @ m2) @ q.T
        tops = self.first.max(axis=1), self.second.max(axis=1)
        sums = np.exp(self.first - tops[0][:, None]) @ np.exp(self.second - tops[1][:, None]).T
        with np.errstate(divide="ignore"):
            self.log_sums = np.log(sums) + tops[0][:, None] + tops[1][None, :]
        # pairs whose terms are too far apart for the product of exponentials
        for a, b in np.argwhere(sums < 1e-250):
            self.log_sums[a, b] = np.logaddexp.reduce(self.first[a] + self.second[b])

    def logs(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        return self.first[c1, w] + self.second[c2, w] - self.log_sums[c1, c2]


def class_scores(rows: DataFrame, par: Parameters) -> DataFrame:
    """``rows`` with ``class_log``: log10 probability of a document's classes."""
    shared = rows.sparkSession.sparkContext.broadcast(par)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Predictions(shared.value)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                classes = [np.frombuffer(c.as_py(), "<u2") for c in part.column(1)]
                logs = model.logs(*contexts(classes))
                first = np.cumsum([0] + [len(c) for c in classes[:-1]])
                sums = np.add.reduceat(logs, first) / math.log(10)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums)], names=["rid", "class_log"])
    return rows.select("rid", "classes").mapInArrow(run, "rid long, class_log double")


def commonest(counts: DataFrame, k: int, chars: int, slots: int = 4096) -> list[tuple[str, int]]:
    """At most ``k`` tokens of up to ``chars`` characters, commonest first, by token where counts are equal.

    A histogram over 64 ranges per doubling of the count gives the last range that fits whole.  Of the range after
    it, slots of token hashes are taken while they fit.  So nothing is sorted, the driver gets ``k`` tokens and two
    histograms of bounded size; the result falls short of ``k`` by less than one slot.
    """
    short = counts.filter(F.length("token") <= chars)
    level, slot = F.floor(F.log2("c") * 64), F.pmod(F.xxhash64("token"), F.lit(slots))
    keep, room = F.lit(True), k
    for n, size in sorted(map(tuple, short.groupBy(level.alias("n")).count().collect()), reverse=True):
        if size > room:
            sizes = dict(map(tuple, short.filter(level == n).groupBy(slot.alias("s")).count().collect()))
            last = 0
            while last < slots and sizes.get(last, 0) <= room:
                room -= sizes.get(last, 0)
                last += 1
            keep = (level > n) | ((level == n) & (slot < last))
            break
        room -= size
    rows = short.filter(keep).select("token", "c").collect()
    return sorted(map(tuple, rows), key=lambda row: (-row[1], row[0]))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    counts = stored(token_counts(docs), "lm-counts")
    sizes = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total, types = sum(r["n"] for r in sizes), sum(r["v"] for r in sizes)
    common = commonest(counts, KNOWN, KNOWN_CHARS)
    end = [c for t, c in counts.filter("token = ''").select("token", "c").collect()]
    vocab = Vocabulary(common, {r["class"]: (r["n"], r["v"]) for r in sizes}, end[0] if end else 0)
    shared = spark.sparkContext.broadcast(vocab)
    numbered = docs.select("doc_id", "text", held_out().alias("held_out"),
                           F.monotonically_increasing_id().alias("rid"))
    rows = stored(encoded(numbered, shared), "lm-rows")
    par = train(rows, vocab.unigram())
    logs = class_scores(rows, par)
    rest = (rows.select("rid", F.explode("rest").alias("r")).select("rid", "r.token", "r.n")
            .join(counts.select("token", "c"), "token", "left")
            .groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rest_n"),
                                F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rest_log")))
    rest_n, rest_log = F.coalesce("rest_n", F.lit(0)), F.coalesce("rest_log", F.lit(0.0))
    base = math.log10(total + types + 1)
    return (rows.drop("rest", "classes").join(logs, "rid").join(rest, "rid", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known_n") + rest_n).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("known_log") + rest_log - F.col("n_tokens") * base).alias("base_score"),
                    (F.col("class_log") + F.col("tail_log") + rest_log - F.col("tail_size")).alias("score")))
