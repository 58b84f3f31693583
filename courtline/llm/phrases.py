"""Phrase collocation mining: multikey three-way quicksort of suffix pointers.

A suffix is a word position with the words that follow it in its piece, up to
``max_words`` of them.  Phrases are counted per language:

1. Heavy routes.  Every chunk of texts reports the phrases of up to
   ``max_words - 1`` words that hold at least half a bucket's share of its
   positions; those whose reported sum reaches a bucket's share are heavy.  A
   phrase with one and a half shares is reported well enough by the chunks in
   which it is common, so none is overlooked, and at most one phrase per share
   can be heavy: the set has a fixed bound.
2. Routing.  A suffix goes to the bucket of its leading word; if that is heavy, of
   its two leading words, and so on.  Equal suffixes of a chunk travel once, with
   their number.  What a chunk sends to a bucket is one compressed table of words
   and pointers.  Heavy phrases are counted where they are and travel as counts.
3. Sorting.  In its bucket, an array of pointers is sorted by multikey three-way
   quicksort: each segment is split around a pivot word into less, equal and
   greater; the equal part's size is the count of its phrase, and it goes on with
   the next word until ``max_words``.  Segments below ``min_count`` are abandoned:
   a bucket holds all suffixes of its routes, so nothing in them can reach it.
   The segments of one round are split together, in numpy.
4. Frequent phrases, stored, are joined with the counts of their parts, scored in
   exact decimals, compared with the longer candidates that hold them, and ranked.

Defined results: null and wordless texts have no phrases; null lang is ``und``;
repeated rows count as often as they occur; an empty table gives an empty
result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.llm.common import ship, stored

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
COVER_PERCENT = 50         # a phrase falls to a longer one that holds this share of its occurrences
SCALE = 1_000_000
NO_LANG = "und"
CHUNK_BYTES = 16 << 20     # text that is encoded at once
BUCKET_BYTES = 4 << 20     # text whose suffixes make a bucket
MAX_SHARES = 1 << 16       # bound of the heavy phrases of each length
TOP_SALTS = 64
_UPPER = bytes(range(65, 91))
# fixed values: what ends a piece, and the white space inside one
_TABLE = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\x0d\t", _UPPER.lower() + b"\n" * 9 + b" ")


class Chunk:
    """Suffixes of some texts of a language: a dictionary of words and, per position, the codes from there on."""

    def __init__(self, texts: list[bytes], lang: str, max_words: int):
        flat = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
        coded = pc.list_flatten(pc.split_pattern(pa.array([flat], pa.large_binary()), b" ")).dictionary_encode()
        self.names = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mark, empty = (pc.index(self.names, pa.scalar(x, self.names.type)).as_py() for x in (b"\n", b""))
        codes = codes[codes != empty]
        codes = np.concatenate([np.where(codes == mark, -1, codes), np.full(max_words, -1)])
        at = np.flatnonzero(codes >= 0)
        #: key d: the word at distance d in the same piece, or -1
        self.keys = [codes[at]]
        for d in range(1, max_words):
            self.keys.append(np.where(self.keys[-1] >= 0, codes[at + d], -1))
        self.lang, self.times = lang, np.ones(len(at), np.int64)

    def codes_of(self, length: int) -> np.ndarray:
        """One number per phrase of the first ``length`` words of each suffix; equal for equal phrases."""
        code = self.keys[0]
        for k in self.keys[1:length]:
            code = np.unique(code * (len(self.names) + 1) + k + 1, return_inverse=True)[1]
        return code

    def merge(self) -> None:
        """Equal suffixes become one, with their number."""
        _, first, times = np.unique(self.codes_of(len(self.keys)), return_index=True, return_counts=True)
        self.keys, self.times = [k[first] for k in self.keys], times

    def routes(self) -> list[np.ndarray]:
        """64-bit names of the first 1, 2, ... words of every suffix (of no meaning where it has not so many)."""
        own = self.lang.encode() + b"\x00"
        word = np.fromiter((xxhash.xxh64_intdigest(own + w) for w in self.names.to_pylist()), np.uint64,
                           len(self.names))
        out = [word[self.keys[0]]]
        with np.errstate(over="ignore"):
            for k in self.keys[1:]:
                out.append(_mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + word[k]))
        return out

    def phrases(self, rows: np.ndarray, length: int) -> list[bytes]:
        words = [self.names.take(pa.array(k[rows])) for k in self.keys[:length]]
        return (words[0] if length == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", self.names.type))).to_pylist()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batches: Iterator[pa.RecordBatch], max_words: int, size: int) -> Iterator[Chunk]:
    """Chunks of rows (lang, text), each of up to ``size`` bytes or one text; at least one word in each."""
    def made(held: list[bytes], lang: str) -> Iterator[Chunk]:
        chunk = Chunk(held, lang, max_words)
        if len(chunk.times):
            yield chunk

    for b in batches:
        langs = b.column(0).to_pylist()
        texts = b.column(1).cast(pa.binary())
        for lang in sorted(set(langs)):
            held, n = [], 0
            for i, own in enumerate(langs):
                if own != lang or not (text := texts[i].as_py()):
                    continue
                if held and n + len(text) > size:
                    yield from made(held, lang)
                    held, n = [], 0
                held.append(text)
                n += len(text)
            if held:
                yield from made(held, lang)


def three_way_phrases(keys: list[np.ndarray], weight: np.ndarray, min_count: int,
                      shortest: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to suffixes, all segments of a round at once.

    ``keys[d]`` holds each suffix's word at depth d (-1: none), ``weight`` its
    number.  Yields (words, pointers, counts): for each phrase of at least
    ``shortest`` words and ``min_count`` occurrences one suffix that begins with it.
    """
    table = np.stack(keys).astype(np.int32)
    pointer = np.flatnonzero(table[0] >= 0)
    length = np.array([len(pointer)])                 # of each segment; they follow one another
    depth = np.zeros(1, np.int64)                     # words that a segment's suffixes share
    while len(pointer):
        segments = len(length)
        first = np.cumsum(length) - length
        own = np.repeat(depth, length)
        word = table[own, pointer]
        pivot = np.sort([word[first], word[first + length // 2], word[first + length - 1]], axis=0)[1]
        side = np.sign(word - np.repeat(pivot, length)).astype(np.int64) + 1      # 0 less, 1 equal, 2 greater
        part = np.repeat(np.arange(0, 3 * segments, 3), length) + side
        total = np.bincount(part, weight[pointer], 3 * segments).astype(np.int64)
        live = total >= min_count                     # the others are abandoned
        equal = np.flatnonzero(live[1::3])
        member = np.zeros(segments, np.int64)
        at_pivot = np.flatnonzero(side == 1)
        member[part[at_pivot] // 3] = pointer[at_pivot]
        for d in np.unique(depth[equal]).tolist():
            if d + 1 >= shortest:
                mine = equal[depth[equal] == d]
                yield d + 1, member[mine], total[1::3][mine]
        # less and greater parts stay at their word, equal ones go on to the next, where there is one
        keep = live[part]
        keep[at_pivot] &= own[at_pivot] + 1 < len(keys)
        at_pivot = at_pivot[keep[at_pivot]]
        keep[at_pivot] = table[own[at_pivot] + 1, pointer[at_pivot]] >= 0
        size = np.bincount(part[keep], minlength=3 * segments)
        start = np.cumsum(size) - size
        moved = np.empty(int(size.sum()), np.int64)
        for s in range(3):
            mine = pointer[keep & (side == s)]
            to, many = start[s::3], size[s::3]
            moved[np.repeat(to - (np.cumsum(many) - many), many) + np.arange(len(mine))] = mine
        filled = np.flatnonzero(size)
        pointer, length = moved, size[filled]
        depth = depth[filled // 3] + (filled % 3 == 1)


def _packed(words: list[bytes], separator: bytes, columns: list[np.ndarray]) -> bytes:
    """Words, then columns of equal length, in one compressed block."""
    table = separator.join(words)
    head = np.array([len(words), len(table), len(columns), len(columns[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(
        b"".join([head, table, *(np.ascontiguousarray(c, "<i8" if c.dtype == np.int64 else "<i4").view(np.uint8)
                                 .tobytes() for c in columns[:-1]), columns[-1].astype("<i8").tobytes()]))


def _unpacked(block: bytes, separator: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n_words, n_table, n_columns, n = np.frombuffer(raw, "<i8", 4).tolist()
    words = raw[32:32 + n_table].split(separator) if n_words else []
    at, columns = 32 + n_table, []
    for k in range(n_columns):
        kind = np.dtype("<i8" if k == n_columns - 1 else "<i4")
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return words, columns


def heavy_phrases(rows: DataFrame, shares: int, max_words: int, chunk_bytes: int) -> np.ndarray:
    """Names of all phrases with one and a half shares of the positions or more, and of none with less than one.

    At most ``shares`` names of each length: a fixed bound.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, max_words, chunk_bytes):
            least = len(c.times) / (2 * shares)
            routes = c.routes()
            names, counts = [], [len(c.times)]
            at = np.arange(len(c.times))
            for length in range(1, max_words):
                at = at[c.keys[length - 1][at] >= 0]
                name, n = np.unique(routes[length - 1][at], return_counts=True)
                names.append(name[n >= least])
                counts.extend(n[n >= least].tolist())
                at = at[np.isin(routes[length - 1][at], names[-1])]
            found = np.concatenate(names).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *found.tolist()], pa.int64()), pa.array(counts, pa.int64())], names=["name", "n"])

    seen = stored(rows.mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "phrase-heavy")
    total = seen.filter("name IS NULL").select("n").first()
    if not total:
        return np.zeros(0, np.uint64)
    heavy = seen.filter(F.col("name").isNotNull() & (F.col("n") * shares >= total["n"])).select("name")
    return np.sort(np.array([r["name"] for r in heavy.collect()], np.int64).view(np.uint64))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                  bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of up to ``max_words`` words that occur ``min_count`` times.

    The phrase of no words is there as well: its n counts all words of the language.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    shares = min(buckets, MAX_SHARES)
    heavy = spark.sparkContext.broadcast(heavy_phrases(rows, shares, max_words, chunk_bytes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, max_words, chunk_bytes):
            langs, places, routed, blocks = [], [], [], []

            def send(place: np.ndarray, kind: int, block) -> None:
                """A block for each bucket of ``place``, of the rows that ``block`` is given."""
                order = np.argsort(place, kind="stable")
                ends = np.flatnonzero(np.r_[place[order][1:] != place[order][:-1], True]) + 1
                for a, z in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    langs.append(c.lang)
                    places.append(int(place[order[a]]))
                    routed.append(kind)
                    blocks.append(block(order[a:z]))

            words = len(c.times)
            c.merge()
            names = c.routes()
            at = np.arange(len(c.times))
            counted, counts = [b""], [words]
            for length in range(1, max_words + 1):
                at = at[c.keys[length - 1][at] >= 0]
                is_heavy = np.isin(names[length - 1][at], heavy.value) & (length < max_words)
                if (mine := at[~is_heavy]).size:
                    def block(rows: np.ndarray, mine=mine) -> bytes:
                        used, codes = np.unique([k[mine[rows]] for k in c.keys], return_inverse=True)
                        own = c.names.take(pa.array(used[used >= 0])).to_pylist()
                        codes = codes.reshape(max_words, -1) - int(used[0] < 0)
                        return _packed(own, b" ", [*codes.astype(np.int32), c.times[mine[rows]]])
                    send((names[length - 1][mine] % np.uint64(buckets)).astype(np.int64), length, block)
                at = at[is_heavy]
                if at.size:                            # heavy phrases are counted here
                    code = c.codes_of(length)[at]
                    _, first, which = np.unique(code, return_index=True, return_inverse=True)
                    counted.extend(c.phrases(at[first], length))
                    counts.extend(np.bincount(which, c.times[at]).astype(np.int64).tolist())
            place = np.array([xxhash.xxh64_intdigest(p) % buckets for p in counted], np.int64)
            counts = np.array(counts, np.int64)
            send(place, 0, lambda rows: _packed([counted[i] for i in rows.tolist()], b"\n", [counts[rows]]))
            for a in range(0, len(blocks), 64):
                z = a + 64
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[a:z], pa.string()), pa.array(places[a:z], pa.int64()),
                     pa.array(routed[a:z], pa.int32()), pa.array(blocks[a:z], pa.binary())],
                    names=["lang", "bucket", "routed", "block"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        lang, routed = key[0].as_py(), key[2].as_py()
        words, phrases, numbers = [], [], []
        blocks = (b.as_py() for b in table.column("block"))
        if routed == 0:
            sums: dict[bytes, int] = {}
            for own, (n,) in (_unpacked(b, b"\n") for b in blocks):
                for phrase, k in zip(own or [b""], n.tolist()):
                    sums[phrase] = sums.get(phrase, 0) + k
            for phrase, n in sums.items():
                if n >= min_count or not phrase:
                    words.append(phrase.count(b" ") + 1 if phrase else 0)
                    phrases.append(phrase)
                    numbers.append(n)
        else:
            code: dict[bytes, int] = {}
            parts = []
            for own, columns in (_unpacked(b, b" ") for b in blocks):
                new = np.array([code.setdefault(w, len(code)) for w in own] + [-1], np.int32)
                parts.append([*(new[k] for k in columns[:-1]), columns[-1]])
            *keys, weight = (np.concatenate(p) for p in zip(*parts))
            names = list(code)
            for length, pointers, n in three_way_phrases(keys, weight, min_count, routed):
                phrases.extend(b" ".join(names[k[i]] for k in keys[:length]) for i in pointers.tolist())
                words.extend([length] * len(n))
                numbers.extend(n.tolist())
        return pa.table({"lang": pa.array([lang] * len(words), pa.string()), "words": pa.array(words, pa.int32()),
                         "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                         "n": pa.array(numbers, pa.int64())})

    blocks = rows.mapInArrow(route, "lang string, bucket long, routed int, block binary")
    return blocks.groupBy("lang", "bucket", "routed").applyInArrow(
        count, "lang string, words int, phrase string, n long")


def collocations(counts: DataFrame, top: int = TOP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best of each language's phrases of two words or more."""
    counts = stored(counts, "phrase-counts")
    phrases = counts.filter("words >= 1").select("lang", "phrase", "n")
    candidates = counts.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn(
        "head", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "tail", F.expr("substring_index(phrase, ' ', k - words)"))

    def part(name: str, number: str) -> DataFrame:
        return phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(number))

    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(16,0)) "
                   "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what longer candidates hold of a phrase: the phrases inside each of them
    inside = (candidates.filter("words > 2").withColumn("w", F.split("phrase", " "))
              .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
              .select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"),
                      F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (worst.join(inside, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # the best of each salted part first: no task takes a language's candidates whole
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    best = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .filter(F.col("rank") <= top).drop("rank", "salt"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = counts.filter("words = 0").select("lang", "n")
    return (ranked.filter(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                    F.col("score").cast("long").alias("score")))


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 cover_percent: int = COVER_PERCENT, bucket_bytes: int = BUCKET_BYTES,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    return collocations(phrase_counts(docs, min_count, max_words, bucket_bytes, chunk_bytes), top, cover_percent)
