"""Benchmark decontamination by the CGK random-walk embedding and bit-sampling LSH.

Texts are lower-cased word sequences.  A document contains an item if some
stretch of its words is within ``TOLERANCE`` (a fifth of the item's words) of
the item by edit distance on words.

1. Count filter (no losses): an edit destroys at most two word bigrams, so the
   item-sized window at the start of a match keeps at least L - 1 - 2d of its
   bigrams in the bigram set of the items of its length class.  Only such
   windows go on; running sums find them for all window positions of the whole
   text, and a text with fewer such bigrams than a class needs skips the class.
2. CGK embedding: a walk over the window repeats or advances at each step by a
   random bit drawn for (repeat, step, word), which turns an edit distance into
   a Hamming distance between walks.  Each repeat samples ``SAMPLED`` places of
   the walk; item and window meet if all sampled places agree.  One walk goes
   forward from the window's start and one backward from its end; each spans the
   power of two at or below the item's words, so both together span the item and
   edits gathered at one end leave the walk from the other end as it is.  The
   number of repeats follows from the wanted recall and the measured agreement.
3. Every meeting is verified by the exact edit distance between the item and
   the best stretch of words around the window.

The benchmark is dealt into blocks of bounded size; one pass over the documents
per block, so nothing broadcast grows with the benchmark.

Defined results: null, empty and wordless texts and items match nothing; items
under five words must occur unchanged; equal items are reported each; a repeated
document row is reported as often as it occurs; of several matches of one item
the closest counts, then the first; extra columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from courtline.llm.common import ship

TOLERANCE = 0.2
TARGET_RECALL = 0.99
# measured: share of places that agree in the better of both walks with a fifth of the words edited; the lowest
# mean of 40 items each of 30 to 250 words and six kinds of edits (words put in and left out, 160 and 250 words)
AGREEMENT = 0.42
SAMPLED = 3
BLOCK_ITEMS = 5000     # items of one pass
BLOCK_BYTES = 8 << 20  # text of one pass
_WORD = re.compile(r"\w+")
_SYMBOLS = 4096        # words share random bits modulo this


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def repeats_for(recall: float = TARGET_RECALL, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    """Repeats after which a pair within the tolerance has met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement ** sampled))


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: the source of the walk's random bits."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fitting_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``region``, and where the first such stretch ends."""
    cols = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for sym in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (region != sym))
        row = np.minimum.accumulate(new - cols) + cols
    end = int(row.argmin())
    return int(row[end]), end


class ItemIndex:
    """The items of one block, embedded and hashed for lookup."""

    def __init__(self, items: list[tuple[int, str]], tolerance: float = TOLERANCE,
                 recall: float = TARGET_RECALL):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item_id, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int64)
            if len(ids):
                self.items.append((item_id, ids, int(tolerance * len(ids))))
        self.base = len(self.vocab) + 1
        self.repeats = repeats_for(recall)
        grams = [ids[:-1] * self.base + ids[1:] for _, ids, _ in self.items]
        self.item_grams = [frozenset(g.tolist()) for g in grams]
        self.bigrams, which = np.unique(np.concatenate([*grams, np.zeros(0, np.int64)]), return_inverse=True)
        # the length classes that hold a bigram, one bit each
        sizes = [len(ids).bit_length() - 1 for _, ids, _ in self.items]
        bits = np.repeat(np.uint64(1) << np.array(sizes, np.uint64), [len(g) for g in grams])
        self.holders = np.zeros(len(self.bigrams), np.uint64)
        np.bitwise_or.at(self.holders, which, bits)
        self.singles = np.unique([ids[0] for _, ids, _ in self.items if len(ids) == 1]).astype(np.int64)
        self.needs: dict[int, int] = {}      # window length -> bigrams that a window must keep
        self._walks: dict[int, tuple] = {}
        by_class: dict[int, list[int]] = defaultdict(list)
        for i, (_, ids, d) in enumerate(self.items):
            need = max(0, len(ids) - 1 - 2 * d)
            self.needs[len(ids)] = need
            by_class[1 << (len(ids).bit_length() - 1)].append(i)
        self.classes = {}
        for size, members in by_class.items():
            keys, who = [], []
            for i in members:
                ids = self.items[i][1]
                keys.append([self.keys(x, np.zeros(1, np.int64), size)[0] for x in (ids, ids[::-1])])
                who.append(np.full(self.repeats, i))
            keys, who = np.concatenate(keys, axis=1), np.concatenate(who)
            orders = [np.argsort(k, kind="stable") for k in keys]
            self.classes[size] = ([(k[o], who[o]) for k, o in zip(keys, orders)],
                                  sorted({len(self.items[i][1]) for i in members}))

    def _walk(self, size: int) -> tuple:
        """Sampled places by step, and the random bits of the walk.

        Places lie in the first 2 * size steps, ``size`` words on average.
        Bit r % 64 of a word of the table is the bit of repeat r for (step, symbol).
        """
        if size not in self._walks:
            seed = np.arange(self.repeats * SAMPLED, dtype=np.uint64) + np.uint64(size << 32) + np.uint64(7)
            places = (_mix(seed) % np.uint64(max(1, 2 * size))).astype(np.int64)
            places = places.reshape(self.repeats, SAMPLED)
            at_step = [np.nonzero(places == step) for step in range(int(places.max()) + 1)]
            words = np.arange(len(at_step) * _SYMBOLS, dtype=np.uint64) + np.uint64(size << 40)
            self._walks[size] = (at_step, _mix(words).reshape(len(at_step), _SYMBOLS))
        return self._walks[size]

    def keys(self, ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """(starts, repeats) keys: the walk from each start, hashed at the sampled places."""
        at_step, table = self._walk(size)
        padded = np.concatenate([ids, np.zeros(2 * size + 1, np.int64)])
        at = np.repeat(starts[:, None], self.repeats, axis=1)
        shift = (np.arange(self.repeats, dtype=np.uint64) % np.uint64(64))[None, :]
        taken = np.zeros((len(starts), self.repeats, SAMPLED), np.uint64)
        one = np.uint64(1)
        for step, (r, k) in enumerate(at_step):
            sym = padded[at]
            if len(r):
                taken[:, r, k] = sym[:, r]
            bit = (table[step][sym & (_SYMBOLS - 1)] >> shift) & one
            at += bit.astype(np.int64)
        out = np.arange(self.repeats, dtype=np.uint64)[None, :] + np.uint64(0x9E37)
        with np.errstate(over="ignore"):
            for k in range(SAMPLED):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + taken[:, :, k])
        return out

    def find(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item_id, edit distance, first word of the window) of each item found."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        n = len(ids)
        if not n or not self.items:
            return []
        at, classes = self._known_bigrams(ids)
        back_ids = ids[::-1].copy()
        best: dict[int, tuple[int, int]] = {}
        for size, (tables, lengths) in self.classes.items():
            least = min(self.needs[length] for length in lengths)
            mine = at[(classes >> np.uint64(size.bit_length() - 1)) & np.uint64(1) > 0]
            if len(mine) < least:
                continue
            # both directions: the words and, by first word, the bigrams of the class
            hits = np.zeros(n, np.int64)
            hits[mine] = 1
            pairs: set[tuple[int, int]] = set()
            for back, (way, marks, (keys, who)) in enumerate((
                    (ids, hits, tables[0]), (back_ids, np.concatenate([hits[:-1][::-1], hits[-1:]]), tables[1]))):
                starts = self._starts(way, marks, lengths, least)
                if not len(starts):          # a window kept from one end is kept from the other
                    break
                for a in range(0, len(starts), 4096):
                    met = self._meet(way, starts[a:a + 4096], size, keys, who)
                    pairs.update((i, max(0, n - s - len(self.items[i][1])) if back else s) for i, s in met)
            self._verify(ids, pairs, best)
        return [(self.items[i][0], d, s) for i, (d, s) in sorted(best.items())]

    def _known_bigrams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the benchmark's bigrams begin, and the classes that hold each."""
        known = ids > 0
        pair = np.flatnonzero(known[:-1] & known[1:])
        if not len(self.bigrams) or not len(pair):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = ids[pair] * self.base + ids[pair + 1]
        at = np.minimum(np.searchsorted(self.bigrams, grams), len(self.bigrams) - 1)
        found = self.bigrams[at] == grams
        return pair[found], self.holders[at[found]]

    def _starts(self, ids: np.ndarray, hits: np.ndarray, lengths: list[int], least: int) -> np.ndarray:
        """First words of the windows that keep enough bigrams for an item of one of ``lengths``."""
        n = len(ids)
        if least == 0:                       # one-word items
            return np.flatnonzero(np.isin(ids, self.singles))
        total = np.concatenate([[0], np.cumsum(hits)])
        # first by the longest window and the least need
        ends = np.minimum(np.arange(n) + lengths[-1] - 1, n)
        starts = np.flatnonzero(total[ends] - total[:n] >= least)
        ok = np.zeros(len(starts), bool)
        for length in lengths if len(starts) else ():
            ok |= total[np.minimum(starts + length - 1, n)] - total[starts] >= self.needs[length]
        return starts[ok]

    def _meet(self, ids, starts, size, keys, who) -> set[tuple[int, int]]:
        """(item, start) of the windows that meet an item."""
        mine = self.keys(ids, starts, size).ravel()
        lo = np.searchsorted(keys, mine, "left")
        met = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == mine)
        hi = np.searchsorted(keys, mine[met], "right")
        return {(i, int(starts[flat // self.repeats])) for flat, a, z in zip(
            met.tolist(), lo[met].tolist(), hi.tolist()) for i in who[a:z].tolist()}

    def _verify(self, ids, pairs, best) -> None:
        if not pairs:
            return
        grams = (ids[:-1] * self.base + ids[1:]).tolist()
        covered: dict[int, int] = {}
        for i, start in sorted(pairs):
            _, item, d = self.items[i]
            if start <= covered.get(i, -1) or (i in best and best[i][0] == 0):
                continue                    # an earlier verification took in this window
            a, z = max(0, start - d), min(len(ids), start + len(item) + 2 * d)
            region = ids[a:z]
            own = self.item_grams[i]
            if len(own.intersection(grams[a:z - 1])) < len(own) - 2 * d:
                continue
            covered[i] = start + d
            dist, end = fitting_distance(item, region)
            if dist <= d:
                found = (dist, max(0, a + end - len(item)))
                best[i] = min(best.get(i, found), found)


def _blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    count = max(math.ceil((size["n"] or 0) / block_items), math.ceil((size["b"] or 0) / block_bytes))
    if count <= 1:
        return [items] if count else []
    # hashed blocks are near their mean size; an item is in exactly one
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [items.filter(block == k) for k in range(count)]


def matches(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE,
            recall: float = TARGET_RECALL, block_items: int = BLOCK_ITEMS,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edit_distance, item_words, first_word: the items each document contains."""
    spark = docs.sparkSession
    ship(spark)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = (f"doc_id {kinds[0]}, item_id {kinds[1]}, edit_distance int, item_words int, first_word long")
    out = spark.createDataFrame([], schema)
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    for block in _blocks(benchmark, block_items, block_bytes):
        index = spark.sparkContext.broadcast(
            ItemIndex([(r["item_id"], r["text"]) for r in block.collect()], tolerance, recall))
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(_finder(index, item_type), schema))
    return out


def _finder(index, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        size = {item_id: len(ids) for item_id, ids, _ in ix.items}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for item_id, dist, first in ix.find(words_of(text.as_py())):
                    rows.append((doc_id, item_id, dist, size[item_id], first))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (b.schema.field(0).type, item_type, pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["doc_id", "item_id", "edit_distance", "item_words", "first_word"])
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE,
                      recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns as they were."""
    spark = docs.sparkSession
    ship(spark)
    rest = docs
    for block in _blocks(benchmark, BLOCK_ITEMS, BLOCK_BYTES):
        index = spark.sparkContext.broadcast(
            ItemIndex([(r["item_id"], r["text"]) for r in block.collect()], tolerance, recall))
        rest = rest.filter(~_contains(index)(F.col("text")))
    return rest


def _contains(index):
    @F.pandas_udf("boolean")
    def contains(texts: pd.Series) -> pd.Series:
        ix = index.value
        return texts.map(lambda t: bool(ix.find(words_of(t)))).astype(bool)
    return contains
