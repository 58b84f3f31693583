"""Embedding near-dedup by spherical-cap filters from structured random product codes.

1. Equal vectors of a label become one node with their number, by the SHA-256 of
   their bytes.
2. A code is a random rotation and, for each of ``BLOCKS`` blocks of coordinates,
   random unit code words.  A choice of one word per block is a filter direction;
   a vector exceeds it if the sum of its block products reaches a threshold.
   List decoding finds all exceeded filters without looking at the others: block
   by block it extends only such choices as the best words of the blocks left can
   still lift over the threshold.  A vector that exceeds fewer than ``FILTERS``
   filters of a code takes the threshold of its ``FILTERS``-th best instead.
   The number of code words grows with the largest label, so a random table has
   ``BUCKET`` vectors in a filter at every size.
3. Join on filters: a vector travels once to each first code word among its
   filters, with the list of them all; there, those that share a whole filter
   meet.  A meeting place of more than ``SPLIT`` vectors is dealt into blocks, and
   pairs of blocks go to different tasks.
4. Verification is a matrix product in double precision.  A pair counts in the
   first filter it shares and in no other.  What leaves a task is each vector's
   number of links and one edge to the head of its linked group there, never
   the pairs, so output grows with vectors and not with the square of a group.
5. Components come from large-star / small-star rounds over those edges.

Work in a group of g near copies grows with g * g multiplications, as the exact
number of links asks for; rows do so only beyond ``SPLIT``, at g * g / ``SPLIT``.

Defined results: vectors that are null, empty or zero or hold null or
non-finite components, and vectors without a label, link with nothing: they are
their own component, with no links.  Vectors of different lengths never link.
Repeated rows are vectors of their own, linked with each other.  A null vec_id
comes last: it names a component only if there is no other, and is never kept.
Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import connected_components, ship, spread_join, stored

LINK = 0.93
CODES = 3          # independent product codes
BLOCKS = 2         # blocks of coordinates of a code
FILTERS = 8        # filters of each code that a vector exceeds, at least and for a random one
BUCKET = 16        # vectors of a random table in a filter
SPLIT = 8192       # vectors of a meeting place that one task compares
SEED = 13
_TILE = 1024


class ProductCode:
    """A random product code over vectors of ``dim`` coordinates, ``words`` code words a block."""

    def __init__(self, number: int, dim: int, words: int):
        rng = np.random.default_rng([SEED, number, dim, words])
        width = -(-dim // BLOCKS)
        self.pad = width * BLOCKS - dim
        self.rotation = np.linalg.qr(rng.normal(size=(width * BLOCKS, width * BLOCKS)))[0]
        self.words = rng.normal(size=(BLOCKS, words, width))
        self.words /= np.linalg.norm(self.words, axis=2, keepdims=True)
        random = rng.normal(size=(256, dim))
        products = self.products(random / np.linalg.norm(random, axis=1, keepdims=True))
        self.threshold = float(self._kth_best(products, FILTERS).mean())

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per block: the products of each vector with the block's code words."""
        v = np.pad(unit, ((0, 0), (0, self.pad))) @ self.rotation
        width = v.shape[1] // BLOCKS
        return [v[:, b * width:(b + 1) * width] @ self.words[b].T for b in range(BLOCKS)]

    @staticmethod
    def _kth_best(products: list[np.ndarray], k: int) -> np.ndarray:
        """Each vector's k-th largest sum over the choices of one word per block."""
        best = np.zeros((len(products[0]), 1))
        for p in products:
            top = -np.sort(-p, axis=1)[:, :k]
            sums = (best[:, :, None] + top[:, None, :]).reshape(len(p), -1)
            best = -np.sort(-sums, axis=1)[:, :k]
        return best[:, -1]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of every exceeded filter, by vector and filter number."""
        words = self.words.shape[1]
        owners, filters = [], []
        step = max(1, (1 << 22) // (words * FILTERS))
        for a in range(0, len(unit), step):
            products = self.products(unit[a:a + step])
            least = np.minimum(self.threshold, self._kth_best(products, FILTERS)) - 1e-9
            rest = np.cumsum([p.max(axis=1) for p in products][::-1], axis=0)[::-1]
            owner = np.arange(len(least))
            total, code = np.zeros(len(least)), np.zeros(len(least), np.int64)
            for b, p in enumerate(products):
                left = rest[b + 1][owner] if b + 1 < BLOCKS else 0.0
                choice, word = np.nonzero(p[owner] >= (least[owner] - total - left)[:, None])
                total = total[choice] + p[owner[choice], word]
                code = code[choice] * words + word
                owner = owner[choice]
            owners.append(owner + a)
            filters.append(code)
        return np.concatenate(owners), np.concatenate(filters)


@lru_cache(maxsize=32)
def product_code(number: int, dim: int, words: int) -> ProductCode:
    return ProductCode(number, dim, words)


def exceeded(unit: np.ndarray, words: int) -> list[np.ndarray]:
    """Each vector's filters over all codes, ascending; filter // words ** (BLOCKS - 1) is its meeting place."""
    owners, filters = [], []
    for c in range(CODES):
        owner, code = product_code(c, unit.shape[1], words).decode(unit)
        owners.append(owner)
        filters.append(code + c * words ** BLOCKS)
    owner, code = np.concatenate(owners), np.concatenate(filters)
    order = np.lexsort((code, owner))
    return np.split(code[order], np.cumsum(np.bincount(owner, minlength=len(unit)))[:-1])


def unit_rows(blocks: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, in double precision, scaled to length one."""
    v = np.frombuffer(b"".join(blocks), kind).reshape(len(blocks), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)        # no square overflows or vanishes
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _sound(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, dim, key, vector; key and vector are null for vectors that link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, keys, vectors = [], [], []
            for label, v in zip(b.column(1), b.column(2)):
                raw = None
                if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    raw = x.tobytes() if np.isfinite(x).all() and x.any() else None
                dims.append(len(v.values) if raw else 0)
                keys.append(hashlib.sha256(raw).digest() if raw else None)
                vectors.append(raw)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()),
                 pa.array(vectors, pa.binary())], names=["vec_id", "label", "dim", "key", "vector"])
    types = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return rows.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {types[0]}, label {types[1]}, dim int, key binary, vector binary")


def meeting_places(nodes: DataFrame, words: int, kind: str, whole: bool = True) -> DataFrame:
    """One row per node and meeting place: label, dim, place, node and, if ``whole``, copies, vector, filters."""
    label = nodes.schema["label"].dataType.simpleString()
    per_place = words ** (BLOCKS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                for a in range(0, own.num_rows, 1024):
                    part = own.slice(a, 1024)
                    filters = exceeded(unit_rows(part.column(4).to_pylist(), kind), words)
                    places = [np.unique(f // per_place) for f in filters]
                    times = pa.array(np.repeat(np.arange(len(places)), [len(p) for p in places]))
                    out = part.take(times)
                    cols = [out.column(0), out.column(1), pa.array(np.concatenate(places)), out.column(2)]
                    if whole:
                        lists = pa.array([f.astype("<i8").tobytes() for f in filters], pa.binary())
                        cols += [out.column(3), out.column(4), lists.take(times)]
                    names = ["label", "dim", "place", "node", "copies", "vector", "filters"][:len(cols)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
    more = ", copies long, vector binary, filters binary" if whole else ""
    return nodes.select("label", "dim", "node", "copies", "vector").mapInArrow(
        run, f"label {label}, dim int, place long, node long{more}")


def heads(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each of n items' connected items, by the edges (u, v)."""
    head = np.arange(n)
    while True:
        a, b = head[u], head[v]
        if (a == b).all():
            return head
        np.minimum.at(head, np.maximum(a, b), np.minimum(a, b))
        while (head[head] != head).any():
            head = head[head]


def verified(unit: np.ndarray, copies: np.ndarray, filters: list[np.ndarray], place: int, per_place: int,
             side: np.ndarray, pair: tuple[int, int], link: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, heads) of the vectors that meet at a place, of the pairs between blocks ``pair``.

    Links are counted, with copies, where the pair's first common filter lies here.
    """
    n = len(unit)
    links, edges_u, edges_v = np.zeros(n, np.int64), [], []
    flat = np.concatenate(filters)
    row = np.repeat(np.arange(n), [len(f) for f in filters])
    here = flat // per_place == place
    order = np.lexsort((side[row[here]], flat[here]))
    codes, rows = flat[here][order], row[here][order]
    ends = np.flatnonzero(np.r_[codes[1:] != codes[:-1], True]) + 1
    for a, z in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        mine, code = rows[a:z], codes[a]
        lefts, rights = mine[side[mine] == pair[0]], mine[side[mine] == pair[1]]
        for i in range(0, len(lefts), _TILE):
            for j in range(0 if pair[0] != pair[1] else i, len(rights), _TILE):
                le, ri = lefts[i:i + _TILE], rights[j:j + _TILE]
                linked = unit[le] @ unit[ri].T >= link
                if pair[0] == pair[1] and i == j:
                    linked = np.triu(linked, 1)
                if not linked.any():
                    continue
                x, y = linked.any(axis=1), linked.any(axis=0)
                le, ri, linked = le[x], ri[y], linked[np.ix_(x, y)]
                p, q = np.nonzero(linked)
                edges_u.append(le[p])
                edges_v.append(ri[q])
                fresh = linked & ~_shared(flat, row, code, le, ri, n)
                links[le] += fresh @ copies[ri]
                links[ri] += copies[le] @ fresh
        if len(edges_u) > 64:                        # a forest of what is known so far
            edges_u, edges_v = _forest(edges_u, edges_v, n)
    if not edges_u:
        return links, np.arange(n)
    return links, heads(np.concatenate(edges_u), np.concatenate(edges_v), n)


def _forest(edges_u: list, edges_v: list, n: int) -> tuple[list, list]:
    head = heads(np.concatenate(edges_u), np.concatenate(edges_v), n)
    u = np.flatnonzero(head != np.arange(n))
    return [u], [head[u]]


def _shared(flat: np.ndarray, row: np.ndarray, code: int, le: np.ndarray, ri: np.ndarray, n: int) -> np.ndarray:
    """Whether rows ``le`` and ``ri`` have a filter before ``code`` in common."""
    index = np.full(n, -1)
    both = np.union1d(le, ri)
    index[both] = np.arange(len(both))
    mine = (flat < code) & (index[row] >= 0)
    known, column = np.unique(flat[mine], return_inverse=True)
    has = np.zeros((len(both), len(known)), np.float32)
    has[index[row[mine]], column] = 1
    return has[index[le]] @ has[index[ri]].T > 0


def links_of(nodes: DataFrame, words: int, kind: str, link: float = LINK, split: int = SPLIT) -> DataFrame:
    """(node, links, head): parts of each node's number of links, and an edge for its component."""
    per_place = words ** (BLOCKS - 1)
    places = ["label", "dim", "place"]
    crowded = stored(meeting_places(nodes, words, kind, whole=False).groupBy(*places)
                     .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split)
                     .withColumn("blocks", F.ceil(F.col("n") / split).cast("int")).drop("n"), "cap-crowded")
    meet = meeting_places(nodes, words, kind)
    if crowded.isEmpty():
        meet = meet.withColumn("side", F.lit(0)).withColumn("first", F.lit(0)).withColumn("second", F.lit(0))
    else:
        meet = meet.join(crowded, places, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        meet = (meet.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other"))
                .drop("other", "blocks"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        links, head = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(node) > 1:
            links, head = verified(
                unit_rows([v.as_py() for v in table.column("vector")], kind), table.column("copies").to_numpy(),
                [np.frombuffer(f.as_py(), "<i8") for f in table.column("filters")], key[2].as_py(), per_place,
                table.column("side").to_numpy(), (key[3].as_py(), key[4].as_py()), link)
        some = (links > 0) | (head != np.arange(len(node)))
        return pa.table({"node": node[some], "links": links[some], "head": node[head[some]]})
    return meet.groupBy(*places, "first", "second").applyInArrow(run, "node long, links long, head long")


def near_vectors(rows: DataFrame, link: float = LINK, split: int = SPLIT) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``rows`` (vec_id, label, embedding)."""
    ship(rows.sparkSession)
    kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    known = stored(_sound(rows, kind), "cap-rows")
    name = ["label", "dim", "key"]
    # numbered by their first vec_id, so a component's smallest node holds its smallest vec_id
    nodes = stored(known.filter(F.col("key").isNotNull()).groupBy(*name)
                   .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"),
                        F.min("vec_id").alias("first_id"))
                   .orderBy(F.asc_nulls_last("first_id"), "key").withColumn("node", F.monotonically_increasing_id()),
                   "cap-nodes")
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    words = max(4, int(np.ceil((FILTERS * largest / BUCKET) ** (1 / BLOCKS))))
    found = stored(links_of(nodes, words, kind, link, split), "cap-links")
    edges = found.filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    roots = connected_components(edges, "cap-cc")
    first = nodes.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(
        F.col("node").alias("root"), F.col("first_id").alias("component_id"))
    named = spread_join(roots, first, "root").select("node", "component_id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = stored(nodes.select(*name, "node", "copies", "first_id").join(links, "node", "left")
                     .join(named, "node", "left")
                     .select(*name, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component_id", "first_id").alias("component_id")), "cap-nodes-linked")
    return (known.drop("vector").join(of_node, name, "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
