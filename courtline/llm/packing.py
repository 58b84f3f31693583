"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Documents are tokenised in tasks; a document longer than a sequence is cut
   from its end into full pieces, so only its first piece may be shorter.  Each
   piece gets its rank among the pieces of its length in the same task.
2. The histogram (pieces per length, at most one row per possible length) goes
   to the driver, where best-fit decreasing runs over counts: each step places
   many pieces of one length at once into the fullest open sequences that take
   them.  Work and plan size depend on the sequence length alone.
3. The plan says, for a length and a range of ranks, which sequences the pieces
   take and at which offset.  Global ranks come from per-task counts; pieces
   take their planned slots by joining on length and rank.

The plan is bounded whatever the input: lengths falling means that a range of
sequences takes pieces of at most sqrt(2 * capacity) different lengths, and at
most two ranges are opened or split per length, so 1024 tokens give under
100,000 plan rows of six numbers.

Defined results: null and empty texts have the end token alone; an empty table
gives an empty result; repeated rows are packed as often as they occur; null
doc_ids stay null; extra columns play no part.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtline.llm.common import running_offsets, ship, stored

CAPACITY = 1024
END_ID = 2
#: fixed value: the special token of the 50k byte vocabulary
SPECIAL_TOKENS = {"<|endoftext|>": 50256}
_ENCODERS: dict = {}


def encoder(rank_file: str, pattern: str):
    """The byte-level BPE of a rank file, kept per Python worker.

    Ids equal those of the same vocabulary in the ``tokenizers`` format, at about
    five times the speed; a special token's string in a text has that token's id.
    """
    if rank_file not in _ENCODERS:
        import tiktoken
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
        _ENCODERS[rank_file] = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks,
                                                  special_tokens=SPECIAL_TOKENS)
    return _ENCODERS[rank_file]


PIECE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()),
    T.StructField("local_rank", T.LongType())])


def pieces(docs: DataFrame, rank_file: str, pattern: str, capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its rank among the equally long pieces of its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(text.as_py() or "", allowed_special="all")
                ids.append(end_id)
                n = len(ids)
                data = np.array(ids, "<u4")
                head = n % capacity or capacity
                bounds = [0, *range(min(head, n), n + 1, capacity)]
                for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((doc_id, k, a, z - a, zlib.crc32(data[a:z].tobytes()), task, int(seen[z - a])))
                    seen[z - a] += 1
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    names=PIECE_SCHEMA.names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns rows (length, first rank, last rank + 1, first sequence, pieces per
    sequence, offset): the piece of rank r goes to sequence ``first sequence +
    (r - first rank) // pieces per sequence``, at ``offset`` plus ``length``
    times the remainder.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    free: list[int] = []                    # free spaces with open sequences, ascending
    open_at: dict[int, list] = defaultdict(list)   # free space -> [first sequence, count]
    sequences = 0

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if not open_at[space]:
                insort(free, space)
            open_at[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):             # nothing open takes it: open new sequences
                each = capacity // length
                full, rest = divmod(left, each)
                for per, count in ((each, full), (rest, 1 if rest else 0)):
                    if count:
                        plan.append((length, rank, rank + per * count, sequences, per, 0))
                        put(capacity - per * length, sequences, count)
                        sequences += count
                        rank += per * count
                break
            space = free[at]
            first, count = open_at[space].pop()
            if not open_at[space]:
                del free[at]
            # a sequence stays the best fit until it takes no more of this length
            each = space // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, rank + each * full, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, left = rank + each * full, left - each * full
            used = full
            if left and used < count and left < each:
                plan.append((length, rank, rank + left, first + used, left, capacity - space))
                put(space - left * length, first + used, 1)
                used, left = used + 1, 0
            put(space, first + used, count - used)
    return plan


def pack(docs: DataFrame, rank_file: str, pattern: str, capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece."""
    spark = docs.sparkSession
    ship(spark)
    cut = stored(pieces(docs, rank_file, pattern, capacity, end_id), "pack-pieces")
    per_task = stored(running_offsets(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")),
                                      ["length"], ["task"], "n", "before"), "pack-ranks")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        plan_slots(histogram, capacity),
        "p_length long, from_rank long, to_rank long, first_sequence long, per_sequence long, place long")
    ranked = cut.join(per_task.select("length", "task", "before"), ["length", "task"]).withColumn(
        "rank", F.col("before") + F.col("local_rank"))
    return (ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length"))
                        & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.expr("first_sequence + (rank - from_rank) div per_sequence").alias("sequence_id"),
                    F.expr("place + (rank - from_rank) % per_sequence * length").alias("offset")))
