"""Balanced label propagation: documents to shards of near equal bytes, linked documents together.

Documents of one link group (here: equal texts) are linked.  All start on the
shard of their row's hash.  In each round a group's members look at where their
neighbours are (bytes per group and shard, pre-aggregated) and ask to move to
the group's heaviest shard that has room for the rest of it.  Requests are summed
in hash buckets by shard and wanted shard, and the driver accepts as many buckets
as fit: what leaves a shard in the round is room for what comes.  A group on one
shard is settled; rounds go on until all are or no request is accepted.  A group
too heavy for one quota asks row by row, and only for shards that hold more of it;
one larger than a shard asks for as many shards as it fills.

Linked documents fill a shard nearly up to the mean size, or a little above the
mean of the linked bytes if these are nearly all; a last step evens out: it moves
hash buckets, unlinked documents first, then whole groups, then rows of heavy
groups, from the fullest shards to the emptiest.  The driver sees sums by shards
and bucket (a fixed number), never documents.

Slots number a shard's documents without gaps: per-task counts give offsets,
ranks are taken within a task's share.

Defined results: null text counts as empty (size 16, CRC 0) and is linked to
other empty texts; repeated rows are separate linked documents; an empty table
gives an empty result; null doc_ids stay null; extra columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import running_offsets, stored, text_or_empty

SHARDS = 40
SLACK = 0.02          # linked documents fill a shard up to the mean less this share, or their own mean plus it
QUOTAS = 64           # hash buckets of the requests to a shard in one round: the grain of acceptance
BUCKETS = 4096        # hash buckets of a shard: the grain of evening out
HEAVY = 1 / 64        # a group above this share of the capacity asks row by row
ROW_BYTES = 16


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, link (the text's SHA-256) and a row id that stays fixed."""
    raw = F.encode(text_or_empty(), "UTF-8")
    return stored(docs.select(
        "doc_id", (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("link"),
        F.monotonically_increasing_id().alias("rid")), "shard-rows")


def _bucket(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def _loads(rows: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()}


def accept(sums: list[tuple[int, int, int, int]], load: np.ndarray,
           capacity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The (wanted shard, bucket) accepted of ``sums`` (shard, wanted shard, bucket, bytes), and the load then.

    All are taken at first; shards over the capacity hand back their last buckets
    until all fit with what leaves them, then single buckets that still fit are added.
    """
    shards = len(load)
    flow = np.zeros((shards, QUOTAS, shards), np.int64)
    for shard, want, k, w in sums:
        flow[want, k, shard] = w
    into = flow.sum(2)
    yes = into > 0
    while True:
        after = load + (into * yes).sum(1) - np.einsum("tk,tks->s", yes, flow)
        over = np.flatnonzero((after > capacity) & yes.any(1))
        if not len(over):
            break
        for t in over.tolist():
            for k in np.flatnonzero(yes[t])[::-1].tolist():
                if after[t] <= capacity:
                    break
                yes[t, k] = False
                after[t] -= into[t, k]
    for t, k in zip(*np.nonzero((into > 0) & ~yes)):
        if after[t] + into[t, k] <= capacity:
            yes[t, k] = True
            after[t] += into[t, k]
            after -= flow[t, k]
    return [(int(t), int(k)) for t, k in zip(*np.nonzero(yes))], after


def propagate(nodes: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """(rid, size, link, kind, shard, k) for ``nodes`` (rid, size, link).

    kind is 0 for unlinked rows, 1 for rows of light groups, 2 for rows of heavy
    ones; k is the bucket to move with.
    """
    spark = nodes.sparkSession
    start = nodes.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    groups = stored(nodes.groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
                    .filter("n > 1").select("link", "weight"), "shard-groups")
    rows = stored(start.join(groups, "link", "left").select("rid", "size", "link", "weight", "shard"), "shard-start")
    linked = rows.filter("weight IS NOT NULL")
    total = rows.agg(F.sum("size")).first()[0] or 0
    load = np.zeros(shards, np.int64)
    for shard, n in _loads(linked).items():
        load[shard] = n
    # unlinked documents make room: they are dealt out anew at the end
    capacity = max(total * (1 - slack), int(load.sum()) * (1 + slack)) / shards
    heavy = F.col("weight") > capacity * HEAVY
    parts = [rows.filter("weight IS NULL")]
    pending, turn = linked, 0
    while True:
        tally = pending.groupBy("link", "weight", "shard").agg(F.sum("size").alias("w"))
        # at most one place per shard, the heaviest first
        places = F.sort_array(F.collect_list(F.struct("w", F.xxhash64("link", "shard").alias("tie"), "shard")), False)
        room = F.array(*[F.lit(float(capacity - n)) for n in load])
        emptiest = int(load.argmin())

        def fits(x):
            if turn == 0:                    # nothing is known yet of what will leave
                return F.lit(True)
            left = F.element_at(room, x["shard"] + 1)
            return F.when(heavy, left > capacity / BUCKETS).otherwise(F.col("weight") - x["w"] <= left)

        asked = F.slice(F.filter("places", fits), F.lit(1), F.ceil(F.col("weight") / F.lit(capacity)).cast("int"))
        other = F.when(F.col("weight") <= float(capacity - load[emptiest]), F.lit(emptiest))
        groups = (tally.groupBy("link", "weight").agg(places.alias("places")).withColumn("asked", asked)
                  .select("link", (F.size("places") == 1).alias("whole"),
                          F.when(~heavy, F.coalesce(F.get("asked", F.lit(0))["shard"], other)).alias("goal"),
                          F.when(heavy, F.col("places")).alias("places"), F.when(heavy, F.col("asked")).alias("asked")))
        groups = stored(groups, "shard-groups")
        here = F.get(F.filter("places", lambda x: x["shard"] == F.col("shard")), F.lit(0))
        goal = F.get("asked", F.pmod(F.xxhash64("rid", F.lit(-1 - turn)), F.size("asked")).cast("int"))
        stays = F.exists("asked", lambda x: x["shard"] == F.col("shard"))
        goal = F.when(heavy, F.when((F.size("asked") > 0) & ~stays & (goal > here), goal["shard"])).otherwise(F.col("goal"))
        k = F.when(heavy, F.xxhash64("rid", F.lit(turn))).otherwise(F.xxhash64("link", F.lit(turn)))
        asking = (pending.join(groups, "link").withColumn("goal", F.when(~F.col("whole"), goal))
                  .withColumn("k", F.pmod(k, F.lit(QUOTAS)).cast("int"))
                  .select("rid", "size", "link", "weight", "shard", "whole", "goal", "k"))
        # at most shards * shards * QUOTAS rows
        sums = asking.filter("shard != goal").groupBy("shard", "goal", "k").agg(F.sum("size").alias("w")).collect()
        accepted, load = accept([tuple(r) for r in sums], load, capacity)
        if not accepted:
            break
        yes = spark.createDataFrame(accepted, "goal int, k int").withColumn("yes", F.lit(True))
        moved = stored(asking.join(F.broadcast(yes), ["goal", "k"], "left")
                       .select("rid", "size", "link", "weight", F.expr("if(yes, goal, shard)").alias("shard"),
                               (F.col("whole") | (~heavy & F.col("yes").isNotNull())).alias("settled")), "shard-round")
        parts.append(moved.filter("settled").drop("settled"))
        pending, turn = moved.filter("NOT settled").drop("settled"), turn + 1
    placed = reduce(DataFrame.unionByName, [*parts, pending])
    kind = F.when(F.col("weight").isNull(), 0).when(heavy, 2).otherwise(1)
    return (placed.withColumn("kind", kind)
            .select("rid", "size", "link", "kind", "shard",
                    F.when(F.col("kind") == 1, _bucket("link")).otherwise(_bucket("rid")).alias("k")))


def even_out(buckets: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Moves (shard, kind, bucket, new shard) that bring all shards near the mean.

    ``buckets`` are (shard, kind, bucket, bytes).  Again and again the fullest
    shard gives the emptiest one the bucket nearest to half their difference,
    of the lowest kind that has one smaller than the difference.
    """
    load = [0] * shards
    held: list[tuple[list, list, list]] = [([], [], []) for _ in range(shards)]     # by kind: (bytes, key)
    for shard, kind, k, size in sorted(buckets):
        load[shard] += size
        insort(held[shard][kind], (size, (shard, kind, k)))
    to: dict[tuple[int, int, int], int] = {}
    for _ in range(2 * len(buckets)):
        full, least = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[least]
        if gap * 10_000 * shards <= sum(load):
            break
        for mine in held[full]:
            at = bisect_left(mine, (gap / 2,))
            near = [i for i in (at - 1, at) if 0 <= i < len(mine) and 0 < mine[i][0] < gap]
            if near:
                break
        else:
            break
        size, key = mine.pop(min(near, key=lambda i: abs(mine[i][0] - gap / 2)))
        load[full] -= size
        load[least] += size
        insort(held[least][key[1]], (size, key))
        to[key] = least
    return [(*key, shard) for key, shard in to.items() if shard != key[0]]


def shards_of(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = document_rows(docs)
    placed = stored(propagate(rows.select("rid", "size", "link"), shards, slack), "shard-placed")
    sums = placed.groupBy("shard", "kind", "k").agg(F.sum("size").alias("w"))
    moves = even_out([tuple(r) for r in sums.collect()], shards)     # at most 3 * shards * BUCKETS rows
    moves = spark.createDataFrame(moves, "shard int, kind int, k int, to int")
    final = (placed.join(F.broadcast(moves), ["shard", "kind", "k"], "left")
             .select("rid", F.coalesce("to", "shard").alias("shard")))
    # task of the row id: a share of rows that one task has read
    final = stored(rows.join(final, "rid").withColumn("task", F.shiftright("rid", 33)), "shard-final")
    offsets = stored(running_offsets(final.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n")),
                                     ["shard"], ["task"], "n", "before"), "shard-offsets")
    local = F.expr("row_number() OVER (PARTITION BY shard, task ORDER BY rid) - 1")
    return (final.withColumn("local", local).join(offsets.select("shard", "task", "before"), ["shard", "task"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("local")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
