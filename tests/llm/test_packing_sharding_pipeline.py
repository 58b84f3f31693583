import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from courtline.llm import packing, registry, sharding

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library(tokenizer):
    rng = random.Random(1)
    marks = ["\x1c", "\x85", "\xa0", " ", "　", " ", "  ", "\n", "\t", "'s", "é", "١", "abc", "12",
             "<|endoftext|>", "\U0001f600", "​", "!!", "'LL"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(500)]
    enc = packing.encoder(RANKS, PATTERN)
    assert [enc.encode(t, allowed_special="all") for t in texts] == [
        e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens_in_a_text(spark, tokenizer):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>\n\n<|endoftext|>  x", "<|endoftext|" + ">" * 3,
             "<|startoftext|> <|endof", "x" * 5000 + "<|endoftext|>" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(packing.pack(docs, RANKS, PATTERN).collect(), list(enumerate(texts)), tokenizer)


def check_packing(rows, docs, tokenizer, capacity=1024):
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    sequences = defaultdict(list)
    got = Counter()
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    want = Counter()
    for i, lists in ids.items():
        for x in lists:
            a, k = 0, 0
            while a < len(x):
                z = a + (len(x) % capacity or capacity) if k == 0 else a + capacity
                want[i, k, a, z - a, zlib.crc32(np.array(x[a:z], "<u4").tobytes())] += 1
                a, k = z, k + 1
    assert got == want
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_of_documents(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = registry.op5_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_packing_of_odd_rows(odd_docs, no_docs, tokenizer):
    rows = packing.pack(odd_docs, RANKS, PATTERN).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], tokenizer)
    assert packing.pack(no_docs, RANKS, PATTERN).count() == 0


def test_plan_is_best_fit_and_bounded():
    rng = random.Random(7)
    for _ in range(30):
        cap = rng.choice([16, 64, 1024])
        hist = {n: rng.randint(1, 5000) for n in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 200)))}
        plan = packing.plan_slots(hist, cap)
        assert len(plan) < 100_000
        for n, c in hist.items():
            ranges = sorted((a, z) for k, a, z, *_ in plan if k == n)
            assert ranges[0][0] == 0 and ranges[-1][1] == c
            assert all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    # one at a time: the same number of sequences as the plain algorithm
    hist = {9: 7, 7: 5, 5: 9, 3: 11, 2: 4, 1: 3}
    free = []
    for n in sorted(hist, reverse=True):
        for _ in range(hist[n]):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(16 - n)
    last = max(s + (z - a + per - 1) // per for _, a, z, s, per, _ in packing.plan_slots(hist, 16))
    assert last == len(free)


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_are_even_and_keep_groups(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op6_label_propagation(spark, sf).collect()
    check_shards(rows, 40)
    load = Counter()
    where = defaultdict(set)
    size = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
        size[r["text_crc32"], r["size"]] += 1
    mean = sum(load.values()) / 40
    assert max(load.values()) < 1.001 * mean and min(load.values()) > 0.999 * mean
    groups = [k for k, n in size.items() if n > 1]
    assert sum(len(where[k]) == 1 for k in groups) > 0.95 * len(groups)


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.shards_of(odd_docs, 3).collect()
    check_shards(rows, 3)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))
                  for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shards_of(no_docs).count() == 0


def test_one_group_larger_than_a_shard(spark):
    docs = spark.createDataFrame([(i, "copy " * 50 if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    rows = sharding.shards_of(docs, 8).collect()
    check_shards(rows, 8)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.1 * min(load.values())


@pytest.mark.parametrize("share", [0.9, 1.0])
def test_small_groups_of_nearly_all_bytes_stay_whole(spark, share):
    rng = random.Random(5)
    texts, n = [], 24_000
    while len(texts) < share * n:
        texts += [f"group {len(texts):08d} " + "x" * 80] * rng.randint(2, 20)
    texts += [f"alone {i:08d} " + "x" * 80 for i in range(n - len(texts))]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = sharding.shards_of(docs, 16).collect()
    check_shards(rows, 16)
    assert len(rows) == len(texts)
    load, where = Counter(), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(load.values()) / 16
    assert max(load.values()) < 1.005 * mean and min(load.values()) > 0.995 * mean
    groups = [t for t in where if t.startswith("group")]
    whole = sum(len(where[t]) == 1 for t in groups)
    assert whole >= 0.999 * len(groups), f"{whole} of {len(groups)}"


def test_pipeline_stages(spark, sf, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).checkpoint()
        assert after.columns == docs.columns and after.exceptAll(kept).count() == 0
        kept = after
    assert 0 < kept.count() < docs.count()
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    for start in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            start = stage(spark, start, sf)
            assert start.columns == odd_docs.columns
        assert start.filter(F.col("doc_id") == 7).count() <= 1
    names = ["__d", "__S", "__s_", "__key", "keep", "n", "root", "fp", "item_id"]
    clashing = docs.limit(40).unionAll(docs.limit(5)).select("*", *[F.lit(1).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, sf).columns == clashing.columns
        assert stage(spark, clashing, sf).count() <= 45


def test_oracles_match(spark, sf):
    from compare import compare, duck
    for name, sql in registry.oracle_sql().items():
        ok, _, _, detail = compare(spark, duck(sf), name, registry.queries()[name], sql, sf)
        assert ok, detail
