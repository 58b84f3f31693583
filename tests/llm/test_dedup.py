import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
import xxhash
import zstandard

from courtline.llm import exact_dedup, simhash, suffix_dedup


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, core string")


# exact dedup -----------------------------------------------------------------

def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups_match_brute_force(odd_docs):
    rows = [(r["doc_id"], norm(r["text"])) for r in odd_docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_dedup.exact_groups(odd_docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(groups[t])
        assert r["keep_id"] == min((i for i in groups[t] if i is not None), default=None)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_filter_keeps_one_whole_row_of_each(odd_docs, no_docs):
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [norm(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in odd_docs.collect()})
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0 and exact_dedup.exact_groups(no_docs).count() == 0


def test_chunks_are_the_text_and_equal_for_equal_texts(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh,.", k=rng.randint(1, 9))) for _ in range(20_000))
    rows = exact_dedup.with_recipes(docs_of(spark, [text, "zz" * 30_000, "head " + text])).collect()
    for r in rows:
        assert "".join(r["__chunks"]) == norm(r["text"])
        assert all(len(c) <= exact_dedup.MAX_CHUNK for c in r["__chunks"])
    shared = set(rows[0]["__chunks"]) & set(rows[2]["__chunks"])
    assert len(shared) > 0.8 * len(rows[0]["__chunks"])       # chunk ends follow the content


def test_exact_runs_no_python(spark, sf):
    plan = exact_dedup.exact_groups(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# simhash ---------------------------------------------------------------------

def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "One", "one two THREE", "a b\tc\nd e \x0b f", "Ä B ä b   c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_every_link_meets_in_a_posting_list():
    for minimum in range(1, 8):
        family = [set(t) for t in simhash.posting_family(minimum)]
        assert all(any(t <= set(c) for t in family) for c in combinations(range(8), minimum))
    assert len(simhash.posting_family(4)) == 20


def near_texts():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randint(200, 500))] for _ in range(12)]
    out = [None, "", "  "]
    for b in base:
        for _ in range(6):
            v = list(b)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(99)}"
            out.append(" ".join(v))
    return out


def test_components_match_brute_force(spark):
    texts = near_texts()
    fps = [slow_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in combinations(range(len(texts)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = simhash.near_groups(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        i: (f"{fps[i]:016x}", find(i)) for i in range(len(texts))}
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs_of(spark, texts)).collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


def test_simhash_on_odd_rows(odd_docs, no_docs):
    assert simhash.near_groups(odd_docs).count() == odd_docs.count()
    assert simhash.near_groups(no_docs).count() == 0 and simhash.keep_one_of_each(no_docs).count() == 0


# repeated substrings ---------------------------------------------------------

def brute_repeats(texts, match=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(s[i:i + match] for s in raws for i in range(len(s) - match + 1))
    out = []
    for s in raws:
        gone = [False] * len(s)
        end = 0
        for i in range(len(s) - match + 1):
            if seen[s[i:i + match]] > 1:
                gone[max(i, end):i + match] = [True] * (i + match - max(i, end))
                end = i + match
        kept = bytes(c for c, g in zip(s, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(s), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(90, 400)) for _ in range(4)]
    texts = [None, "", "short", "ab " * 400, "x" * 399, "x" * 400, "x" * 900, prose(2000)]
    for _ in range(14):
        parts = [prose(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 3)
            parts += [p[a:rng.randint(a + 300, len(p)) if len(p) > a + 300 else len(p)], prose(rng.randint(0, 60))]
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[7][500:9000] + "!"]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_samples_do_not_depend_on_slabs(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choices(b"abcd ", k=6000))
    whole = [x.tolist() for x in suffix_dedup.samples(text)]
    monkeypatch.setattr(suffix_dedup, "_SLAB", 700)
    assert [x.tolist() for x in suffix_dedup.samples(text)] == whole


def test_naming_long_texts_takes_little_memory(monkeypatch):
    class Caught:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run
    monkeypatch.setattr(suffix_dedup, "_with_text", lambda *_: Caught())
    run = suffix_dedup.prefix_names(None, None, 400, 100)
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abcdefgh ", k=50_000)) for _ in range(10)]
    asked = [[{"rid": rid, "start": s, "range": r, "open": n % 3 == 0}
              for n, (s, r) in enumerate(zip(*suffix_dedup.text_pieces(t)[2:]))] for rid, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("rid", pa.int64()), ("start", pa.int64()), ("range", pa.int32()), ("open", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"", *map(zstandard.ZstdCompressor().compress, texts)]), pa.array([[], *asked], kind)],
        names=["packed", "asked"]).slice(1)
    count = 0
    tracemalloc.start()
    for b in run([batch]):
        count += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == sum(len(t) - 399 for t in texts) and peak < 20e6
    got = [r for b in run([batch]) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = []
    for text, mine in zip(texts, asked):
        for r in mine:
            low, high = divmod(r["range"], 100)
            for i in range(r["start"] - high, r["start"] - low + 1):
                name = xxhash.xxh3_128_digest(text[i:i + 400])
                want.append((*(int.from_bytes(name[x:x + 8], "little", signed=True) for x in (0, 8)), r["rid"], i, r["open"]))
    assert got == want


def test_piece_batches_are_the_rows_however_cut(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abcd ", k=rng.choice((0, 50, 3000)))).decode() for _ in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(range(301)), pa.array(texts)],
                                       names=["rid", "doc_id", "text"])
    whole = pa.Table.from_batches(suffix_dedup.piece_batches(batch)).to_pylist()
    monkeypatch.setattr(suffix_dedup, "_PIECES", 60)
    cut = list(suffix_dedup.piece_batches(batch))
    assert len(cut) > 20 and pa.Table.from_batches(cut).to_pylist() == whole
    for r, text in zip(whole, texts):
        raw = (text or "").encode()
        assert (r["sha"], r["n_bytes"]) == (hashlib.sha256(raw).digest(), len(raw))
        assert [r["core"], r["frame"], r["start"], r["range"]] == list(suffix_dedup.text_pieces(raw))


def test_packed_batches_hold_every_text():
    texts = [None, "", "é\u2028x" * 50, *(f"text {i} " * (i % 9) for i in range(600))]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(602)], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = list(suffix_dedup.packed_batches(batch))
    assert max(b.num_rows for b in got) == 256
    raw = [(t or "").encode() for t in texts]
    rows = pa.Table.from_batches(got).to_pydict()
    assert rows["__d"] == [None, *range(602)] and rows["__s"] == [hashlib.sha256(r).digest() for r in raw]
    assert [zstandard.ZstdDecompressor().decompress(p) for p in rows["packed"]] == raw


def test_repeats_on_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = suffix_dedup.remove_repeats(odd_docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(r["doc_id"], *b) for r, b in zip(rows, brute_repeats([r["text"] for r in rows]))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
