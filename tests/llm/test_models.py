import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.llm import decontamination as D
from courtline.llm import lm_scoring, quality, registry, toxicity


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


# language model --------------------------------------------------------------

def test_lm_counts_match_brute_force(spark, odd_docs, sf):
    docs = odd_docs.select("doc_id", "text").unionByName(
        spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text"))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
    counts = Counter(w for i, ws in rows if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws),
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4), fold(i, 7) == 2) for i, ws in rows)
    got = lm_scoring.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4), r["held_out"])
                  for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    unigram = rng.random(50)
    par = lm_scoring.Parameters.start(unigram / unigram.sum())
    w = np.arange(50)
    logs = lm_scoring.Predictions(par).logs(w, np.full(50, 3), np.full(50, 7))
    assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-4)


def test_lm_tail_probabilities_sum_to_one():
    common = [(f"t{i}", 5) for i in range(lm_scoring.HEAD + 40)]
    tail = {}
    for t, c in [*common, ("", 9)]:
        k = lm_scoring.tail_class(t)
        n, v = tail.get(k, (0, 0))
        tail[k] = (n + c, v + 1)
    vocab = lm_scoring.Vocabulary(common, tail, 9)
    for k in range(lm_scoring.TAIL):
        mine = [c for t, c in common[lm_scoring.HEAD - 1:] if lm_scoring.tail_class(t) == k]
        assert math.isclose((sum(c + 1 for c in mine) + 1) / 10 ** vocab.tail_log[k], 1)


def test_nce_lowers_the_loss():
    rng = np.random.default_rng(0)
    unigram = np.full(20, 0.05)
    par = lm_scoring.Parameters.start(unigram)
    squares = np.full(par.table.shape, 1e-4, np.float32)
    c1 = rng.integers(0, 20, 4000)
    w, c2 = (c1 + 1) % 20, rng.integers(0, 20, 4000)
    before = lm_scoring.Predictions(par).logs(w, c1, c2).mean()
    for _ in range(120):
        lm_scoring.nce_step(par, squares, w, c1, c2, rng.integers(0, 20, 16),
                            np.log(16 * unigram).astype(np.float32), 0.1)
    assert lm_scoring.Predictions(par).logs(w, c1, c2).mean() > before + 1


def plain_softmax(par, c1, c2):
    r, q, bias, m1, m2 = (x.astype(float) for x in par.parts())
    h = r[c1] @ m1 + r[c2] @ m2
    logits = [float(h @ q[k] + bias[k]) for k in range(par.size)]
    top = max(logits)
    total = sum(math.exp(x - top) for x in logits)
    return [x - top - math.log(total) for x in logits]


@pytest.mark.parametrize("spread", [0.3, 40.0])
def test_predictions_equal_a_plain_softmax(spread):
    rng = np.random.default_rng(4)
    par = lm_scoring.Parameters(rng.normal(0, spread, (2 * 12 + 2 * lm_scoring.DIM, lm_scoring.DIM + 1)), 12)
    model = lm_scoring.Predictions(par)
    for c1, c2 in [(0, 0), (3, 7), (11, 2), (5, 5)]:
        got = model.logs(np.arange(12), np.full(12, c1), np.full(12, c2))
        assert np.allclose(got, plain_softmax(par, c1, c2), rtol=1e-9, atol=1e-6)


def test_one_step_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    size, d = 9, lm_scoring.DIM
    table = rng.normal(0, 0.3, (2 * size + 2 * d, d + 1))
    par = lm_scoring.Parameters(table, size)
    w, c1, c2 = (rng.integers(0, size, 40) for _ in range(3))
    noise, log_kp = rng.integers(0, size, 6), rng.normal(0, 0.2, size).astype(np.float32)
    table = par.table.astype(float)
    grad = np.zeros_like(table)
    m1, m2 = table[2 * size:2 * size + d, :d], table[2 * size + d:, :d]
    for x, a, b in zip(w, c1, c2):
        h = table[a, :d] @ m1 + table[b, :d] @ m2
        for k, label in [(x, 1), *((y, 0) for y in noise)]:
            z = h @ table[size + k, :d] + table[size + k, d] - log_kp[k]
            e = 1 / (1 + math.exp(-z)) - label
            grad[size + k, :d] += e * h
            grad[size + k, d] += e
            dh = e * table[size + k, :d]
            grad[a, :d] += m1 @ dh
            grad[b, :d] += m2 @ dh
            grad[2 * size:2 * size + d, :d] += np.outer(table[a, :d], dh)
            grad[2 * size + d:, :d] += np.outer(table[b, :d], dh)
    grad /= len(w)
    want = table - 0.1 * grad / (np.sqrt(1e-4 + grad * grad) + 1e-6)
    lm_scoring.nce_step(par, np.full(table.shape, 1e-4, np.float32), w, c1, c2, noise, log_kp, 0.1)
    assert np.allclose(par.table, want, atol=2e-5)


def test_lm_score_equals_a_plain_loop(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 12")
    trained, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: trained.append(train(*a)) or trained[0])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs).collect()}
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in docs.collect()}
    counts = Counter(w for i, ws in rows.items() if fold(i, 7) != 2 for w in ws)
    head = [b"", *[w for w, _ in sorted(counts.items(), key=lambda r: (-r[1], r[0])) if w][:lm_scoring.HEAD - 1]]
    number = {w: i for i, w in enumerate(head)}
    tail = {w: lm_scoring.tail_class(w.decode()) for ws in rows.values() for w in ws if w not in number}
    sizes = Counter()
    for w, c in counts.items():
        if w in tail:
            sizes[tail[w]] += c + 1
    softmax = {}
    for i, ws in rows.items():
        want, before = 0.0, (0, 0)
        for w in ws:
            k = number[w] if w in number else lm_scoring.HEAD + tail[w]
            if before not in softmax:
                softmax[before] = plain_softmax(trained[0], *before)
            want += softmax[before][k] / math.log(10)
            if w in tail:
                want += math.log10((counts[w] + 1) / (sizes[tail[w]] + 1))
            before = (k, before[0])
        assert math.isclose(got[i], want, rel_tol=1e-5)


def test_commonest_tokens_need_no_sort(spark):
    rows = [(f"t{i:04d}", 500 - i if i < 100 else 3) for i in range(1000)] + [("x" * 80, 9000)]
    counts = spark.createDataFrame(rows, "token string, c long").repartition(7)
    short = rows[:1000]
    assert lm_scoring.commonest(counts, 5000, 64) == sorted(short, key=lambda r: (-r[1], r[0]))
    for k in (100, 130, 1000):
        got = lm_scoring.commonest(counts, k, 64)
        assert got[:100] == short[:100] and k - 10 <= len(got) <= k and len(set(got)) == len(got)
    assert 30 <= len(lm_scoring.commonest(counts, 40, 64)) <= 40
    assert lm_scoring.commonest(counts.limit(0), 40, 64) == []


def test_every_token_is_trained_however_repetitive():
    classes = [np.tile(np.array([5, 6, 7], "<u2"), 3000)] * 4
    got = list(lm_scoring.examples(classes, np.random.default_rng(0)))
    assert sum(len(w) for w, _, _ in got) == 36_000
    assert len(got) == -(-36_000 // lm_scoring.BATCH)


def test_lm_on_an_empty_table(no_docs):
    assert lm_scoring.score(no_docs).count() == 0


# quality ---------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op7_quality_voting(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_quality_on_odd_rows(spark, odd_docs, no_docs, labels):
    got = quality.quality(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r["score"] is not None for r in got)
    none = quality.quality(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality(no_docs, labels).count() == 0


def test_voting_equals_a_plain_loop(spark, labels, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, labels)
    texts = [r["text"] for r in docs.limit(40).collect()]
    v = quality._unit(model.terms(texts) @ model.projection)
    up = model.share / model.labels.mean()
    down = (1 - model.share) / (1 - model.labels.mean())
    for x, s in zip(v, model.scores(texts)):
        near = sorted(((float(x @ y), l) for y, l in zip(model.vectors, model.labels)), reverse=True)
        near = near[:quality.NEIGHBOURS]
        w = [max(c, 0) ** 4 * (up if l else down) for c, l in near]
        assert s == pytest.approx(sum(a * l for a, (_, l) in zip(w, near)) / sum(w), abs=0.02)


# toxicity --------------------------------------------------------------------

def test_toxicity_finds_toxic_and_leaves_clean(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op10_toxicity(spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id").collect()
    toxic = [r for r in got if r["label"]]
    clean = [r for r in got if not r["label"]]
    assert sum(r["toxic"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r["expected_severity"] <= 3 for r in got)


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3)).astype(np.float32)
    s = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=1500)
    grades = np.digitize(s, [-1, 1, 3])
    w, t = toxicity.fit_ordinal(x, grades, 4, ridge=0)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(t, [-1, 1, 3], atol=0.3)


def test_toxicity_on_odd_rows(odd_docs, no_docs, labels):
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns


# decontamination -------------------------------------------------------------

def slow_distance(a, b):
    """Least edit distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_fitting_distance():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 9)), rng.integers(1, 5, rng.integers(0, 14))
        assert D.fitting_distance(a, b)[0] == slow_distance(a.tolist(), b.tolist())


def test_matches_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.length("text") < 4000)
    items = [(r["item_id"], D.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12]
    rng = np.random.default_rng(8)
    extra = []
    for k, (_, w) in enumerate(items):
        e = list(w)
        for _ in range(int(0.15 * len(w))):
            p = int(rng.integers(len(e)))
            e[p:p + 1] = [["new"], [], [e[p], "more"]][int(rng.integers(3))]
        extra.append((10_000 + k, "before it " + " ".join(e) + " after it"))
    docs = docs.select("doc_id", "text").limit(60).unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {}
    for r in docs.collect():
        words = D.words_of(r["text"])
        for i, w in items:
            if len(set(w) & set(words)) >= 0.5 * len(set(w)):
                d = slow_distance(w, words)
                if d <= int(0.2 * len(w)):
                    want[r["doc_id"], i] = d
    got = {(r["doc_id"], r["item_id"]): r["edit_distance"] for r in D.matches(docs, bench).collect()}
    assert got == want and len(want) >= len(items)
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench, block_items=5).collect()} == set(want)


def test_edits_gathered_in_one_part_of_an_item():
    rng = np.random.default_rng(12)
    for n in (50, 59, 100, 127, 160, 250):
        d = n // 5
        items = [(i, [f"w{x}" for x in rng.integers(0, 3000, n)]) for i in range(25)]
        index = D.ItemIndex([(i, " ".join(w)) for i, w in items])
        half, ends = n // 2, [*range(d // 2), *range(n - d + d // 2, n)]
        for places in (range(0, 2 * d, 2), range(n - 2 * d, n, 2), range(d), ends,
                       rng.choice(half, d, False), n - half + rng.choice(half, d, False)):
            found = 0
            for i, w in items:
                edited = [f"new{k}" if k in set(map(int, places)) else x for k, x in enumerate(w)]
                text = ["before"] * 9 + edited + ["after"] * 9
                ids = np.array([index.vocab.get(x, 0) for x in text])
                want = D.fitting_distance(index.items[i][1], ids)[0]
                assert want <= d
                found += (i, want) in [m[:2] for m in index.find(text)]
            assert found == len(items), (n, list(places), found)


def test_every_length_class_finds_its_items():
    rng = np.random.default_rng(8)
    word = [f"v{i}" for i in range(300)]
    items = [(n, " ".join(rng.choice(word, n))) for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 40)]
    index = D.ItemIndex(items)
    assert index.find([]) == [] and index.find(["other"] * 50) == []
    for n, text in items:
        for around in (0, 1, 25):
            noise = [f"z{k}" for k in range(around)]
            found = {i: d for i, d, _ in index.find([*noise, *text.split(), *noise])}
            assert found.get(n) == 0
            plain = {i for i, t in items if D.fitting_distance(
                np.array([index.vocab[w] for w in t.split()]),
                np.array([index.vocab.get(w, 0) for w in [*noise, *text.split(), *noise]]))[0] <= int(0.2 * i)}
            assert set(found) == plain


def test_item_ids_of_any_type(spark):
    text = "seven words that nobody else ever wrote"
    docs = spark.createDataFrame([("d1", f"before {text} after"), ("d2", "nothing")], "doc_id string, text string")
    items = spark.createDataFrame([("b-1", text), ("b-2", "absent from every document of this table")],
                                  "item_id string, text string")
    assert [tuple(r) for r in D.matches(docs, items).collect()] == [("d1", "b-1", 0, 7, 1)]


def test_toxic_sample_does_not_depend_on_partitions(spark, sf, labels):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs.withColumn("text", F.concat_ws(" ", F.reverse(F.split("text", " ")), F.lit("zz"))))
    models = [toxicity.fit(twice.repartition(n, "text"), labels) for n in (2, 7)]
    assert (models[0].features == models[1].features).all() and (models[0].weights == models[1].weights).all()


def test_decontamination_on_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the lazy dog and the dog being lazy"), (4, "!!")],
                                  "item_id long, text string")
    left = D.drop_contaminated(odd_docs, bench)
    assert left.columns == odd_docs.columns
    assert all("lazy dog" not in " ".join((r["text"] or "").split()) for r in left.collect())
    assert D.drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert D.matches(no_docs, bench).count() == 0


def test_token_counts_do_not_depend_on_when_they_are_handed_on(spark, monkeypatch):
    texts = ["A b\x0bc D É é", None, "", "x" * 90 + " A a \x1f a", "b\tB\r\nb"] * 7
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter()
    for i, text in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            want.update([w for w in re.split(r"[\x20\x09-\x0D]+", plain) if w] + [""])
    for held, size in ((1 << 17, 1 << 26), (2, 1 << 26), (1 << 17, 5)):
        monkeypatch.setattr(lm_scoring, "HELD", held, raising=False)
        monkeypatch.setattr(lm_scoring, "HELD_BYTES", size, raising=False)
        counts = lm_scoring.token_counts(docs)
        assert "MapInArrow" in counts._jdf.queryExecution().executedPlan().toString()
        got = counts.collect()
        assert {r["token"]: r["c"] for r in got} == want and len(got) == len(want)
        assert all(r["class"] == lm_scoring.tail_class(r["token"]) for r in got)


def test_contexts_and_tail_classes_equal_plain_loops():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 1024, n).astype("<u2") for n in (1, 2, 3, 40, 0, 1)]
    want = [(int(c[i]), int(c[i - 1]) if i else 0, int(c[i - 2]) if i > 1 else 0) for c in texts for i in range(len(c))]
    assert list(zip(*(x.tolist() for x in lm_scoring.contexts(texts)))) == want
    got = [tuple(map(int, row)) for part in lm_scoring.examples(texts, np.random.default_rng(1)) for row in zip(*part)]
    assert sorted(got) == sorted(want)
    words = [b"a", b"abc", "né".encode(), "éa".encode(), b"\xff\xc3", b"x\xff"]
    assert lm_scoring.tail_classes(words).tolist() == [
        lm_scoring.tail_class(w.decode("utf-8", "replace")) for w in words]
