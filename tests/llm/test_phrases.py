"""Phrase mining against counting by dictionaries and against SQL."""

import re
from collections import Counter

import numpy as np
import pytest

from compare import duck, rows_of
from courtline.llm import phrases, statements

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, min_count=10, max_words=3, top=2000, cover=50):
    """The contract, by counting every phrase of every language in a dictionary."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= cover * a
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.mine_phrases(df, **options).select(*COLUMNS).collect())


def some_texts(seed, n=120, words=12, size=80):
    rng = np.random.default_rng(seed)
    vocab = ["The", "of", "Ünïcode", "x", "yy", "zz", "a-b", "\x01", "e", "new", "york", "<P>"][:words]
    ends = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", " ! "]
    weight = 1 / np.arange(1, len(vocab) + 1)
    return [(["en", "de", None, "und"][int(rng.integers(4))],
             "".join(w + ends[int(e)] for w, e in zip(rng.choice(vocab, size, p=weight / weight.sum()),
                                                      rng.integers(len(ends), size=size)))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500, "chunk_bytes": 1500}, {"bucket_bytes": 40},
                                     {"max_words": 4, "bucket_bytes": 300}, {"min_count": 3, "top": 5}])
def test_equals_counting(spark, options):
    rows = some_texts(3) + [(None, None), ("en", ""), ("de", " .,; "), ("en", "york " * 2000)]
    df = spark.createDataFrame([(i, lang, t, 1, 2) for i, (lang, t) in enumerate(rows)],
                               "doc_id long, lang string, text string, rank long, n int").repartition(5)
    own = {k: v for k, v in options.items() if k in ("min_count", "max_words", "top")}
    assert mined(df, **options) == plain(rows, **own)


def test_heavy_routes_are_used_and_change_nothing(spark):
    # a third of all words is one pair with ever other words behind it
    rows = [("en", f"hot pair w{i} v{i} w{i % 50}") for i in range(2000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    heavy = phrases.heavy_phrases(df, 20, 3, 4000)
    assert len(heavy) == 3        # each word of the pair, and the pair
    assert mined(df, bucket_bytes=2000, chunk_bytes=4000) == plain(rows)


def test_three_way_quicksort_equals_counter():
    rng = np.random.default_rng(5)
    for n, vocab in ((0, 3), (1, 1), (400, 4), (3000, 300)):
        keys = [rng.integers(0, vocab, n)]
        for _ in range(2):
            keys.append(np.where((keys[-1] >= 0) & (rng.random(n) < 0.8), rng.integers(0, vocab, n), -1))
        weight = rng.integers(1, 4, n)
        want = Counter()
        for row in zip(*keys, weight):
            for size in (1, 2, 3):
                if min(row[:size]) >= 0:
                    want[tuple(int(x) for x in row[:size])] += int(row[3])
        got = {}
        for size, pointers, counts in phrases.three_way_phrases(keys, weight, 4):
            for p, c in zip(pointers.tolist(), counts.tolist()):
                phrase = tuple(int(k[p]) for k in keys[:size])
                assert phrase not in got
                got[phrase] = c
        assert got == {p: c for p, c in want.items() if c >= 4}


def test_empty_table_and_odd_documents(spark, no_docs, odd_docs):
    assert mined(no_docs) == []
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert mined(odd_docs) == plain(rows)


def test_equals_sql(spark, sf):
    con = duck(sf)
    cur = con.execute(statements.PHRASES_SQL)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = phrases.mine_phrases(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
