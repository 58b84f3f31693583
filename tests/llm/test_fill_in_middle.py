"""Fill-in-the-middle: the block tree against plain slicing, round trips, and SQL."""

import hashlib
import re

import numpy as np

from compare import duck, rows_of
from courtline.llm import fill_in_middle as fim
from courtline.llm import statements


def lines_of(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def test_cuts_equal_plain_slicing():
    rng = np.random.default_rng(1)
    texts = ["", "\n", "a", "a\n", "\n\n\n", "äöü\n€uro", "one line without an end " * 500, "x\n" * 5000]
    texts += ["".join(rng.choice(list("ab\n €😀"), int(rng.integers(1, 400)))) for _ in range(60)]
    for text in texts:
        units = lines_of(text)
        for block in (1, 3, 16, 4096):
            tree = fim.BlockTree(text.encode(), block)
            assert tree.total_units == len(units)
            for k in {0, 1, len(units) // 2, len(units) - 1, len(units)} - {-1}:
                head = "".join(units[:k])
                assert tree.cut(k) == (len(head.encode()), len(head))


def plain(doc_id, text):
    text = text or ""
    units = lines_of(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h4 % 100 < 50:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_operator_equals_plain_form_and_round_trips(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(100 + i, t) for i, t in enumerate(["a<P>b", "<S", "<S\n<M\n<", "l1\nl2 <\nS>\n", "<M>", "\n<P\n>\n"])]
    rows += [(200 + i, "line <\n" * i) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "doc_id long, text string, output string, n int").repartition(3)
    out = fim.fill_in_middle(df)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((plain(*r) for r in rows), key=repr)
    back = [r[0] for r in out.select(fim.restored()).collect()]
    assert sorted(back) == sorted(t or "" for _, t in rows)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_empty_table_and_share_left_plain(spark, no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0
    df = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id int, text string")
    forms = [r.form for r in fim.fill_in_middle(df, fim_percent=50, spm_percent=0).collect()]
    assert 120 < forms.count("plain") < 280 and "spm" not in forms


def test_equals_sql(spark, sf):
    cur = duck(sf).execute(statements.FILL_IN_MIDDLE_SQL)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = fim.digests(fim.fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet")))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
