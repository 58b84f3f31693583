"""Embedding near-dedup against comparing all pairs."""

import numpy as np
import pytest

from compare import duck, rows_of
from courtline.llm import embedding_dedup as cap
from courtline.llm import statements

SCHEMA = "vec_id long, label int, embedding array<float>, key string, node int, copies int"


def plain(rows, link=0.93):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    n = len(rows)
    near = [set() for _ in range(n)]
    sound = []
    for i, (_, label, v) in enumerate(rows):
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            sound.append((i, label, x / np.abs(x).max()))
    for a, (i, la, x) in enumerate(sound):
        for j, lb, y in sound[a + 1:]:
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= link:
                near[i].add(j)
                near[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        least = min(ids) if ids else None
        for j in group:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    out = cap.near_vectors(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def planted(rng, n, dim, groups):
    """Random vectors and, for (size, cosine), groups around a vector with about that cosine between members."""
    vectors = list(rng.normal(size=(n, dim)))
    for size, cos in groups:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            noise = rng.normal(size=dim)
            noise -= (noise @ centre) * centre
            noise /= np.linalg.norm(noise)
            t = np.sqrt(cos)
            vectors.append(float(rng.uniform(0.1, 9)) * (t * centre + np.sqrt(1 - t * t) * noise))
    return vectors


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    vectors = planted(rng, 300, 64, [(60, 0.97), (25, 0.95), (2, 0.94), (2, 0.99), (40, 0.935)])
    order = rng.permutation(len(vectors))
    rows = [(int(i) + 5, int(rng.integers(2)), [float(x) for x in vectors[i]]) for i in order]
    rows += rows[:3] + [(1000 + i, 0, rows[10][2]) for i in range(50)]
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, split=16) == want      # every crowded meeting place dealt into blocks


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -1.0, 2.0]
    rows = [(1, 0, None), (2, 0, []), (3, 0, [0.0, 0.0, 0.0]), (4, 0, [1.0, None, 2.0]), (5, 0, [nan, 1.0, 1.0]),
            (6, 0, [inf, 1.0, 1.0]), (7, None, good), (8, None, good), (9, 0, good), (10, 0, good), (10, 0, good),
            (11, 1, good), (12, 0, [1.0, -2.0, 4.0]), (13, 0, [1e30, -2e30, 4e30]), (14, 0, [-0.5, 1.0, -2.0]),
            (None, 0, good), (None, 2, good), (15, 0, [1.0]), (16, 0, [3.0]), (17, 0, [-3.0]), (18, 0, [1.0, 0.0]),
            (19, 0, [0.5, -0.0, 0.0]), (20, 0, [0.5, 0.0, 0.0])]
    assert found(spark, rows) == plain(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert cap.near_vectors(empty).count() == 0


@pytest.mark.parametrize("cos", [0.931, 0.95])
def test_recall_of_filters(cos):
    """Of pairs at one cosine, at least 99.5 % share a filter."""
    rng = np.random.default_rng(9)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = cos * u + np.sqrt(1 - cos * cos) * w
    for words in (8, 50, 200):
        share = [len(np.intersect1d(a, b)) for a, b in zip(cap.exceeded(u, words), cap.exceeded(v, words))]
        assert np.mean(np.array(share) > 0) >= 0.995


def test_list_decoding_finds_all_exceeded_filters():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(50, 10))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code = cap.ProductCode(0, 10, 12)
    owner, filters = code.decode(u)
    first, second = code.products(u)
    sums = (first[:, :, None] + second[:, None, :]).reshape(50, -1)
    least = np.minimum(code.threshold, np.sort(sums, axis=1)[:, -cap.FILTERS])
    want = np.nonzero(sums >= least[:, None] - 1e-9)
    assert (owner == want[0]).all() and (filters == want[1]).all()


def test_equals_sql(spark, sf):
    cur = duck(sf).execute(statements.EMBEDDINGS_SQL)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = cap.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
