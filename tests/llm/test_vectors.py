"""Vector operators against brute force, with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm.topk import top_products
from beaconry.llm.vector_dedup import near_duplicates, spherical_kmeans

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, cell int"


def rows(rng, n=120, d=8):
    base = rng.normal(size=(n, d)).astype(np.float32)
    base[10:40] = base[0] + rng.normal(scale=0.05, size=(30, d)).astype(np.float32)
    base[50:60] = base[50]
    data = [(i, base[i].tolist(), int(i % 3 == 0), "x", 1) for i in range(n)]
    return data + [(n, None, 1, None, None), (n + 1, [0.0] * d, 1, None, None), (n + 2, [float("nan")] * d, 1, None, None),
                   (n + 3, [None, *[1.0] * (d - 1)], 1, None, None), (n + 4, base[50].tolist(), None, None, None),
                   (n + 5, [], 1, None, None), (n + 6, [1.0, 2.0], 1, None, None), (n + 7, [2.0, 4.0], 1, None, None),
                   (None, base[3].tolist(), 1, None, None), (5, base[5].tolist(), int(5 % 3 == 0), "again", 2)]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicates(spark):
    data = rows(np.random.default_rng(3))
    got = near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    ok = [(i, np.array(v, dtype=float), y) for i, v, y, *_ in data if i is not None and y is not None and good(v)]
    links, parent = {}, {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for n, (i, v, y) in enumerate(ok):
        count = 0
        for m, (j, w, z) in enumerate(ok):
            if n != m and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                count += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        links[i] = count
    for r in got:
        assert r.n_links == links.get(r.vec_id, 0), r
        want = None if r.vec_id is None else find(r.vec_id)
        assert r.component_id == want and r.kept == (want is None or want == r.vec_id)


def test_top_products(spark):
    data = [r for r in rows(np.random.default_rng(5))]
    got = {}
    for r in top_products(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vec = {}
    for i, v, *_ in data:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            x = np.zeros(8)
            x[:len(v)] = np.floor(256 * np.array(v, dtype=np.float32).astype(float))
            vec[i] = x
    want = {}
    for q in vec:
        if q % 10 == 0:
            best = sorted((-int(vec[q] @ x), i) for i, x in vec.items() if i != q)[:5]
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want


@pytest.mark.parametrize("make", [near_duplicates, lambda v: top_products(v, F.col("vec_id") % 2 == 0)])
def test_empty(spark, make):
    assert make(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(make(spark.createDataFrame([(2, [1.0], 1, "x", 1)], SCHEMA)).collect()) <= 1


def test_kmeans_centroids_are_units():
    x = np.random.default_rng(1).normal(size=(200, 5))
    c = spherical_kmeans(x / np.linalg.norm(x, axis=1)[:, None], 7)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
