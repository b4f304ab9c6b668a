"""Neighbours against brute force, and the error bound."""

import numpy as np
import pytest

from mixloom.llm import ann


def plain(vectors, k):
    """Nearest other rows of every id divisible by 20, best first, ties to the smaller id."""
    out = {}
    for q, v in sorted(vectors):
        if q % 20 == 0:
            scored = sorted((-(np.array(v) * np.array(w)).sum(), i) for i, w in vectors if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_bound_holds_for_nearly_all():
    rnd = np.random.default_rng(0)
    vectors, queries = rnd.standard_normal((2_000, 64)) + 0.5, rnd.standard_normal((50, 64))
    estimated, error = ann.estimate(queries, ann.encode(vectors))
    outside = np.abs(queries @ vectors.T - estimated) > error + 1e-9
    assert outside.mean() < 0.01
    assert ann.encode(vectors)["bits"].nbytes == 2_000 * 8


@pytest.mark.parametrize("block, queries", [(8192, 1024), (64, 3)])
def test_neighbours(spark, block, queries):
    rnd = np.random.default_rng(1)
    vectors = [(i, rnd.standard_normal(24).round(3).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(60)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, [float("inf")] * 24),
           (None, vectors[0][1]), (2100, [])]
    short = [(3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors + bad + short], "vec_id long, embedding array<double>, rank int")
    rows = ann.nearest(df.repartition(5), block_rows=block, query_rows=queries).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    want = plain(vectors + short, 20)
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    exact = {i: np.array(v) for i, v in vectors + short}
    for q, neighbours in found.items():
        assert all(s == pytest.approx((exact[q] * exact[i]).sum(), abs=1e-12) for i, s in neighbours)
        assert neighbours == sorted(neighbours, key=lambda x: (-x[1], x[0]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df).collect() == []


def test_few_vectors_of_a_block_are_sorted(monkeypatch):
    rnd, k = np.random.default_rng(2), 20
    vectors = rnd.standard_normal((4_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids, sizes = np.arange(len(vectors)), []
    sort = np.lexsort
    monkeypatch.setattr(ann.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    q, v, s = ann.search_block(ids[:50], vectors[:50], ids, vectors, ann.encode(vectors), k)
    assert max(sizes) < 10 * k
    exact = vectors[:50] @ vectors.T
    exact[ids[:50], ids[:50]] = -np.inf
    assert v.reshape(50, k).tolist() == np.argsort(-exact, axis=1)[:, :k].tolist()
    assert q.tolist() == np.repeat(ids[:50], k).tolist()
    assert s == pytest.approx(np.sort(exact, axis=1)[:, ::-1][:, :k].ravel(), abs=1e-12)
