import math

import numpy as np

from thoughtloom.llm import topk


def brute(rows, queries, k=5, scale=256):
    def q(v):
        return [math.floor(scale * float(x)) for x in v]

    usable = [(i, q(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qid in sorted({i for i, _ in usable if i in queries}):
        qv = min(v for i, v in usable if i == qid)
        ranked = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != qid)[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as grp", "2 as score", "3 as v")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k)
    return sorted(tuple(r) for r in got.collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SCORES", 500)
    monkeypatch.setattr(topk, "BATCH_BYTES", 300)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(420, 7)).astype(np.float32))]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf")]), (2200, []), (2250, [0.5]), (None, [1.0])]
    rows += [(7, rows[9][1]), (100, rows[3][1])]
    assert run(spark, rows) == sorted(brute(rows, {i for i in range(0, 5000, 50)}))


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**45, 1.0]), (1, [2.0, 3.0]), (2, [2.0, 4.0]), (3, [-1.0, 4.0])]
    assert run(spark, rows, 2) == sorted(brute(rows, {0}, 2))


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_batches_of_one_query(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(160, 5)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 3, batch_bytes=1)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, set(range(0, 200, 50)), 3))


def test_the_cutoff_spares_most_products():
    """Clustered vectors: entries outside a query's cluster are dropped before their last lists are opened."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 64))
    vectors = centres[rng.integers(0, 20, 3000)] + 0.1 * rng.normal(size=(3000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    ids, queries, own = np.arange(3000), vectors[:40], np.arange(40)
    scores = queries @ vectors.T
    scores[own, own] = -(10**9)
    taus = np.sort(scores, axis=1)[:, -5].astype(float)
    q, c, score, opened = topk.sufficient_entries(queries, own, taus, vectors, ids)
    assert opened < 0.6 * topk.LISTS * scores.size
    assert sorted(zip(q.tolist(), c.tolist())) == sorted(map(tuple, np.argwhere(scores >= taus[:, None]).tolist()))
    assert (score == scores[q, c]).all()
    first = topk.first_entries(queries, own, vectors, ids, 5)
    assert all((first[0] == i).sum() == 5 and not (first[1][first[0] == i] == i).any() for i in range(40)) and (first[2] == scores[first[0], first[1]]).all()
