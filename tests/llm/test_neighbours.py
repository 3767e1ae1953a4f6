from __future__ import annotations

import numpy as np

from citetrail.llm import neighbours as N


def clusters(n, dims, seed, size=4, noise=0.45):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // size, dims))
    x = np.repeat(centres, size, axis=0) + noise * rng.standard_normal((n // size * size, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(ids, x, k, least):
    order = np.argsort(ids)
    ids, x = np.array(ids)[order], x[order].astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        hit = np.flatnonzero(s[i] >= least)
        out |= {tuple(sorted((ids[i], ids[j]))) for j in hit[np.lexsort((hit, -s[i][hit]))][:k]}
    return out


def test_graph_recall():
    x = clusters(3000, 64, 1)
    q, n, _ = N.shard_neighbours(x, 7, 0.7, N.IndexParams(dims=64, plane=48))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.7}
    assert len(want & set(zip(q.tolist(), n.tolist(), strict=True))) >= 0.95 * len(want)


def test_recall_over_shards(spark):
    x = clusters(1200, 32, 2)
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in zip(ids, x, strict=True)], "id string, embedding array<float>, shard string")
    params = N.IndexParams(dims=32, shard=150, plane=24, fanout=40, near=0.1)
    got = {(r.a, r.b) for r in N.similar_pairs(df, params=params).collect()}
    want = brute(ids, x, 5, 0.7)
    assert len(got & want) >= 0.9 * len(want)
    s = dict(zip(ids, x, strict=True))
    assert all(a < b and float(s[a] @ s[b]) >= 0.7 - 1e-5 for a, b in got)


def test_dirty_copies_and_ties(spark):
    p = N.IndexParams(dims=4)
    one, two, far = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    bad = [None, [], [1.0], [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0]]
    rows = [(f"a{i}", one) for i in range(9)] + [("b", two), ("b", two), ("z", far), (None, one)] + [(f"x{i}", v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, embedding array<float>, h int")
    got = {(r.a, r.b) for r in N.similar_pairs(df, params=p).collect()}
    ids, vs = [f"a{i}" for i in range(9)] + ["b", "z"], np.array([one] * 9 + [two, far], np.float32)
    assert got == brute(ids, vs, 5, 0.7)
    assert N.similar_pairs(df.limit(0), params=p).count() == 0
    assert N.similar_pairs(df.where("id like 'x%'"), params=p).count() == 0


def test_shards_are_bounded(spark):
    """Three levels of tiny shards, a third of all rows in one place: no shard is over twice its size, no vector in many."""
    rng = np.random.default_rng(4)
    x = np.concatenate([clusters(1600, 32, 3, noise=0.25), clusters(8, 32, 5, 8)[:1] + 0.02 * rng.standard_normal((800, 32)).astype(np.float32)])
    rows = [(f"c{i:05d}", v.tolist()) for i, v in enumerate(x)] + [("copy%d" % i, x[0].tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    p = N.IndexParams(dims=32, shard=40, fanout=4, levels=5, near=0.05, plane=32)
    sent, shards = N.shards_of(df, len(rows), p)
    distinct = sent.select("shard", "h").distinct().cache()
    sizes = [r["count"] for r in distinct.groupBy("shard").count().collect()]
    assert max(sizes) <= 2 * p.shard and len(sizes) <= shards and len(sizes) > 4 * p.fanout
    copies = [r["count"] for r in distinct.groupBy("h").count().collect()]
    assert len(copies) == 2400 and max(copies) <= p.levels + 2
    got = {(r.a, r.b) for r in N.similar_pairs(df.withColumnRenamed("vector", "embedding"), params=p).collect()}
    want = brute([r[0] for r in rows[:1600]], x[:1600], 5, 0.7)
    assert len({(a, b) for a, b in got if a < "c01600" and b < "c01600"} & want) >= 0.8 * len(want)
