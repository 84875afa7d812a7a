"""Vector links and top-k against brute force."""

import numpy as np
import pytest

from lacuna.llm import topk, vectors


def clustered(seed=1, n=900, dims=24, copies=120):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    for i in range(copies):  # near copies of a few, one of them hot
        v[n - 1 - i] = v[0 if i < copies // 2 else i % 7] + rng.normal(size=dims) * 0.1
    v[5], v[6] = v[4], v[4] * 3
    return v.astype(np.float32)


def frame(spark, v, more=()):
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(ids, v, cosine=0.95):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        new = np.array([min(comp[i], comp[near[i]].min(initial=comp[i])) for i in range(len(ids))])
        if (new == comp).all():
            return near.sum(1), comp
        comp = new


@pytest.mark.parametrize("cell,chunk,recall", [(1024, 2048, None), (64, 40, None), (256, 200, 1.0)])
def test_links_against_brute_force(spark, monkeypatch, cell, chunk, recall):
    monkeypatch.setattr(vectors, "CELL", cell)
    v = clustered()
    bad = [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [], 1), (5003, [float("nan")] * 24, 1), (5004, [None] + [1.0] * 23, 1), (5005, [float("inf")] * 24, 1), (5006, v[0].tolist()[:23], 1)]
    df = frame(spark, v, bad).selectExpr("*", "1 as id", "2 as links")
    monkeypatch.setattr(vectors, "near_links", (lambda f: lambda d, n, c, r: f(d, n, c, r, chunk))(vectors.near_links))
    got = {r.vec_id: r for r in vectors.near_duplicates(df, recall=recall or vectors.RECALL).collect()}
    links, comp = brute(range(len(v)), v)
    assert len(got) == len(v) + len(bad)
    if recall:  # the exact way
        assert [got[i].n_links for i in range(len(v))] == links.tolist() and [got[i].component_id for i in range(len(v))] == comp.tolist()
    found = sum(got[i].n_links for i in range(len(v)))
    assert found >= 0.999 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(v)))  # none below the bound
    assert np.mean([got[i].component_id == comp[i] for i in range(len(v))]) > 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in bad)


def test_copies_and_repeated_rows(spark):
    x = [1.0, 2.0, 3.0]
    df = frame(spark, np.empty((0, 3)), [(4, x, 0), (9, x, 0), (2, x, 1), (2, x, 1), (None, x, 0), (7, [3.0, -2.0, 1.0], 0)])
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.deduplicate_embeddings(df).collect())
    assert got == [("2", 3, 2, True), ("2", 3, 2, True), ("4", 3, 2, False), ("7", 0, 7, True), ("9", 3, 2, False), ("None", 0, None, True)]
    assert vectors.deduplicate_embeddings(df.limit(0)).collect() == []


def test_calibration():
    for n in (10, 1000, 10**5, 10**9):
        plan = vectors.calibrate(n)
        assert vectors.tail(plan["m"], plan["p"], plan["threshold"]) >= vectors.RECALL
        assert plan["bits"] <= 30 and plan["threshold"] >= vectors.LEAST
        assert vectors.tail(plan["m"], plan["p"], plan["threshold"] + 1) < vectors.RECALL  # the greatest count that keeps the recall


def plain_top(ids, ints, q, k=10):
    scores = [(-int(np.dot(ints[q].astype(object), ints[i].astype(object))), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
    return [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.mark.parametrize("scale", [1.0, 5e4])
def test_top_k_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "PIVOTS", 40)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(450, 37)) * scale).astype(np.float32)
    v[7] = v[3]
    df = frame(spark, v, [(500, None, 0), (600, [float("nan")] * 37, 0), (700, [1.0, 2.0], 0), (None, v[0].tolist(), 0)]).selectExpr("*", "1 as id", "2 as score", "3 as dims")
    ints = np.array([[int(np.floor(1024 * float(x))) for x in r] for r in v], object)
    got = {}
    for r in topk.search_embeddings(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == {0, 100, 200, 300, 400}
    for q in got:
        assert got[q] == plain_top(list(range(450)), ints, q)


def test_top_k_small_tables(spark):
    df = frame(spark, np.ones((3, 4)))
    assert [(r.vec_id, r["rank"]) for r in topk.search_embeddings(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk.search_embeddings(df.limit(0)).collect() == []
