import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from scanloom.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, k=5, every=50):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in data if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = set()
    for i, q in good:
        if i % every == 0:
            hits = sorted((-int(q @ v), j) for j, v in good if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)}
    return out


def rows(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [(i, [float(x) for x in centres[i % 5] + 0.2 * rng.normal(size=dim)], 0) for i in range(n)]


def found(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS score", "2 AS rank", "'x' AS vec")
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.nearest(df, **more).collect()}


def test_results_are_those_of_brute_force(spark):
    data = rows(1500, 0)
    same = data[50][1]
    data += [(2000 + i, same, 0) for i in range(300)]  # ties, among them queries
    data += [(5000, None, 0), (5050, [], 0), (5100, [None] * 8, 0), (5150, [float("nan")] * 8, 0), (5200, [float("inf")] + [0.0] * 7, 0), (None, data[0][1], 0), data[3], (5250, [1.0] * 3, 0)]
    assert found(spark, data) == brute([r for r in data if r[0] != 5250])


def test_many_trees(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 60)
    monkeypatch.setattr(mtree, "LEAF", 8)
    monkeypatch.setattr(mtree, "FAN", 4)
    monkeypatch.setattr(mtree, "CHUNK", 7)
    data = rows(900, 1)
    assert found(spark, data, every=20) == brute(data, every=20)


def test_more_roots_than_are_broadcast(spark, monkeypatch):
    for name, value in (("TREE", 40), ("PIVOTS", 4), ("ROOTS", 3), ("LEAF", 8), ("FAN", 4), ("CHUNK", 9)):
        monkeypatch.setattr(mtree, name, value)
    data = rows(700, 6)
    assert found(spark, data, every=20) == brute(data, every=20)


@pytest.mark.parametrize("power", [14, 18, 21, 22, 24, 40, 400])
def test_scores_of_large_components_are_exact(spark, power):
    rng = np.random.default_rng(power)
    data = [(i, [float(x) for x in rng.uniform(-1, 1, 16) * 2.0**power], 0) for i in range(300)]
    data += [(1000 + i, [x * (1 + (j == i % 16) * 2.0**-40) for j, x in enumerate(data[i % 10][1])], 0) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in data], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.nearest(df, every=50).collect()}
    whole = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v, *_ in data}
    low, high = mtree.LONG
    for q in (i for i in whole if i % 50 == 0):
        hits = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), j) for j, v in whole.items() if j != q)[:5]
        assert {r for r in got if r[0] == q} == {(q, n + 1, j, min(max(-s, low), high)) for n, (s, j) in enumerate(hits)}


def test_stored_distances_spare_computations():
    """The share of a tree's vectors that a search computes no distance to: of clustered vectors most."""
    rng = np.random.default_rng(5)
    v = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))))
    space = mtree.Space(16, False, 0, float((v * v).sum(axis=1).max()))
    vecs = pd.DataFrame({"vec": [x.astype("<i4").tobytes() for x in v], "ids": [[i] for i in range(len(v))]})
    tree = mtree.Tree(mtree._grower(space)((0,), vecs).drop(columns="tree"), space)
    for i in range(0, 4000, 50):
        tree.search(v[i], i, 5, math.inf)
    assert tree.size == 4000 and tree.computed < 0.5 * 80 * tree.size


def test_few_rows(spark):
    assert found(spark, rows(3, 2)) == brute(rows(3, 2))
    assert found(spark, rows(1, 2)) == set()
    assert mtree.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_bound_what_they_hold():
    rng = np.random.default_rng(3)
    v = mtree.Space(6, False, 0, 1e7).lift(np.floor(256 * rng.normal(size=(3000, 6))))
    pages = mtree.build(v)

    def held(n):
        p = pages[n]
        return p["rows"] if p["leaf"] else np.concatenate([held(c) for c in p["child"]])

    assert sorted(held(0).tolist()) == list(range(3000))
    for p in pages:
        for pivot, radius, child in zip(p["rows"], p["radius"], p["child"], strict=True):
            if not p["leaf"]:
                own = np.sqrt(((v[held(child)] - v[pivot]) ** 2).sum(axis=1))
                assert own.max() <= radius + 1e-6
                near = np.sqrt(((v[pages[child]["rows"]] - v[pivot]) ** 2).sum(axis=1))
                assert np.allclose(near, pages[child]["near"], atol=1e-6)
