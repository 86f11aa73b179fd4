"""Recall where most points are inserted greedily, over full shards and blocks of queries; components of any size."""

import numpy as np
import pytest

from sparksift.llm import neighbours

RNG = np.random.default_rng(5)


def recall(found, x, queries):
    hit = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(found.get(q, ())))
    return hit / (20 * len(queries))


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_greedy_insertion(spread):
    x = RNG.standard_normal((4000, 64)) * np.exp(spread * RNG.standard_normal((4000, 1)))
    g = neighbours.Graph(x, batch=100)  # 200 points by force, 3,800 by search
    queries = np.arange(0, 4000, 40)
    ids, _ = g.search(np.hstack([x[queries] / np.linalg.norm(x[queries], axis=1, keepdims=True), np.zeros((100, 1))]).astype(np.float32), 512)
    found = {}
    for q, row in zip(queries.tolist(), ids, strict=True):
        row = row[(row >= 0) & (row != q)]
        found[q] = row[np.argsort(-(x[row] @ x[q]))][:20].tolist()
    assert recall(found, x, queries.tolist()) >= 0.9


def test_full_shards_and_blocks(spark):
    x = RNG.standard_normal((3600, 48))
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, block int").repartition(6)
    got = neighbours.nearest(vectors, lambda i: i % 20 == 0, shard=1200, block=50, batch=100).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 3600, 20)) and all(len(v) == 20 for v in found.values())
    assert recall(found, x, sorted(found)) >= 0.9


def test_huge_and_tiny_components(spark):
    x = np.vstack([RNG.standard_normal((30, 4)) * 1e150, RNG.standard_normal((30, 4)) * 1e-150, np.full((1, 4), 1e160)])
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60} and len(got) == 80 and not any(np.isnan(r.score) for r in got)


def test_a_shard_measures_its_beam():
    x, q = RNG.standard_normal((3000, 48)), RNG.standard_normal((64, 48))
    g, asked = neighbours.Graph(x, batch=100), neighbours._asking(q)
    some, most = g.fitting(asked, 4, 64, 512), g.fitting(asked, 21, 64, 512)
    assert some <= most
    for beam, nearest in ((some, 4), (most, 21)):
        ids, _ = g.search(asked, beam)
        true = np.argsort(-(q @ x.T), axis=1)  # not by the lifted points: those order alike
        near = np.argsort(-(asked @ g.points.T), axis=1)[:, :nearest]
        assert (near[:, 0] == true[:, 0]).mean() > 0.95
        assert np.mean([np.isin(t, f).mean() for t, f in zip(near, ids, strict=True)]) >= neighbours.RECALL
    assert g.fitting(asked[:0], 4, 64, 512) == 512
    assert g.fitting(asked, 4, 64, 512) < 512  # every query took 512 in every shard before


def test_shards_grow_slower_than_points():
    assert [neighbours.shards_of(n, 1000) for n in (0, 900, 3600, 4000, 16_000, 64_000)] == [1, 1, 4, 4, 8, 16]
    assert neighbours.shards_of(10_000_000, 1000) == 1000  # of 10,000 points each
