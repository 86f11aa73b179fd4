"""Voting against a plain nearest-neighbour loop, ties; terms; the stage's names."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sparksift.llm import quality


def vote_by_force(model, vectors, k, sharpness):
    out = []
    for v in vectors:
        sims = [round(float(np.float32(s)), quality.DECIMALS) for s in model.vectors @ v]
        near = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[:k]
        w = [max(sims[i], 1e-6) ** sharpness for i in near]
        out.append(sum(x * model.labels[i] for x, i in zip(w, near, strict=True)) / sum(w))
    return out


def test_vote_is_plain_nearest_neighbours():
    rng = np.random.default_rng(4)
    for trial in range(40):
        n, d = int(rng.integers(3, 60)), 4
        x = rng.integers(-1, 2, (n, d)).astype(np.float32)  # many ties
        x[~x.any(1)] = 1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        model = quality.Model(None, None, x, rng.integers(0, 2, n).astype(np.float64))
        q = np.vstack([x[:5], np.zeros((1, d), np.float32)])
        for k in (1, 5, n, n + 3):
            assert np.allclose(quality.vote(model, q, k, 8.0), vote_by_force(model, q, k, 8.0), atol=1e-5), (trial, k)


def test_distances():
    t = quality.Tokens(*quality.raw(pa.array(["a b a a c b", "a", "b x x"])))
    new = quality.DISTANCES - 1
    assert quality._distances(t).tolist() == [new, new, 1, 0, new, 2, new, new, new, 0]


def test_terms_weigh_alike():
    f = quality.features(*quality.raw(pa.array(["some words here some", "", "zz zz zz zz zz zz"])))
    w = quality.weighted(f, np.ones(quality.FEATURES, np.float32))
    for lo, hi in zip(quality.GROUPS, quality.GROUPS[1:], strict=False):
        assert np.allclose(np.linalg.norm(w[:, lo:hi], axis=1), [1, 0, 1])


def test_clashing_names(spark, tmp_path):
    rows = [(i, f"good words number {i} in a text that goes on", "a", 0.1, "b", "c", "d") for i in range(30)] + [(100 + i, "@@ ## @@ ##" * (i + 1), "a", 0.1, "b", "c", "d") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, score double, before string, secrets string, gone string")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        assert {tuple(r)[2:] for r in at.collect()} == {("a", 0.1, "b", "c", "d")}, name
    assert at.where(F.col("doc_id") >= 100).count() == 0 and at.count() >= 1
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
