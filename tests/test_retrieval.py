"""Scores, ranks, fusion, reranking and retrieval quality."""

import math

import pytest
from pyspark.sql import functions as F

from sparksift.functions.text import query_tokens
from sparksift.operators import metrics, rerank, retrieval
from sparksift.plans import engine


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def scores(spark, query, *texts):
    return {r.doc_id: r.kw_score for r in retrieval.bm25(docs(spark, *texts), query_tokens(query)).collect()}


def test_bm25(spark):
    got = scores(spark, "alpha", "alpha beta", "gamma", "")
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert got[0] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.0))) and got[1] == got[2] == 0
    assert scores(spark, "nothing", "alpha")[0] == 0
    assert scores(spark, "alpha alpha", "alpha beta", "x") == scores(spark, "alpha", "alpha beta", "x")
    assert scores(spark, "", "alpha")[0] == 0
    assert docs(spark).transform(lambda d: retrieval.bm25(d, ["x"])).count() == 0


def test_cosine(spark):
    pair = lambda a, b, **k: spark.range(1).select(retrieval.cosine(retrieval.vector(a), retrieval.vector(b), **k).alias("c")).first().c
    assert pair([1, 2], [1, 2]) == pytest.approx(1) and pair([1, 0], [0, 1]) == 0
    assert pair([0, 0], [1, 1]) == float("-inf") and pair([0, 0], [1, 1], zero=0.0) == 0


def test_ranks(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.9, 0.5, 0.7, 0.5, float("-inf")])], "i int, s double")
    want = [(0, 1), (1, 3), (2, 2), (3, 4), (4, 5)]
    assert sorted((r.i, r.r) for r in retrieval.ranks(df, "s", "r", "i").collect()) == want
    assert sorted((r.i, r.r) for r in retrieval.ranked(df.repartition(3), "s", "r", "i").collect()) == want
    f = spark.createDataFrame([(1, 2), (2, 1), (1, None)], "a int, b int").select(retrieval.rrf("a", "b").alias("x")).collect()
    assert f[0].x == f[1].x == pytest.approx(1 / 61 + 1 / 62) and f[2].x == pytest.approx(1 / 61)


def test_max_chunk(spark):
    c = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("a", 2, 0.7), ("b", 0, -1.0)], "p string, i int, s double")
    assert {(r.p, r.sem_score, r.best_chunk) for r in retrieval.max_chunk_similarity(c, "p", "i", "s").collect()} == {("a", 0.7, 1), ("b", -1.0, 0)}


def test_rerank(spark):
    none = F.lit(None).cast("double")
    c = spark.createDataFrame([(0, 0.5, 10), (1, 0.5, 0), (2, 0.5, 10)], "rank int, rrf double, d int")
    c = c.withColumn("structural", rerank.structural(F.col("d"), none, none, none, none)).withColumn("path_score", F.lit(0.0))
    assert [r.new_rank for r in rerank.rerank(c).orderBy("rank").collect()] == [1, 0, 2]
    tail = rerank.rerank(c, candidates_cap=1).orderBy("rank").collect()
    assert [r.new_rank for r in tail] == [0, 1, 2] and not any(r.changed for r in tail)
    answer = spark.createDataFrame([(1, 0, 0.95), (0, 1, 0.8)], "rank int, new_rank int, external_score double")
    assert [r.new_rank for r in rerank.external(c, answer).orderBy("rank").collect()] == [1, 0, 2]
    assert [r.new_rank for r in rerank.external(c, None).orderBy("rank").collect()] == [0, 1, 2]


def test_structural_ignores_what_is_missing(spark):
    rows = spark.createDataFrame([(0, None, 0.0, None, None), (None, None, None, None, None), (5, 5, 0.05, 1.0, None)], "a int, b int, c double, d double, e double")
    got = [r.s for r in rows.select(rerank.structural(*(F.col(x) for x in "abcde")).alias("s")).collect()]
    assert got == pytest.approx([1.0, 0.0, (0.5 + 0 + 0.5 + 1) / 4])


def test_metrics(spark):
    j = spark.createDataFrame([(1, False), (2, True), (3, False), (4, True)], "place int, relevant boolean")
    m = metrics.metrics(j, 3).first()
    assert (m.recall, m.precision, m.mrr) == (0.5, round(1 / 3, 9), 0.5)
    assert m.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-8)


SCENARIOS = [
    ("handleUserLogin", {"auth.ts": "export function handleUserLogin(u) { return u }", "db.ts": "export const connect = 1", "ui.ts": "render page", "x.ts": "const a = 2"}, {"auth.ts"}),
    ("database connection", {"db.ts": "class DatabaseConnection { open() {} }", "pool.ts": "database pool connection", "ui.ts": "button color", "log.ts": "print"}, {"db.ts", "pool.ts"}),
    ("UserService", {"user_service.ts": "class UserService {}", "order.ts": "class Order {}", "mail.ts": "send mail"}, {"user_service.ts"}),
]


def test_retrieval_quality(spark):
    recalls, ranks = [], []
    for query, files, relevant in SCENARIOS:
        df = spark.createDataFrame([(p, b, "typescript") for p, b in files.items()], "path string, body string, lang string")
        for embed in (None, engine.hashed_embedder()):
            hits, status = engine.search_files(df, query, embed=embed, k=5)
            got = [r.path for r in hits.orderBy(F.desc("rrf"), "path").collect()]
            assert status == ("ok" if embed else "disabled")
            recalls.append(len(relevant & set(got)) / len(relevant))
            ranks.append(next((1 / (i + 1) for i, p in enumerate(got) if p in relevant), 0))
    assert min(recalls) >= 0.5 and min(ranks) > 0 and sum(ranks) / len(ranks) > 0.6


def test_embedding_failure_falls_back(spark):
    df = spark.createDataFrame([("a.ts", "alpha", "typescript"), ("b.ts", "beta", "typescript")], "path string, body string, lang string")

    def bad(texts):
        return [[1.0, 0.0]] if texts == ["alpha"] and len(texts) == 1 and not hasattr(bad, "asked") and not setattr(bad, "asked", 1) else []

    hits, status = engine.search_files(df, "alpha", embed=bad)
    assert status == "failed_fallback_bm25" and [r.path for r in hits.collect()] == ["a.ts"]
