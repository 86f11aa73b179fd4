"""Ranked retrieval: BM25, cosine, rank fusion, relevance, top k.

Query terms meet the corpus before any aggregation, so a query's shuffle carries matching terms only. Ranks over
a whole corpus are taken over rows with a score; those without share the places after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparksift.functions import text as T
from sparksift.session import checkpointed

K1, B, RRF_K = 1.2, 0.75, 60


def index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dl, t): each document's distinct tokens and their number, written once for any number of queries."""
    return checkpointed(docs.select(F.col(doc_id), T.token_set(F.col(text)).alias("t")).select(doc_id, F.size("t").alias("dl"), "t"))


def bm25(docs: DataFrame, query: list[str], *, doc_id: str = "doc_id", text: str = "text", indexed: bool = False) -> DataFrame:
    """(doc_id, kw_score) for every document: 0 without a match. Terms count once in a document, and its length is its distinct tokens.

    The average length needs all documents' token counts, so texts are tokenised in a single pass that keeps only
    (id, length, matching terms), written once; frequencies and scores come from that. ``indexed``: ``docs`` is an
    ``index``, whose lengths and tokens are read as they are.
    """
    terms = list(dict.fromkeys(query))
    all_ = docs if indexed else docs.select(F.col(doc_id), T.token_set(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    slim = all_.select(doc_id, "dl", F.array_intersect("t", F.array(*(F.lit(q) for q in terms)).cast("array<string>")).alias("hits"))
    slim = checkpointed(slim)
    sums = slim.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("dl")).alias("avgdl"), *(F.count_if(F.array_contains("hits", q)).alias(f"df{i}") for i, q in enumerate(terms)))
    parts = [
        F.when(F.array_contains("hits", q), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1) * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(F.lit(0.0))
        for i, q in enumerate(terms)
    ]
    total = parts[0] if parts else F.lit(0.0)
    for p in parts[1:]:
        total = total + p
    return slim.crossJoin(F.broadcast(sums)).select(doc_id, total.alias("kw_score"))  # one row of sums


def document_frequency(docs: DataFrame, *, text: str = "text", terms: list[str] | None = None, indexed: bool = False) -> DataFrame:
    """(term, df, n, idf); of all terms, or of some; of documents, or of their ``index``."""
    t = F.col("t") if indexed else T.token_set(F.col(text))
    if terms is not None:
        t = F.array_intersect(t, F.array(*(F.lit(q) for q in terms)).cast("array<string>"))
    df = docs.select(F.explode(t).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * F.coalesce(y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, zero: float | None = float("-inf")) -> Column:
    """Cosine similarity; ``zero`` where a norm is 0 (ranking: minus infinity; code search: 0)."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(zero).cast("double"))


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def max_chunk_similarity(chunks: DataFrame, parent: str, index: str, score: str) -> DataFrame:
    """Per parent: its best chunk's score, and that chunk (the first of equal ones)."""
    best = F.max_by(F.struct(F.col(score), F.col(index)), F.struct(F.col(score), -F.col(index))).alias("b")
    return chunks.groupBy(parent).agg(best).select(parent, F.col(f"b.{score}").alias("sem_score"), F.col(f"b.{index}").alias("best_chunk"))


def ranked(df: DataFrame, score: str, rank: str, *order: str | Column) -> DataFrame:
    """Places 1..n by score, ties by ``order``. A global sort by range numbers its partitions, so no task holds all rows.

    Rows are sorted by range and kept, each partition is counted and the running sum of counts is added to places within.
    """
    ordered = checkpointed(df.orderBy(F.desc(score), *order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    out = ordered.join(F.broadcast(before.select("__part", "__first", "__before")), "__part")
    return out.withColumn(rank, (F.col("__at") - F.col("__first") + F.coalesce("__before", F.lit(0)) + 1).cast("long")).drop("__part", "__at", "__first", "__before")


def ranks(df: DataFrame, score: str, rank: str, *order: str | Column) -> DataFrame:
    """Places 1..n by score, ties by ``order``, of a candidate set (it comes to one task)."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), *order)).cast("long"))


def rrf(*places: str | Column) -> Column:
    """Reciprocal rank fusion; a place that is null adds nothing."""
    total = F.lit(0.0)
    for p in places:
        total = total + F.coalesce(F.lit(1.0) / (RRF_K + (F.col(p) if isinstance(p, str) else p)), F.lit(0.0))
    return total


def relevant(kw: str = "kw_score", sem: str = "sem_score", embedded: bool = True, least: float = 0.05) -> Column:
    """A keyword match, or enough similarity where embeddings worked."""
    hit = F.col(kw) > 0
    return hit | (F.col(sem) >= least) if embedded else hit


def hybrid(scored: DataFrame, *, doc_id: str = "doc_id", k: int = 20, embedded: bool = True) -> DataFrame:
    """Of candidates with kw_score and sem_score: ranks, fused score, the relevant ones, top k by (rrf, id)."""
    out = ranks(scored, "kw_score", "kw_rank", doc_id)
    if embedded:
        out = ranks(out, "sem_score", "sem_rank", doc_id).withColumn("rrf", rrf("sem_rank", "kw_rank"))
    else:
        out = out.withColumn("rrf", rrf("kw_rank"))
    return out.where(relevant(embedded=embedded)).orderBy(F.desc("rrf"), doc_id).limit(k)
