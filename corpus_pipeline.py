"""From raw documents to packed batches: quality, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last
return the columns they were given. ``run`` writes each stage's rows to the shared folder and reads them for
the next, so a lost executor costs a stage's tasks and no more.

Empty and null texts are scored, grouped (with nothing), kept and packed like others; a table without rows
gives none. Rows without a doc_id are never near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksift.llm import decontaminate, near_dup, packing, quality, secrets
from sparksift.llm.queries import fit_quality
from sparksift.llm.text import free_name, stored
from sparksift.session import ship

THRESHOLD = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores ``THRESHOLD`` or more; all, where none is labelled."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.labels):
        return docs
    score = free_name(docs.columns, "score")
    return quality.score(docs, model, output=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id."""
    gone = near_dup.groups(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.alias("docs").join(gone.alias("out"), F.col("docs.doc_id") == F.col("out.gone"), "left_anti")
    return left.select(*(F.col(f"docs.`{c}`") for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; n_chars follows the text where it changes."""
    before = free_name(docs.columns, "before")
    out = secrets.redacted(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text") != F.col(before), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and place."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near_dup", drop_near_copies), ("decontaminate", drop_benchmark), ("secrets", redact_secrets), ("packing", pack_batches)]

#: Several stages are beyond SQL (voting over singular vectors, seeded passages, dynamic programming); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
