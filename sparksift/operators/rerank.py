"""Structural reranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (0.6, 0.3, 0.1)  # fused rank, structure, path


def min_max(df: DataFrame, value: str, output: str) -> DataFrame:
    """Values to 0..1 over all rows; 0.5 where they are all equal."""
    span = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), F.lit(0.5)).otherwise((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(span)).withColumn(output, scaled).drop("__lo", "__hi")  # one row


def structural(distance: Column, depth: Column, page_rank: Column, probe: Column, temporal: Column) -> Column:
    """Mean of the signals that are there: distance and depth when not null, the others when above 0; 0 without any."""
    signals = [
        F.greatest(F.lit(0.0), 1 - distance / 10),
        F.greatest(F.lit(0.0), 1 - depth / 5),
        F.when(page_rank > 0, F.least(F.lit(1.0), 10 * page_rank)),
        F.when(probe > 0, probe),
        F.when(temporal > 0, temporal),
    ]
    signals[0] = F.when(distance.isNotNull(), signals[0])
    signals[1] = F.when(depth.isNotNull(), signals[1])
    there = F.array_compact(F.array(*signals))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(there), F.lit(0))).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, *, rank: str = "rank", candidates_cap: int = 20) -> DataFrame:
    """Candidates (rank from 0, rrf, structural, path_score): composite, new_rank, changed; places from the cap on stay."""
    head = candidates.where(F.col(rank) < candidates_cap)
    for c in ("rrf", "structural", "path_score"):
        head = min_max(head, c, f"{c}_n")
    composite = WEIGHTS[0] * F.col("rrf_n") + WEIGHTS[1] * F.col("structural_n") + WEIGHTS[2] * F.col("path_score_n")
    place = F.row_number().over(Window.orderBy(F.desc("composite"), rank)) - 1  # the cap bounds it
    head = head.withColumn("composite", composite).withColumn("new_rank", place.cast("long")).drop("rrf_n", "structural_n", "path_score_n")
    tail = candidates.where(F.col(rank) >= candidates_cap).withColumn("composite", F.lit(None).cast("double")).withColumn("new_rank", F.col(rank).cast("long"))
    return head.unionByName(tail).withColumn("changed", F.col("new_rank") != F.col(rank))


def external(candidates: DataFrame, answer: DataFrame | None, *, rank: str = "rank") -> DataFrame:
    """An external reranker's answer (rank, new_rank, external_score) put on candidates; those it left out, or all without an answer, keep their place."""
    if answer is None:
        return candidates.withColumn("new_rank", F.col(rank).cast("long")).withColumn("external_score", F.lit(None).cast("double"))
    return candidates.join(F.broadcast(answer), rank, "left").withColumn("new_rank", F.coalesce("new_rank", F.col(rank)).cast("long"))
