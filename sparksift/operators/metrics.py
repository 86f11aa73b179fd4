"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(judged: DataFrame, k: int) -> DataFrame:
    """One row over (place, relevant): recall, precision, reciprocal rank and NDCG at ``k``."""
    top = F.col("place") <= k
    hit = top & F.col("relevant")
    gain = F.sum(F.when(hit, 1 / F.log2(F.col("place") + 1)).otherwise(0.0))
    sums = judged.agg(F.count_if(hit).alias("h"), F.count_if("relevant").alias("r"), F.min(F.when(hit, F.col("place"))).alias("f"), gain.alias("g"))
    ideal = F.aggregate(F.expr(f"slice(sequence(1, {k}), 1, cast(least({k}, r) as int))"), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    part = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0)))
    return sums.select(
        F.lit(k).cast("long").alias("k"), F.round(part(F.col("h"), F.col("r")), 9).alias("recall"), F.round(F.col("h") / k, 9).alias("precision"),
        F.round(F.coalesce(1 / F.col("f"), F.lit(0.0)), 9).alias("mrr"), F.round(F.col("g") / F.nullif(ideal, F.lit(0.0)), 9).alias("ndcg"),
    )
