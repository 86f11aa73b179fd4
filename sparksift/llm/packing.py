"""Packing into optimal length buckets.

The lengths' global histogram (exact up to ``fine``, then in steps of 1/``steps`` of a power of two, so a few
thousand bins hold any corpus) goes to the driver. Dynamic programming over it chooses at most ``buckets`` upper
bounds whose padding, the sum of bound less length, is least. A bucket's batches hold as many documents as
``budget`` tokens allow at its bound (one, where the bound is above the budget).

A bucket is numbered in shares of about ``share`` documents, dealt by a hash of the id, so no bucket lands in
one task; at most one batch of each share is not full. Null and empty texts have length 0 and are packed like
others. Rows with the same id take a place each, in order of their text's hash. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_count(text: str = "text"):
    """Words of a text, as a column."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def binned(length, fine: int = 1024, steps: int = 64):
    """The least bin at or above a length, as a column."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))) / steps
    return F.when(length <= fine, length).otherwise((F.ceil(length / width) * width).cast("long"))


def bounds(hist: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of the buckets of least padding for (length, count) pairs; the last is the longest length."""
    hist = sorted(hist)
    if not hist:
        return []
    size = np.array([x for x, _ in hist], np.float64)
    count = np.concatenate([[0], np.cumsum([c for _, c in hist], dtype=np.float64)])
    mass = np.concatenate([[0], np.cumsum([x * c for x, c in hist], dtype=np.float64)])
    n, k = len(hist), min(buckets, len(hist))
    cost = np.full((k + 1, n + 1), np.inf)
    cost[0, 0] = 0
    cut = np.zeros((k + 1, n + 1), np.int64)
    for b in range(1, k + 1):
        for j in range(1, n + 1):
            pad = cost[b - 1, :j] + size[j - 1] * (count[j] - count[:j]) - (mass[j] - mass[:j])
            cut[b, j] = np.argmin(pad)
            cost[b, j] = pad[cut[b, j]]
    out, j = [], n
    for b in range(int(np.argmin(cost[:, n])), 0, -1):
        out.append(int(size[j - 1]))
        j = cut[b, j]
    return out[::-1]


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length=None, buckets: int = 12, budget: int = 16384, share: int = 20000) -> DataFrame:
    """``doc_id``, n_tokens, bucket, bucket_len (its bound), batch_id, slot (from 0, in the batch), n_padding. ``length``: a column of lengths, words if None."""
    inner = docs.select(F.col(doc_id).alias("id"), (word_count(text) if length is None else length).alias("n"), F.xxhash64(text).alias("tie")).withColumn("bin", binned(F.col("n")))
    hist = [(r["bin"], r["count"]) for r in inner.groupBy("bin").count().collect()]
    edges = bounds(hist, buckets)
    if not edges:
        edges = [0]
    bucket, counts = F.lit(len(edges) - 1), [0] * len(edges)
    for i in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col("bin") <= edges[i], F.lit(i)).otherwise(bucket)
    for size, c in hist:
        counts[next(i for i, e in enumerate(edges) if size <= e)] += c
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)
    dealt = inner.withColumn("bucket", bucket).withColumn("bucket_len", pick(edges)).withColumn("per", pick([max(1, budget // max(1, e)) for e in edges]))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "tie"), pick([max(1, math.ceil(c / share)) for c in counts])))
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("id", "tie")) - 1
    out = dealt.withColumn("place", place)
    batch = F.col("bucket").cast("long") * (1 << 56) + F.col("part") * (1 << 28) + F.floor(F.col("place") / F.col("per"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_tokens"), F.col("bucket").cast("int").alias("bucket"), "bucket_len", batch.cast("long").alias("batch_id"), (F.col("place") % F.col("per")).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n")).alias("n_padding"))
