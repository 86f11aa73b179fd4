"""Event logs: graph mutations, commits, knowledge graphs, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksift.operators.graph import first_each

MUTATION = "type string, data struct<`from`:string,`to`:string,context:string,confidence:double,source:string>, timestamp bigint"
KG = "nodes array<struct<id:string,label:string,source_file:string,community:int>>, links array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,weight:double>>"


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """(type, src, dst, confidence, ts) of a folder of JSON lines; malformed lines are passed over; a symbol after a colon is dropped."""
    raw = spark.read.schema(MUTATION).option("mode", "DROPMALFORMED").json(path)
    file = lambda c: F.regexp_replace(c, r":[^/:]*$", "")
    return raw.select("type", file("data.from").alias("src"), file("data.to").alias("dst"), F.coalesce("data.confidence", F.lit(1.0)).alias("confidence"), F.timestamp_millis("timestamp").alias("ts"))


def append(events: DataFrame, path: str) -> None:
    """Events added to a folder of JSON lines."""
    events.write.mode("append").json(path)


def fresh(events: DataFrame, now: str, days: int = 30, ts: str = "ts") -> DataFrame:
    """Events of the last days before ``now``, which is given so that results can be had again."""
    return events.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def strongest(events: DataFrame, *tie: str) -> DataFrame:
    """The most confident event of each (src, dst, type); of equal ones the newest."""
    return first_each(events, ["src", "dst", "type"], F.desc("confidence"), F.desc("ts"), *tie)


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(id, type) at the other ends of a node's edges."""
    mine = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return mine.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id"), "type").distinct()


def recent(commits: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(path) of what changed in the last days before ``now``."""
    at = F.lit(now).cast("timestamp")
    return commits.where((F.col("ts") >= at - F.expr(f"interval {days} days")) & (F.col("ts") <= at)).select("path").distinct()


def with_recency(candidates: DataFrame, changed: DataFrame) -> DataFrame:
    """Candidates (path) with ``temporal``: 1 where it changed recently, else 0."""
    return candidates.join(changed.select("path", F.lit(1.0).alias("temporal")), "path", "left").withColumn("temporal", F.coalesce("temporal", F.lit(0.0)))


def knowledge_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a node-link JSON file."""
    doc = spark.read.schema(KG).option("multiLine", True).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("links"))


def missing(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts whose vectors for a model are not in a cache (key, model, vector); the key is the text's own hash."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    return keyed.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti").dropDuplicates(["key"])


def stale(files: DataFrame, tagged: DataFrame) -> DataFrame:
    """Files that are new or changed since their tags were kept: (path, mtime) not among those of the tag table."""
    return files.join(tagged.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")
