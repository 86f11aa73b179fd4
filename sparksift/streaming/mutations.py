"""The mutation log as a stream: the highest confidence of each edge, kept as state."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksift.session import shared_dir
from sparksift.sources.logs import MUTATION

HORIZON = "30 days"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of JSON lines; malformed lines are passed over."""
    raw = spark.readStream.schema(MUTATION).option("mode", "DROPMALFORMED").json(path)
    return raw.select("type", F.col("data.from").alias("src"), F.col("data.to").alias("dst"), F.coalesce("data.confidence", F.lit(1.0)).alias("confidence"), F.timestamp_millis("timestamp").alias("ts"))


def strongest(events: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): the highest so far."""
    return events.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def first_seen(events: DataFrame) -> DataFrame:
    """Events without repetitions within the horizon; state older than that is let go."""
    return events.withWatermark("ts", HORIZON).dropDuplicatesWithinWatermark(["src", "dst", "type"])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """A stream run until it has read all there is, into a table in memory."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def strongest_once(spark: SparkSession, events: DataFrame) -> DataFrame:
    """A batch of events put through the stream: written to the shared folder, read as a stream to its end, and the state's last table."""
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    events.write.parquet(f"{base}/in")
    stream = strongest(spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in"))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("src", "dst", "type", "confidence")
