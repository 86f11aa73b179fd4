"""Sessions, tables and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def local(app: str = "sparksift", cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once, for workers that do not have it on their path."""
    sc = spark.sparkContext
    if not getattr(sc, "_sparksift_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="sparksift-"), "sparksift.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, str(Path("sparksift") / p.relative_to(ROOT)))
        sc.addPyFile(path)
        sc._sparksift_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate frames: the session's spark.checkpoint.dir; where it is unset, one of its own if all runs on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_sparksift_folder", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = sc._sparksift_folder = tempfile.mkdtemp(prefix="sparksift-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the session's shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/frame-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
