"""Symbol lookup, definitions, callers and code search over tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparksift.functions import text as T
from sparksift.functions.declared import IDENTIFIER, line_pattern
from sparksift.session import checkpointed

def search(tags: DataFrame, query: str, *, defs: bool = True, refs: bool = True, k: int = 50) -> DataFrame:
    """Tags whose name contains the query in any case: definitions first, by name, the first k; shown by kind, file, line."""
    kinds = [kind for kind, yes in (("def", defs), ("ref", refs)) if yes]
    hits = tags.where(F.lower("name").contains(query.lower()) & F.col("kind").isin(kinds))
    return hits.orderBy("kind", "name", "file", "line").limit(k).orderBy("kind", "file", "line", "name")


def search_lines(files: DataFrame, query: str, *, path: str = "path", body: str = "body", defs: bool = True, refs: bool = True, k: int = 50) -> DataFrame:
    """(file, line, name, kind) of lines that hold the query: a declaration of such a name, else their first identifier with it."""
    q = query.lower()
    lines = files.select(F.col(path).alias("file"), F.posexplode(F.split(F.col(body), "\n", -1)).alias("line", "text")).where(F.lower("text").contains(q))
    declared = F.regexp_extract("text", line_pattern(), 1)
    name = F.when((declared != "") & F.lower(declared).contains(q), declared)
    used = F.get(F.filter(F.regexp_extract_all("text", F.lit(rf"\b({IDENTIFIER})\b"), 1), lambda n: F.lower(n).contains(q)), F.lit(0))
    hits = lines.select("file", (F.col("line") + 1).alias("line"), name.alias("d"), used.alias("u")).where("d is not null or u is not null")
    hits = hits.select("file", "line", F.coalesce("d", "u").alias("name"), F.when(F.col("d").isNotNull(), "def").otherwise("ref").alias("kind"))
    return hits.where(F.col("kind").isin([kind for kind, yes in (("def", defs), ("ref", refs)) if yes])).orderBy("kind", "file", "line").limit(k)


def exact_or_folded(tags: DataFrame, symbol: str) -> DataFrame:
    """Tags of exactly this name; without any, those of the first name that equals it in any case."""
    exact = tags.where(F.col("name") == symbol)
    if not exact.isEmpty():
        return exact
    folded = tags.where(F.lower("name") == symbol.lower())
    first = folded.orderBy("file", "line", "name").select("name").limit(1)
    return folded.join(F.broadcast(first), "name", "left_semi")


def proximity(file: Column, context: str | None, imported: Column | None = None) -> Column:
    """How near a definition's file is to the file one looks from: 100 the same, 90 imported by it, 50 the same folder, 30 an ancestor's, 10 else."""
    if context is None:
        return F.lit(0)
    here, there = T.directory(F.lit(context)), T.directory(file)
    above = (there == "") | F.startswith(here, F.concat(there, F.lit("/")))
    return F.when(file == context, 100).when(F.coalesce(imported, F.lit(False)) if imported is not None else F.lit(False), 90).when(there == here, 50).when(above, 30).otherwise(10)


def resolve(tags: DataFrame, symbol: str, context: str | None = None, imports: DataFrame | None = None) -> DataFrame:
    """Definitions of a symbol by proximity to a file, best first: file, line, name, score, best."""
    found = exact_or_folded(tags, symbol).where("kind = 'def'")
    if imports is not None and context is not None:
        direct = imports.where(F.col("src") == context).select(F.col("dst").alias("file"), F.lit(True).alias("imported")).distinct()
        found = found.join(direct, "file", "left")
    else:
        found = found.withColumn("imported", F.lit(False))
    scored = found.withColumn("score", proximity(F.col("file"), context, F.col("imported")))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "file", "line"))
    return scored.withColumn("best", place == 1).select("file", "line", "name", "score", "best").orderBy(F.desc("score"), "file", "line")


def callers(calls: DataFrame, target: str) -> DataFrame:
    """(file, caller): distinct functions that call a name."""
    return calls.where(F.col("callee") == target).select("file", "caller").distinct()


def tag_counts(tags: DataFrame) -> DataFrame:
    """(file, defs, refs)."""
    return tags.groupBy("file").agg(F.count_if(F.col("kind") == "def").alias("defs"), F.count_if(F.col("kind") == "ref").alias("refs"))


def file_symbols(tags: DataFrame, most: int = 8) -> DataFrame:
    """(file, symbols, more): a file's first defined names in line order, and how many more there are."""
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda s: s["name"]))
    return tags.where("kind = 'def'").groupBy("file").agg(names.alias("n")).select("file", F.slice("n", 1, most).alias("symbols"), F.greatest(F.size("n") - most, F.lit(0)).alias("more"))


def useful_definitions(defs: DataFrame, least: int = 8) -> DataFrame:
    """Definitions (file, start_line, body) of some length, one for each file and line."""
    return defs.where(F.length(F.trim("body")) >= least).dropDuplicates(["file", "start_line"])


def scan_cutoff(items: DataFrame, size: str, order: str, most: int = 3_000_000) -> DataFrame:
    """Items in order, until those before have come to ``most`` characters.

    Running sums are taken within ranges of the order and then over the ranges, so no task sees all rows.
    """
    sorted_ = checkpointed(items.orderBy(order).withColumn("__part", F.spark_partition_id()))
    inner = F.sum(size).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    parts = sorted_.groupBy("__part").agg(F.sum(size).alias("__s"))
    before = parts.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    out = sorted_.withColumn("__i", F.coalesce(inner, F.lit(0))).join(F.broadcast(before), "__part")
    return out.withColumn("chars_before", F.col("__i") + F.col("__b")).where(F.col("chars_before") < most).drop("__part", "__i", "__b")


def parse_stats(times: DataFrame) -> DataFrame:
    """Over (file, ms): total, count, mean to two places, slowest and fastest file."""
    return times.agg(F.sum("ms").alias("total"), F.count("*").alias("n"), F.round(F.avg("ms"), 2).alias("mean"), F.max_by("file", F.struct("ms", "file")).alias("slowest"), F.min_by("file", F.struct("ms", "file")).alias("fastest"))
