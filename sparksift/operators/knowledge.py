"""Knowledge graphs over nodes (id, label, source_file, community) and links (source, target, relation, confidence_score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparksift.operators.graph import first_each


def both_ways(links: DataFrame) -> DataFrame:
    """(a, b, relation, confidence_score) in both directions."""
    one = lambda a, b: links.select(F.col(a).alias("a"), F.col(b).alias("b"), "relation", "confidence_score")
    return one("source", "target").unionByName(one("target", "source"))


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours."""
    return both_ways(links).where("a <> b").groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("degree"))


def god_nodes(nodes: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """(id, label, degree) of the most connected nodes, without those that stand for a file or a method stub."""
    name = F.element_at(F.split(F.coalesce("source_file", F.lit("")), "/"), -1)
    real = nodes.where((F.col("label") != name) & ~F.col("label").rlike(r"^\..*\(\)$"))
    return real.join(degrees(links), "id").select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(k)


def file_centrality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(source_file, centrality): the highest degree of a file's nodes."""
    return nodes.join(degrees(links), "id", "left").groupBy("source_file").agg(F.coalesce(F.max("degree"), F.lit(0)).alias("centrality"))


def file_community(nodes: DataFrame) -> DataFrame:
    """(source_file, community): a file's most frequent community, the least of equal ones."""
    n = nodes.where("community is not null").groupBy("source_file", "community").count()
    return n.groupBy("source_file").agg(F.max_by("community", F.struct("count", -F.col("community"))).alias("community"))


def community_members(nodes: DataFrame) -> DataFrame:
    """(community, files): distinct files, sorted."""
    return nodes.where("community is not null").groupBy("community").agg(F.array_sort(F.collect_set("source_file")).alias("files"))


def stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, directed links, communities, files."""
    a = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities"), F.count_distinct("source_file").alias("files"))
    return a.crossJoin(links.agg(F.count_distinct("source", "target").alias("links")))  # a row each


def related_files(nodes: DataFrame, links: DataFrame, file: str) -> DataFrame:
    """(path, relation, confidence): files of a file's neighbours; its first node's best link to a file wins."""
    mine = nodes.where(F.col("source_file") == file).select(F.col("id").alias("a"))
    found = both_ways(links).join(F.broadcast(mine), "a").join(nodes.select(F.col("id").alias("b"), F.col("source_file").alias("path")), "b").where(F.col("path") != file)
    best = first_each(found, ["a", "b"], F.desc("confidence_score"), "relation")
    best = first_each(best, ["path"], "a", F.desc("confidence_score"), "b")
    return best.select("path", "relation", F.col("confidence_score").alias("confidence")).orderBy(F.desc("confidence"), "path")


def within(nodes: DataFrame, links: DataFrame, seeds: list, depth: int = 3) -> DataFrame:
    """(id, distance) of nodes at most ``depth`` links from the seeds."""
    edges = both_ways(links).select("a", "b").distinct()
    reached = nodes.where(F.col("id").isin(seeds)).select("id", F.lit(0).alias("distance"))
    front = reached
    for d in range(1, depth + 1):
        step = edges.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        front = step.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        reached = reached.unionByName(front)
    return reached


def query_scores(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score): per term of over two characters 1 in the label, half in the file, 100 for the whole label."""
    score = F.lit(0.0)
    for t in [t.lower() for t in terms if len(t) > 2]:
        label, file = F.lower("label"), F.lower(F.coalesce("source_file", F.lit("")))
        score = score + F.when(label.contains(t), 1.0).otherwise(0.0) + F.when(file.contains(t), 0.5).otherwise(0.0) + F.when(label == t, 100.0).otherwise(0.0)
    return nodes.select("id", score.alias("score")).where("score > 0")


def by_label(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes of exactly this label in any case; without one, those that contain it."""
    tier = F.when(F.lower("label") == label.lower(), 1).when(F.lower("label").contains(label.lower()), 2)
    hits = nodes.withColumn("tier", tier).where("tier is not null")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.crossJoin(F.broadcast(best)).where("tier = best").drop("tier", "best").orderBy("label", "id")


def boosted(scored: DataFrame, centrality: DataFrame, *, file: str = "file", score: str = "score") -> DataFrame:
    """Scores times 1 + min(centrality, 20) / 100."""
    c = centrality.select(F.col("source_file").alias(file), "centrality")
    return scored.join(c, file, "left").withColumn(score, F.col(score) * (1 + F.least(F.coalesce("centrality", F.lit(0)), F.lit(20)) / 100)).drop("centrality")


def mode_rank(nodes: DataFrame) -> DataFrame:
    """Communities of each file by how often they occur."""
    n = nodes.groupBy("source_file", "community").count()
    return n.withColumn("place", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("count"), "community")))
