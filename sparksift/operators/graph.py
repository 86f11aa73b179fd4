"""File graphs: definitions and references, PageRank, imports, typed neighbours, co-changes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparksift.session import checkpointed

SELF_LOOP, FOCUS = 0.1, 50
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Rounds of PageRank after which the ranks are written.
WRITTEN = 5
#: Pairs of referrer and definer from which a name goes through blocks of so many files each; pairs expanded at once there.
HOT, BLOCK, EXPANDED = 4096, 1024, 1 << 22


def _among(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def identifier_weight(name: Column, definers: Column, mentioned: Column | None = None) -> Column:
    """Times 10 if mentioned, 10 for a long compound name, a tenth for a leading underscore, a tenth for more than five definers."""
    compound = (name.contains("_") | name.contains("-") | (name.rlike("[a-z]") & name.rlike("[A-Z]"))) & (F.length(name) >= 8)
    one = lambda test, by: F.when(test, F.lit(by)).otherwise(F.lit(1.0))
    return one(F.coalesce(mentioned, F.lit(False)) if mentioned is not None else F.lit(False), 10.0) * one(compound & ~name.startswith("_"), 10.0) * one(name.startswith("_"), 0.1) * one(definers > 5, 0.1)


@dataclass(frozen=True)
class References:
    """A file graph in factors: every src of a name has an edge of the name's weight to every other dst of it.

    ``refs`` (name, src, weight), ``defs`` (name, dst) and ``loops`` (id, weight) grow with the tags, the edges with pairs of files.
    """

    refs: DataFrame
    defs: DataFrame
    loops: DataFrame


def reference_factors(defs: DataFrame, refs: DataFrame, *, mentioned: list[str] | None = None, focus: list[str] | None = None, self_loops: bool = True) -> References:
    """The graph of ``reference_edges`` without its pairs, over tags (name, file)."""
    d = checkpointed(defs.select("name", F.col("file").alias("dst")).distinct())
    definers = d.groupBy("name").agg(F.count("*").alias("definers"))
    counts = refs.groupBy("name", F.col("file").alias("src")).agg(F.count("*").alias("n"))
    mul = identifier_weight(F.col("name"), F.col("definers"), _among("name", mentioned or []))
    raw = mul * F.when(_among("src", focus or []), F.lit(float(FOCUS))).otherwise(F.lit(1.0)) * F.sqrt("n")
    r = checkpointed(counts.join(definers, "name").select("name", "src", F.greatest(F.lit(1.0), F.floor(raw + 0.5).cast("double")).alias("weight")))
    alone = d.join(r.select("name").distinct(), "name", "left_anti") if self_loops else d.limit(0)
    return References(r, d, alone.groupBy(F.col("dst").alias("id")).agg((F.count("*") * SELF_LOOP).alias("weight")))


def reference_edges(defs: DataFrame, refs: DataFrame, *, mentioned: list[str] | None = None, focus: list[str] | None = None, self_loops: bool = True) -> DataFrame:
    """(src, dst, weight) from files that refer to files that define, over tags (name, file).

    A pair's weight is the sum over names of max(1, round(identifier weight * 50 if src is in focus * sqrt(references))).
    Names that are defined and never referred to give their files a loop of 0.1. Names of few pairs are joined; those of
    more than ``HOT`` are multiplied by blocks of files, so no pair is a row before it is summed.
    """
    f = reference_factors(defs, refs, mentioned=mentioned, focus=focus, self_loops=self_loops)
    sides = f.refs.groupBy("name").agg(F.count("*").alias("referrers")).join(f.defs.groupBy("name").agg(F.count("*").alias("definers")), "name")
    names = checkpointed(sides.select("name", (F.col("referrers") * F.col("definers") > HOT).alias("hot"), F.monotonically_increasing_id().alias("number")))
    hot, cold = names.agg(F.coalesce(F.sum(F.col("hot").cast("long")), F.lit(0)), F.coalesce(F.sum((~F.col("hot")).cast("long")), F.lit(0))).first()
    found = []
    if cold or not hot:
        found.append(f.refs.join(names.where("not hot"), "name", "left_semi").join(f.defs, "name").where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    if hot:
        found.append(_crossed(*(x.join(names.where("hot"), "name") for x in (f.refs, f.defs))))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1]).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return pairs.unionByName(f.loops.select(F.col("id").alias("src"), F.col("id").alias("dst"), "weight"))


def _crossed(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(src, dst, weight) of refs (number, src, weight) and defs (number, dst): a product of matrices by blocks of files."""
    left = checkpointed(refs.where("src is not null").groupBy("src").agg(F.collect_list("number").alias("numbers"), F.collect_list("weight").alias("weights")))
    right = checkpointed(defs.where("dst is not null").groupBy("dst").agg(F.collect_list("number").alias("numbers")))
    n = max(1, -(-max(left.count(), right.count()) // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(n * n, 2000)  # a number of its own: adaptive planning sees small rows and would put all blocks into few tasks
    left = left.withColumn("i", block("src")).withColumn("j", each).repartition(tasks, "i", "j")
    right = right.withColumn("j", block("dst")).withColumn("i", each).repartition(tasks, "i", "j")
    kind = {c: x.schema[c].dataType.simpleString() for x, c in ((left, "src"), (right, "dst"))}
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_product, f"src {kind['src']}, dst {kind['dst']}, weight double")


def _product(left: pa.Table, right: pa.Table) -> pa.Table:
    """The edges between two blocks of files: dense products for names of many pairs here, pairs for the others."""
    src, dst = left.column("src").combine_chunks(), right.column("dst").combine_chunks()
    total = np.zeros((len(src), len(dst)))
    (r_at, r_name, r_first, r_n), (d_at, d_name, d_first, d_n), names, weight = _by_name(left, right)
    dense = r_n * d_n * 16 > total.size
    for k in range(0, len(some := names[dense]), 256):
        part = some[k : k + 256]
        a, b = np.zeros((len(src), len(part))), np.zeros((len(dst), len(part)))
        x, y = np.flatnonzero(np.isin(r_name, part)), np.flatnonzero(np.isin(d_name, part))
        a[r_at[x], np.searchsorted(part, r_name[x])] = weight[x]
        b[d_at[y], np.searchsorted(part, d_name[y])] = 1
        total += a @ b.T
    rest = np.flatnonzero(~dense)
    step = np.cumsum(r_n[rest] * d_n[rest]) // EXPANDED
    for g in np.split(rest, np.flatnonzero(np.diff(step)) + 1) if len(rest) else []:
        pairs = r_n[g] * d_n[g]
        of = np.repeat(g, pairs)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        x, y = r_first[of] + k // d_n[of], d_first[of] + k % d_n[of]
        np.add.at(total.reshape(-1), r_at[x] * len(dst) + d_at[y], weight[x])
    own = pc.index_in(dst, value_set=src)  # a file has no edge to itself
    both = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
    total[own.take(pa.array(both)).to_numpy(zero_copy_only=False).astype(np.int64), both] = 0
    s, t = np.nonzero(total)
    return pa.table({"src": src.take(pa.array(s)), "dst": dst.take(pa.array(t)), "weight": total[s, t]})


def _by_name(left: pa.Table, right: pa.Table) -> tuple:
    """Entries (file, name, first, number for each common name) of both sides by name; the common names; the left's weights."""
    sides = []
    for t in (left, right):
        lists = t.column("numbers").combine_chunks()
        at, name = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(name, kind="stable")
        sides.append((at[order], name[order], order))
    names = np.intersect1d(sides[0][1], sides[1][1])
    edges = [(np.searchsorted(name, names), np.searchsorted(name, names, "right")) for _, name, _ in sides]
    r, d = ((at, name, a, b - a) for (at, name, _), (a, b) in zip(sides, edges, strict=True))
    weights = left.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return r, d, names, weights[sides[0][2]]


def personalization(files: DataFrame, *, focus: list[str] | None = None, mentioned_files: list[str] | None = None, mentioned: list[str] | None = None, refs: DataFrame | None = None, defs: DataFrame | None = None) -> DataFrame:
    """(file, weight) with p = 100 / files: p each for a focus file, a mentioned file, a path component that is mentioned; a tenth for every reference from a focus file to a name the file defines."""
    p = 100.0 / max(1, files.count())
    parts = F.split(F.regexp_replace("file", r"\.[^./]*$", ""), "/")
    words = F.array(*(F.lit(m) for m in mentioned or [])).cast("array<string>")
    on = lambda test: F.when(test, F.lit(p)).otherwise(F.lit(0.0))
    out = files.select("file", (on(_among("file", focus or [])) + on(_among("file", mentioned_files or [])) + on(F.arrays_overlap(parts, words))).alias("weight"))
    if focus and refs is not None and defs is not None:
        used = refs.where(_among("file", focus)).groupBy("name").agg(F.count("*").alias("n"))
        linked = defs.select("name", "file").distinct().where(~_among("file", focus)).join(F.broadcast(used) if len(focus) <= 100 else used, "name")
        out = out.unionByName(linked.groupBy("file").agg((F.sum("n") * (0.1 * p)).alias("weight")).join(files.select("file"), "file", "left_semi"))
    return out.groupBy("file").agg(F.sum("weight").alias("weight"))


def unreferenced(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, file) of definitions whose name nothing refers to."""
    return defs.select("name", "file").distinct().join(refs.select("name").distinct(), "name", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame | References, personal: DataFrame | None = None, *, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """(id, rank) over nodes (id), edges (src, dst, weight) or their factors, and personalization (id, weight).

    Ranks start even; what nodes without edges hold goes out by personalization. Edges to unknown nodes count
    for nothing. Two sums of each round are its only global values: what moved, and what nodes without edges hold. A round's
    ranks are computed once and kept for the next (a small row for each node), so joins know their size, and written
    every ``WRITTEN`` rounds, which cuts the lineage. Without a tolerance all rounds are run.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out_weight, own, flow = (_tag_flow if isinstance(edges, References) else _edge_flow)(ids, edges)
    if personal is None:
        base = ids.withColumn("p", F.lit(1.0 / n))
    else:
        mass = personal.join(ids, "id", "left_semi").where("weight > 0")
        total = mass.agg(F.sum("weight")).first()[0]
        base = ids.join(mass.groupBy("id").agg(F.sum("weight").alias("w")), "id", "left").select("id", (F.coalesce("w", F.lit(0.0)) / total if total else F.lit(1.0 / n)).alias("p"))
    base = base.join(out_weight.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True)))
    base = checkpointed(base.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0.0))) if own is not None else base.withColumn("own", F.lit(0.0)))
    rank, kept = base.withColumn("rank", F.lit(1.0 / n)), []
    held = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
    lost = rank.agg(held).first()[0]
    for at in range(1, rounds + 1):
        came = F.greatest(F.lit(0.0), F.coalesce("came", F.lit(0.0)) + F.col("own") * F.col("rank"))  # what comes back and is taken off may leave a rounding error
        new = rank.join(flow(rank), "id", "left").select("id", "p", "dangling", "own", F.col("rank").alias("old"), ((1 - damping) * F.col("p") + damping * (came + lost * F.col("p"))).alias("rank"))
        written = at % WRITTEN == 0
        new = checkpointed(new) if written else new.persist()
        moved, lost = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), held).first()
        rank = new.drop("old")
        if written:
            _forget(kept)
        else:
            kept.append(new)
        if tolerance is not None and moved < tolerance:
            break
    out = checkpointed(rank.select("id", "rank"))
    _forget(kept)
    return out


def _edge_flow(ids: DataFrame, edges: DataFrame):
    """(src, total) of the edges between known nodes, (id, own) that a node gives itself beside the flow, and what comes to (id) in a round from ranks (id, rank)."""
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").where("weight > 0")
    known = known.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out_weight = known.groupBy("src").agg(F.sum("weight").alias("total"))
    share = checkpointed(known.join(out_weight, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("w")))
    return out_weight, None, lambda rank: share.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("came"))


def _tag_flow(ids: DataFrame, tags: References):
    """``_edge_flow`` through names: a round sends ranks to the names that files refer to and from there to those that define them, less what would come back to its own file."""
    refs = tags.refs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    defs = checkpointed(tags.defs.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    definers = defs.groupBy("name").agg(F.count("*").alias("definers"))
    also = defs.select("name", F.col("dst").alias("src"), F.lit(1).alias("own"))
    refs = refs.join(definers, "name").join(also, ["name", "src"], "left").withColumn("own", F.coalesce("own", F.lit(0))).where("definers > own")
    loops = tags.loops.join(ids, "id", "left_semi").select(F.lit(None).cast(tags.refs.schema["name"].dataType).alias("name"), F.col("id").alias("src"), "weight", F.lit(1).cast("long").alias("definers"), F.lit(-1).alias("own"))
    refs = checkpointed(refs.select("name", "src", "weight", "definers", "own").unionByName(loops))  # a loop: all of it comes back
    out_weight = checkpointed(refs.groupBy("src").agg(F.sum(F.col("weight") * F.when(F.col("own") < 0, 1).otherwise(F.col("definers") - F.col("own"))).alias("total")))
    share = checkpointed(refs.join(out_weight, "src").select("name", "src", (F.col("weight") / F.col("total")).alias("w"), "own"))
    own = share.where("own <> 0").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * -F.col("own")).alias("own"))
    share = share.where("own >= 0").select("name", "src", "w")

    def flow(rank: DataFrame) -> DataFrame:
        via = share.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy("name").agg(F.sum(F.col("rank") * F.col("w")).alias("via"))
        return defs.join(via, "name").groupBy(F.col("dst").alias("id")).agg(F.sum("via").alias("came"))

    return out_weight, own, flow


def _forget(frames: list[DataFrame]) -> None:
    while frames:
        frames.pop().unpersist()


def tag_ranks(defs: DataFrame, ranks: DataFrame, *, focus: list[str] | None = None, idents: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """Definitions with rank: the file's, times 20 in focus, 10 for a priority name, 5 for a priority file."""
    by = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(1.0))
    weight = by(_among("file", focus or []), 20.0) * by(_among("name", idents or []), 10.0) * by(_among("file", files or []), 5.0)
    return defs.join(ranks, "file").withColumn("rank", F.col("rank") * weight)


def import_ranks(files: DataFrame, imports: DataFrame, *, focus: list[str] | None = None, priority: list[str] | None = None) -> DataFrame:
    """(file, indegree, rank): imports of a file over the largest number, 2 more in focus, 1 more with priority."""
    degree = files.select("file").join(imports.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n")), "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("indegree"))
    most = degree.agg(F.greatest(F.lit(1), F.max("indegree")).alias("most"))
    plus = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    return degree.crossJoin(F.broadcast(most)).select("file", "indegree", (F.col("indegree") / F.col("most") + plus(_among("file", focus or []), 2.0) + plus(_among("file", priority or []), 1.0)).alias("rank"))


def first_each(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def symbol_neighbours(defs: DataFrame, refs: DataFrame, files: list[str]) -> DataFrame:
    """(src, dst, name, confidence 0.9): files that define a name that a given file refers to; the first name for each pair."""
    used = refs.where(_among("file", files)).select(F.col("file").alias("src"), "name").distinct()
    found = used.join(defs.select("name", F.col("file").alias("dst")).distinct(), "name").where("src <> dst")
    return found.groupBy("src", "dst").agg(F.min("name").alias("name")).withColumn("confidence", F.lit(0.9))


def symbol_files(tags: DataFrame, symbol: str) -> DataFrame:
    """(file, edge_type, confidence) of the files with a tag of this name: the first tag decides; definitions 0.9, references 0.8."""
    first = first_each(tags.where(F.col("name") == symbol), ["file"], "line", F.desc(F.col("kind") == "def"))
    is_def = F.col("kind") == "def"
    return first.select("file", F.when(is_def, "defines").otherwise("references").alias("edge_type"), F.when(is_def, 0.9).otherwise(0.8).alias("confidence"))


def import_neighbours(imports: DataFrame, seeds: list[str], cap: int = 20) -> DataFrame:
    """(file): what seeds import and is no seed, capped."""
    return imports.where(_among("src", seeds) & ~_among("dst", seeds)).select(F.col("dst").alias("file")).distinct().orderBy("file").limit(cap)


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (file, caller, callee, line) and the file of the first function of the callee's name, or null."""
    first = functions.groupBy(F.col("name").alias("callee")).agg(F.min_by("file", F.struct("file", "line")).alias("target"))
    return calls.join(first, "callee", "left").withColumn("resolved", F.col("target").isNotNull())


def call_neighbours(calls: DataFrame, functions: DataFrame, files: list[str]) -> DataFrame:
    """(file, edge_type): files of functions that given files call, and files that call theirs."""
    r = resolved_calls(calls, functions).where("resolved and file <> target")
    to = r.where(_among("file", files)).select(F.col("target").alias("file"), F.lit("calls").alias("edge_type"))
    of = r.where(_among("target", files)).select("file", F.lit("called_by").alias("edge_type"))
    return to.unionByName(of).distinct()


def call_lists(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions with the sorted names they call and the callers of theirs."""
    out = calls.groupBy("file", F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    of = calls.groupBy(F.col("callee").alias("name")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    empty = F.array().cast("array<string>")
    return functions.join(out, ["file", "name"], "left").join(of, "name", "left").withColumn("calls", F.coalesce("calls", empty)).withColumn("called_by", F.coalesce("called_by", empty))


def co_changes(commits: DataFrame, target: str, k: int = 5) -> DataFrame:
    """(path, count, correlation): files of the commits that touch a target, by how many of these they share."""
    of = commits.where(F.col("path") == target).select("commit_id").distinct()
    total = of.agg(F.count("*").alias("total"))
    peers = commits.where(F.col("path") != target).join(of, "commit_id", "left_semi").groupBy("path").agg(F.count_distinct("commit_id").alias("count"))
    return peers.crossJoin(F.broadcast(total)).select("path", "count", (F.col("count") / F.col("total")).alias("correlation")).orderBy(F.desc("count"), "path").limit(k)


def dependents(deps: DataFrame, start: list[str], depth: int = 20) -> DataFrame:
    """(file): all that reach the start files over (file, depends_on), cycles or not."""
    spark = deps.sparkSession
    seen = spark.createDataFrame([(s,) for s in start], "file string")
    front = seen
    for i in range(depth):
        front = deps.join(front.withColumnRenamed("file", "depends_on"), "depends_on").select("file").distinct().join(seen, "file", "left_anti")
        front = checkpointed(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where(~F.col("file").isin(start)).distinct()
