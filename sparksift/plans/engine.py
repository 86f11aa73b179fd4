"""Requests over a repository's files: hybrid search, symbol search, maps, reading many files.

``files`` is a frame (path, body, lang[, mtime]); what it yields (tags, calls, imports) can be kept as tables and
given back, so a request over a large repository starts from those and not from texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksift.functions import text as T
from sparksift.operators import chunking, expand, extract, graph, packing, rerank, retrieval, symbols
from sparksift.session import checkpointed
from sparksift.sources import files as sources

Embedder = Callable[[list[str]], list[list[float]]]
MOST_TEXT, MOST_BATCH = 2048, 32768  # tokens, by estimate, of a text and of a call


@dataclass
class Repository:
    """A repository's frames."""

    files: DataFrame
    tags: DataFrame
    calls: DataFrame
    imports: DataFrame

    @classmethod
    def of(cls, files: DataFrame, aliases: list[tuple[str, str]] | None = None) -> Repository:
        tags = extract.tags(files)
        return cls(files, tags, extract.calls(files), extract.resolved_imports(extract.imports(files), files, aliases))


def embedded(texts: DataFrame, embed: Embedder, *, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns and vector; texts go to the service in calls of bounded size, from the executors. A wrong number or length of vectors is an error."""
    schema = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in key), "vector array<double>"])

    def call(some: list[str]) -> list[list[float]]:
        got = embed(some)
        if len(got) != len(some):
            raise ValueError(f"Expected {len(some)} vectors, got {len(got)}")
        if len({len(v) for v in got}) > 1:
            raise ValueError("vectors differ in length")
        return got

    def run(parts):
        for part in parts:
            vectors, batch, size = [], [], 0
            for t in part[text]:
                n = min(MOST_TEXT, -(-len(t) // 4))
                if batch and size + n > MOST_BATCH:
                    vectors += call(batch)
                    batch, size = [], 0
                batch.append(t[: 4 * MOST_TEXT])
                size += n
            vectors += call(batch) if batch else []
            yield pd.DataFrame({**{k: part[k] for k in key}, "vector": vectors})

    return texts.select(*key, text).mapInPandas(run, schema)


def search_files(files: DataFrame, query: str, *, embed: Embedder | None = None, k: int = 20, hyde: bool = False, presort: bool = True) -> tuple[DataFrame, str]:
    """Ranked retrieval over files (path, body): (path, kw_score, sem_score, rrf) and the status of embeddings.

    Ties go to files whose path holds query words, then by path. If the service fails, keywords alone decide.
    """
    terms = T.query_tokens(query)
    order = T.path_overlap(F.col("path"), terms) if presort else F.lit(0)
    base = retrieval.bm25(files, terms, doc_id="path", text="body").withColumn("ord", -order)
    status, scored = "disabled", base
    if embed is not None:
        try:
            asked = expand.hypothetical(query)[0] if hyde else query
            vector = embed([asked])
            pieces = chunking.chunks(files, body="body").select("path", "chunk_index", "text")
            vectors = embedded(pieces, embed, key=["path", "chunk_index"]).withColumn("score", retrieval.cosine(F.col("vector"), retrieval.vector(vector[0])))
            best = checkpointed(retrieval.max_chunk_similarity(vectors.select("path", "chunk_index", "score"), "path", "chunk_index", "score"))  # the service is asked here, once
            scored = base.join(best, "path", "left").withColumn("sem_score", F.coalesce("sem_score", F.lit(float("-inf"))))
            status = "ok"
        except (OSError, RuntimeError, ValueError, PythonException):  # the service is outside; a request still gets an answer
            scored, status = base, "failed_fallback_bm25"
    ok = status == "ok"
    out = scored if ok else scored.withColumn("sem_score", F.lit(None).cast("double"))
    out = retrieval.ranked(out, "kw_score", "kw_rank", "ord", "path")
    out = retrieval.ranked(out, "sem_score", "sem_rank", "ord", "path").withColumn("rrf", retrieval.rrf("sem_rank", "kw_rank")) if ok else out.withColumn("rrf", retrieval.rrf("kw_rank"))
    return out.where(retrieval.relevant(embedded=ok)).orderBy(F.desc("rrf"), "ord", "path").limit(k).select("path", "kw_score", "sem_score", "rrf"), status


def expanded(repo: Repository, seeds: list[str], query: str, *, cap: int = 20, probe: bool = True) -> DataFrame:
    """(file, phase) of seeds, probed files, imports, symbols, calls; the first source wins."""
    spark = repo.files.sparkSession
    one = lambda df: df.select("file").distinct().withColumn("ord", F.lit(0))
    defs, refs = repo.tags.where("kind = 'def'"), repo.tags.where("kind = 'ref'")
    phases = [spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "file string, ord int")]
    phases.append(one(expand.probe(repo.tags, query)) if probe else phases[0].limit(0))
    phases.append(one(graph.import_neighbours(repo.imports, seeds)))
    phases.append(one(graph.symbol_neighbours(defs, refs, seeds).select(F.col("dst").alias("file"))))
    phases.append(one(graph.call_neighbours(repo.calls, extract.functions(repo.tags), seeds)))
    return expand.phased(phases, cap)


def intent_read(repo: Repository, query: str, seeds: list[str], *, embed: Embedder | None = None, k: int = 20, max_bytes: int = 51200, max_lines: int = 2000, structural: bool = False) -> dict:
    """Candidates expanded, ranked, perhaps reranked, and packed: the text, the plan and each file's place. At most ``cap`` files come to the driver."""
    found = expanded(repo, seeds, query)
    candidates = repo.files.join(F.broadcast(found.select(F.col("file").alias("path"), "phase")), "path")
    hits, status = search_files(candidates, query, embed=embed, k=k)
    if structural:
        signals = hits.join(found.select(F.col("file").alias("path"), "phase"), "path")
        distance = F.when(F.col("phase") == 1, 0).when(F.col("phase") == 2, 1).when(F.col("phase") > 2, 2)  # seeds have none
        none = F.lit(None).cast("double")
        signals = signals.withColumn("structural", rerank.structural(distance, none, none, F.when(F.col("phase") == 1, F.lit(1.0)), none)).withColumn("path_score", F.lit(0.0))
        signals = retrieval.ranks(signals, "rrf", "rank", "path").withColumn("rank", F.col("rank") - 1)
        hits = rerank.rerank(signals).orderBy("new_rank").select("path", "kw_score", "sem_score", "rrf")
    ranked = [r.path for r in hits.collect()]
    bodies = {r.path: r.body for r in repo.files.where(F.col("path").isin(ranked)).select("path", "body").collect()} if ranked else {}
    sections = [packing.Section(i, p, packing.heredoc([(i + 1, p, bodies[p])])) for i, p in enumerate(ranked)]
    chosen = packing.choose_intent(packing.plans(sections, [s.index for s in sections], max_bytes, max_lines), 0)
    shown = [s.text for s in sections if s.index in chosen.full] + ([chosen.partial.text] if chosen.partial else [])
    return {"text": "\n\n".join(shown), "plan": chosen, "ranked": ranked, "embeddings": status}


def read_many(files: DataFrame, paths: list[str], *, max_bytes: int = 51200, max_lines: int = 2000) -> dict:
    """Asked files in request order, within the budget by the best of three strategies. A path outside the root stops the call."""
    spark = files.sparkSession
    if any(not p.strip() or ".." in p.replace("\\", "/").split("/") for p in paths):
        raise ValueError("unsafe path")
    asked = spark.createDataFrame(list(enumerate(paths)), "index int, path string")
    rows = sorted(sources.read_many(asked, files).collect(), key=lambda r: r["index"])
    sections = [packing.Section(r["index"], r.path, packing.heredoc([(r["index"] + 1, r.path, r.text)]) if r.ok else f"@{r.path}\n[error: {r.error}]", r.ok) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (-packing.relevance(rows[i].path, rows[i].path.count("/"), rows[i].ok), i))
    chosen = packing.choose_many(packing.plans(sections, order, max_bytes, max_lines))
    shown = {s.index: s.text for s in sections if s.index in chosen.full} | ({chosen.partial.index: chosen.partial.text} if chosen.partial else {})
    return {"text": "\n\n".join(shown[i] for i in sorted(shown)), "plan": chosen}


def repo_map(repo: Repository, *, tokens: int = 1024, focus: list[str] | None = None, idents: list[str] | None = None, priority: list[str] | None = None, count: Callable[[str], int] | None = None) -> dict:
    """Ranked definitions as text within a budget of tokens: by PageRank of references, by imports where nothing is defined.

    The longest prefix of the ranking whose text fits is found by bisection; only ranked names come to the driver, as
    many as the budget can hold (a line takes two tokens at least).
    """
    count = count or (lambda s: -(-len(s) // 4))
    files = repo.files.select(F.col("path").alias("file"))
    defs = repo.tags.where("kind = 'def'").select("name", "file", "line")
    if defs.isEmpty():
        ranks = graph.import_ranks(files, repo.imports.withColumnRenamed("dst", "dst"), focus=focus, priority=priority).where("rank > 0").orderBy(F.desc("rank"), "file").limit(tokens)
        rows = [(r.file, None, 0) for r in ranks.collect()]
        basis = "imports"
    else:
        refs = repo.tags.where("kind = 'ref'").select("name", "file")
        edges = graph.reference_edges(defs, refs, mentioned=idents, focus=focus)
        personal = graph.personalization(files, focus=focus, mentioned=idents, refs=refs, defs=defs).withColumnRenamed("file", "id") if focus or idents else None
        ranks = graph.pagerank(files.withColumnRenamed("file", "id"), edges, personal, rounds=20, tolerance=1e-6).withColumnRenamed("id", "file")
        ranked = graph.tag_ranks(defs, ranks, focus=focus, idents=idents, files=priority).where("rank > 0").where(~F.col("file").isin(focus) if focus else F.lit(True))
        rows = [(r.file, r.name, r.line) for r in ranked.orderBy(F.desc("rank"), "file", "line", "name").limit(2 * tokens).collect()]
        basis = "references"

    def render(some: list[tuple]) -> str:
        by: dict[str, list[str]] = {}
        for file, name, _ in some:
            names = by.setdefault(file, [])
            if name is not None and name not in names:
                names.append(name)
        return "\n".join(f"{f}: {', '.join(n[:8])}{f' (+{len(n) - 8} more)' if len(n) > 8 else ''}" if n else f for f, n in by.items())

    lo, hi = 0, len(rows)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if count(render(rows[:mid])) <= tokens else (lo, mid - 1)
    return {"text": render(rows[:lo]), "shown": lo, "basis": basis}


def search(repo: Repository, mode: str, query: str, *, k: int = 50, context: str | None = None, embed: Embedder | None = None) -> DataFrame:
    """symbols, resolve, callers or code."""
    if mode == "symbols":
        found = symbols.search(repo.tags, query, k=k)
        return found.select("file", "line", "name", "kind") if not found.isEmpty() else symbols.search_lines(repo.files, query, k=k)
    if mode == "resolve":
        return symbols.resolve(repo.tags, query, context, repo.imports)
    if mode == "callers":
        return symbols.callers(repo.calls, query).limit(k)
    if mode == "code":
        return search_code(repo.files, query, k=min(k, 20), embed=embed)
    raise ValueError(f"unknown mode {mode}")


def search_code(files: DataFrame, query: str, *, k: int = 20, embed: Embedder | None = None, centrality: DataFrame | None = None, most: int = 3_000_000) -> DataFrame:
    """Definitions by BM25 over their text, fused with similarity where there is an embedder, and lifted by centrality."""
    defs = symbols.useful_definitions(extract.definitions(files)).withColumn("id", F.concat_ws(":", "file", F.col("start_line").cast("string")))
    defs = symbols.scan_cutoff(defs.withColumn("size", F.length("body")), "size", "id", most).drop("chars_before")
    kw = retrieval.bm25(defs, T.query_tokens(query), doc_id="id", text="body")
    if embed is None:
        scored = kw.where("kw_score > 0").withColumn("score", F.col("kw_score"))
    else:
        asked = retrieval.vector(embed([query])[0])
        head = defs.select("id", F.substring("body", 1, MOST_TEXT).alias("text"))
        sem = embedded(head, embed, key=["id"]).select("id", retrieval.cosine(F.col("vector"), asked, zero=0.0).alias("sem_score"))
        both = retrieval.ranked(retrieval.ranked(kw.join(sem, "id"), "kw_score", "kw_rank", "id"), "sem_score", "sem_rank", "id")
        scored = both.withColumn("score", retrieval.rrf("kw_rank", "sem_rank"))
    out = defs.join(scored.select("id", "score"), "id")
    if centrality is not None:
        from sparksift.operators.knowledge import boosted

        out = boosted(out, centrality)
    return out.orderBy(F.desc("score"), "id").limit(k).select("file", "start_line", "end_line", "name", "kind", "score")


def annotate(repo: Repository, file: str, changed: DataFrame | None = None, related: DataFrame | None = None) -> dict:
    """What a reader of a file may want: what it imports (8), who imports it, whether it changed recently, related files (6)."""
    imports = [r.dst for r in repo.imports.where(F.col("src") == file).select("dst").distinct().orderBy("dst").limit(8).collect()]
    users = [r.src for r in repo.imports.where(F.col("dst") == file).select("src").distinct().orderBy("src").limit(8).collect()]
    recent = changed is not None and not changed.where(F.col("path") == file).isEmpty()
    near = [(r.path, r.relation) for r in related.limit(6).collect()] if related is not None else []
    return {"imports": imports, "imported_by": users, "recent": recent, "related": near}


def hashed_embedder(dims: int = 64) -> Embedder:
    """A stand-in for a service: tokens hashed to a fixed number of dimensions. For tests and examples."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in T.query_tokens(t):
                v[sum(w.encode()) * 31 % dims] += 1
            out.append(v.tolist())
        return out

    return embed
