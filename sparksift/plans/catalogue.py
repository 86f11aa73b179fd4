"""The library's queries over the given tables, and their SQL.

The tables hold no source code, so repository operators run on analogues, as named here: a part is an identifier,
a supplier a file (line 1 of an order defines, the others refer), an order a commit, a page's URL a path; vec_id and
doc_id are taken as the same id (the tables state no relation between them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksift.functions import text as T
from sparksift.operators import graph, knowledge, packing, rerank, retrieval, symbols
from sparksift.operators import metrics as ir
from sparksift.session import table
from sparksift.sources import files as sources
from sparksift.sources import logs
from sparksift.streaming import mutations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

QUERY = "The blehe onInor thre2"
TERMS = T.query_tokens(QUERY)
#: A fixed query vector, of the embeddings' 64 dimensions.
VECTOR = [round(((i * 37) % 64 - 31.5) / 150, 6) for i in range(64)]
RULES = (("example", False), ("**/*.com", False), ("!net", True))
NOW = "2024-01-25 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


# Tokens: SQL shared by the text queries. terms(doc_id, term) holds each document's distinct tokens.
_TERMS = r"""
raw as (select doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^a-zA-Z0-9_]+'), lambda x: x <> '')) as w from documents),
spaced as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-zA-Z])([0-9])', '\1 \2', 'g'), '([0-9])([a-zA-Z])', '\1 \2', 'g') as s from raw),
parts as (select doc_id, unnest(list_filter(string_split_regex(s, '[ _]+'), lambda x: x <> '')) as p from spaced),
terms as (select distinct doc_id, term from (select doc_id, lower(w) as term from raw union all select doc_id, lower(unnest(case when regexp_full_match(p, '[A-Z][A-Z]+') then string_split(p, '') else [p] end)) from parts)),
lengths as (select d.doc_id, count(t.term) as dl from documents d left join terms t on t.doc_id = d.doc_id group by 1),
corpus as (select count(*) as n, greatest(1.0, avg(dl)) as avgdl from lengths)"""
_BM25 = f"""{_TERMS},
wanted as (select unnest({_list(TERMS)}) as term),
hits as (select t.doc_id, t.term from terms t join wanted w on w.term = t.term),
freq as (select term, count(*) as df from hits group by 1),
kw as (
    select l.doc_id, coalesce(sum(case when h.term is not null then ln((c.n - f.df + 0.5) / (f.df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * l.dl / c.avgdl)) end), 0) as kw_score
    from lengths l cross join corpus c left join hits h on h.doc_id = l.doc_id left join freq f on f.term = h.term group by 1)"""
_COSINE = f"cos as (select vec_id, list_cosine_similarity(embedding::double[], {VECTOR}::double[]) as score from embeddings)"


def _index(spark, sf):
    """The documents' token index, made once for a session and a state of the table."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    state = (sf, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength())
    held = sc.__dict__.setdefault("_sparksift_index", {})
    if state not in held:
        held[state] = retrieval.index(table(spark, sf, "documents"))
    return held[state]


@query(f"with {_TERMS} select doc_id, cast(count(*) as bigint) as n_terms, sha256(string_agg(term, ' ' order by term)) as digest from terms group by 1")
def tokenize_terms(spark, sf):
    """Each document's distinct tokens, as a count and a digest."""
    t = _index(spark, sf).where("dl > 0")
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("digest"))


@query(f"with {_TERMS} select d.doc_id, cast(l.dl as bigint) as dl, cast(octet_length(encode(d.text)) as bigint) as bytes, cast(case when d.text = '' then 0 else len(string_split(d.text, chr(10))) end as bigint) as n_lines, cast(ceil(length(d.text) / 4.0) as bigint) as est_tokens from documents d join lengths l on l.doc_id = d.doc_id")
def doc_token_stats(spark, sf):
    """Tokens, bytes, lines and the token estimate."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(T.token_set(t)).cast("long").alias("dl"), T.byte_count(t).alias("bytes"), T.line_count(t).alias("n_lines"), T.token_estimate(t).alias("est_tokens"))


@query(f"with {_TERMS} select term, cast(count(*) as bigint) as df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) as idf from terms cross join corpus group by term, n")
def term_idf(spark, sf):
    """A1, M1: document frequency and inverse document frequency of every token."""
    return retrieval.document_frequency(_index(spark, sf), indexed=True).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {_TERMS} select term, cast(count(*) as bigint) as df from terms where term in (select unnest({_list(TERMS)})) group by term")
def term_document_frequency(spark, sf):
    """A1: document frequency of the query's tokens."""
    return retrieval.document_frequency(_index(spark, sf), terms=TERMS, indexed=True).select("term", "df")


def _bm25(spark, sf):
    return retrieval.bm25(_index(spark, sf), TERMS, indexed=True)


@query(f"with {_BM25} select doc_id, round(kw_score, 9) as kw_score from kw")
def bm25_scores(spark, sf):
    """M1, A3: BM25 of every document."""
    return _bm25(spark, sf).select("doc_id", F.round("kw_score", 9).alias("kw_score"))


@query(f"with {_BM25}, r as (select doc_id, round(kw_score, 9) as s from kw where kw_score > 0) select doc_id, cast(row_number() over (order by s desc, doc_id) as bigint) as kw_rank from r")
def bm25_rank(spark, sf):
    """Places of all matching documents, numbered by range and not in one task."""
    hits = _bm25(spark, sf).where("kw_score > 0").select("doc_id", F.round("kw_score", 9).alias("s"))
    return retrieval.ranked(hits, "s", "kw_rank", "doc_id").select("doc_id", "kw_rank")


@query(f"with {_BM25} select doc_id, round(kw_score, 9) as kw_score from kw where kw_score > 0 order by 2 desc, 1 limit 20")
def bm25_topk(spark, sf):
    """L1: the 20 best matches."""
    return bm25_scores(spark, sf).where("kw_score > 0").orderBy(F.desc("kw_score"), "doc_id").limit(20)


def _cosine(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", retrieval.cosine(F.col("embedding"), retrieval.vector(VECTOR)).alias("score"))


@query(f"with {_COSINE} select vec_id, round(score, 9) as score from cos")
def cosine_similarity(spark, sf):
    """M2: cosine with a query vector."""
    return _cosine(spark, sf).select("vec_id", F.round("score", 9).alias("score"))


@query(f"with {_COSINE} select vec_id, cast(row_number() over (order by round(score, 9) desc, vec_id) as bigint) as sem_rank from cos")
def cosine_rank(spark, sf):
    """W1 over cosine."""
    return retrieval.ranked(cosine_similarity(spark, sf), "score", "sem_rank", "vec_id").select("vec_id", "sem_rank")


@query(f"with z as (select vec_id, list_transform(embedding::double[], lambda x: case when label % 3 = 0 then 0.0 else x end) as v from embeddings) select vec_id, round(case when list_sum(list_transform(v, lambda x: x * x)) = 0 then 0 else list_cosine_similarity(v, {VECTOR}::double[]) end, 9) as score from z")
def cosine_zero_norm(spark, sf):
    """Code search's cosine is 0 where a norm is 0; here for vectors of every third label, set to 0."""
    v = F.transform("embedding", lambda x: F.when(F.col("label") % 3 == 0, F.lit(0.0)).otherwise(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(retrieval.cosine(v, retrieval.vector(VECTOR), zero=0.0), 9).alias("score"))


@query(f"with {_COSINE}, c as (select e.label, cos.vec_id, round(score, 9) as s from cos join embeddings e on e.vec_id = cos.vec_id) select label, max(s) as sem_score, arg_max(vec_id, s * 1000000000 * 1000000 - vec_id) as best_chunk from c group by 1")
def max_chunk_similarity(spark, sf):
    """A label's vectors as a file's chunks: the best."""
    chunks = _cosine(spark, sf).select("label", "vec_id", F.round("score", 9).alias("score"))
    return retrieval.max_chunk_similarity(chunks, "label", "vec_id", "score")


_SCORED = f"""{_BM25}, {_COSINE},
scored as (select kw.doc_id, round(kw_score, 9) as kw_score, round(score, 9) as sem_score from kw join cos on cos.vec_id = kw.doc_id),
ranked as (select *, row_number() over (order by kw_score desc, doc_id) as kw_rank, row_number() over (order by sem_score desc, doc_id) as sem_rank from scored),
fused as (select *, 1.0::double / (60 + sem_rank) + 1.0::double / (60 + kw_rank) as rrf from ranked)"""


def _scored(spark, sf):
    kw = _bm25(spark, sf).select("doc_id", F.round("kw_score", 9).alias("kw_score"))
    sem = _cosine(spark, sf).select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("sem_score"))
    return kw.join(sem, "doc_id")


def _fused(spark, sf):
    out = retrieval.ranked(_scored(spark, sf), "kw_score", "kw_rank", "doc_id")
    out = retrieval.ranked(out, "sem_score", "sem_rank", "doc_id")
    return out.withColumn("rrf", retrieval.rrf("sem_rank", "kw_rank"))


@query(f"with {_SCORED} select doc_id, kw_rank, sem_rank, round(rrf, 12) as rrf from fused")
def rrf_fusion(spark, sf):
    """Fused ranks of all documents with a vector."""
    return _fused(spark, sf).select("doc_id", "kw_rank", "sem_rank", F.round("rrf", 12).alias("rrf"))


@query(f"with {_BM25} select doc_id, round(1.0::double / (60 + row_number() over (order by round(kw_score, 9) desc, doc_id)), 12) as rrf from kw where kw_score > 0")
def rrf_bm25_only(spark, sf):
    """M4: without embeddings the keyword rank alone."""
    return bm25_rank(spark, sf).select("doc_id", F.round(retrieval.rrf("kw_rank"), 12).alias("rrf"))


@query(f"with {_SCORED} select doc_id, kw_score, sem_score from scored where kw_score > 0 or sem_score >= 0.05")
def relevance_filter(spark, sf):
    """a keyword match, or a similarity of 0.05."""
    return _scored(spark, sf).where(retrieval.relevant()).select("doc_id", "kw_score", "sem_score")


@query(f"with {_SCORED} select doc_id, kw_score, sem_score, kw_rank, sem_rank, round(rrf, 12) as rrf from fused where kw_score > 0 or sem_score >= 0.05 order by round(rrf, 12) desc, doc_id limit 20")
def hybrid_topk(spark, sf):
    """The flagship: BM25 and cosine, fused, filtered, the 20 best."""
    hits = _fused(spark, sf).where(retrieval.relevant()).withColumn("rrf", F.round("rrf", 12))
    return hits.orderBy(F.desc("rrf"), "doc_id").limit(20).select("doc_id", "kw_score", "sem_score", "kw_rank", "sem_rank", "rrf")


# Reranking
@query("select doc_id, round(case when hi = lo then 0.5 else (n_chars - lo) / (hi - lo) end, 9) as scaled from documents cross join (select min(n_chars)::double as lo, max(n_chars)::double as hi from documents)")
def minmax_normalize(spark, sf):
    """A19 over document lengths."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return rerank.min_max(docs, "n_chars", "scaled").select("doc_id", F.round("scaled", 9).alias("scaled"))


def _signals(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    distance = F.when(F.col("quality").isNotNull(), F.col("doc_id") % 13)
    depth = F.when(F.col("toxic") == 0, F.col("doc_id") % 7)
    return d.select("doc_id", "n_chars", rerank.structural(distance, depth, (F.col("doc_id") % 3) / 40, F.when(F.col("quality") == 1, F.lit(0.5)), F.lit(None).cast("double")).alias("structural"))


_SIGNALS = """signals as (
    select d.doc_id, d.n_chars, list_filter([case when quality is not null then greatest(0.0, 1 - (d.doc_id % 13) / 10.0) end, case when toxic = 0 then greatest(0.0, 1 - (d.doc_id % 7) / 5.0) end,
        case when d.doc_id % 3 > 0 then least(1.0, 10.0 * (d.doc_id % 3) / 40.0) end, case when quality = 1 then 0.5 end]::double[], lambda x: x is not null) as s
    from documents d left join labels l on l.doc_id = d.doc_id),
structure as (select doc_id, n_chars, case when len(s) = 0 then 0 else list_sum(s) / len(s) end as structural from signals)"""


@query(f"with {_SIGNALS} select doc_id, round(structural, 9) as structural from structure")
def structural_score(spark, sf):
    """The mean of the signals that are there; labels as signals that may be missing."""
    return _signals(spark, sf).select("doc_id", F.round("structural", 9).alias("structural"))


@query(f"""with {_SCORED}, {_SIGNALS}, top as (select doc_id, rrf, row_number() over (order by round(rrf, 12) desc, doc_id) - 1 as rank from fused qualify rank < 30),
c as (select top.*, structural, (top.doc_id % 5)::double as path_score from top join structure s on s.doc_id = top.doc_id),
n as (select *, min(rrf) over () as a0, max(rrf) over () as a1, min(structural) over () as b0, max(structural) over () as b1, min(path_score) over () as c0, max(path_score) over () as c1 from c where rank < 20),
m as (select *, 0.6 * case when a0 = a1 then 0.5 else (rrf - a0) / (a1 - a0) end + 0.3 * case when b0 = b1 then 0.5 else (structural - b0) / (b1 - b0) end + 0.1 * case when c0 = c1 then 0.5 else (path_score - c0) / (c1 - c0) end as composite from n)
select doc_id, cast(rank as bigint) as rank, round(composite, 9) as composite, cast(row_number() over (order by round(composite, 9) desc, rank) - 1 as bigint) as new_rank, row_number() over (order by round(composite, 9) desc, rank) - 1 <> rank as changed from m
union all select doc_id, rank, null, rank, false from c where rank >= 20""")
def structural_rerank(spark, sf):
    """Composite of fused rank, structure and path; places from 20 on stay."""
    top = _fused(spark, sf).select("doc_id", F.round("rrf", 12).alias("r"), "rrf").orderBy(F.desc("r"), "doc_id").limit(30)
    top = retrieval.ranks(top, "r", "rank", "doc_id").withColumn("rank", F.col("rank") - 1).drop("r")
    c = top.join(_signals(spark, sf).drop("n_chars"), "doc_id").withColumn("path_score", (F.col("doc_id") % 5).cast("double"))
    return rerank.rerank(c).select("doc_id", "rank", F.round("composite", 9).alias("composite"), "new_rank", "changed")


@query(f"""with {_SCORED}, r as (select row_number() over (order by round(rrf, 12) desc, f.doc_id) as place, coalesce(l.quality, 0) as rel from fused f left join labels l on l.doc_id = f.doc_id),
k as (select * from r where place <= 20), t as (select sum(rel) as total from r)
select cast(20 as bigint) as k, round(sum(rel)::double / any_value(total), 9) as recall, round(sum(rel) / 20.0, 9) as precision, round(coalesce(1.0::double / min(case when rel = 1 then place end), 0), 9) as mrr,
    round(sum(rel / log2(place + 1)) / (select sum(1 / log2(i + 1)) from range(1, cast(least(20, any_value(total)) as bigint) + 1) x(i)), 9) as ndcg from k cross join t""")
def ir_metrics(spark, sf):
    """Labelled quality as relevance of the fused order."""
    r = retrieval.ranked(_fused(spark, sf).withColumn("r", F.round("rrf", 12)), "r", "place", "doc_id")
    judged = r.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ir.metrics(judged.select("place", (F.coalesce("quality", F.lit(0)) == 1).alias("relevant")), 20)


# Paths: page URLs without their scheme
_PATHS = "paths as (select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages)"


def _paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@query(f"with {_PATHS}, t as (select page_id, path, len(list_intersect(list_filter(regexp_split_to_array(lower(path), '[^a-z0-9_]+'), lambda x: x <> ''), ['example', 'net', 'the'])) as overlap from paths) select page_id, cast(overlap as bigint) as overlap from t order by overlap desc, page_id limit 50")
def path_presort(spark, sf):
    """Paths by how many query tokens they hold."""
    p = _paths(spark, sf).select("page_id", T.path_overlap(F.lower("path"), ["example", "net", "the"]).cast("long").alias("overlap"))
    return p.orderBy(F.desc("overlap"), "page_id").limit(50)


@query(f"with {_PATHS} select page_id, list_contains(string_split(path || case when page_id % 7 = 0 then '/../x' else '' end, '/'), '..') as unsafe from paths")
def path_guard(spark, sf):
    """paths with a parent segment (put into every seventh)."""
    path = F.concat("path", F.when(F.col("page_id") % 7 == 0, "/../x").otherwise(""))
    return _paths(spark, sf).select("page_id", T.unsafe_path(path).alias("unsafe"))


@query("with s(i, suffix) as (values (0, '.py'), (1, '.TS'), (2, '.rs'), (3, '.md'), (4, '')) select page_id, case s.i when 0 then 'python' when 1 then 'typescript' when 2 then 'rust' end as lang from pages join s on s.i = page_id % 5")
def language_detect(spark, sf):
    """language by suffix (given to the URLs in turn)."""
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".py", ".TS", ".rs", ".md", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return _paths(spark, sf).select("page_id", T.language(F.concat(F.lit("src/a.b/main"), suffix)).alias("lang"))


@query(f"""with {_PATHS}, p as (select page_id, regexp_replace(path, '[?].*$', '') as path from paths), made as (select page_id, case when path like '%.html' then path when page_id % 2 = 0 then path || '/../' || 'a.go' else path || '.' || ['py', 'TSX', 'txt', 'rs'][page_id % 4 + 1] end as path from p)
select page_id, list_contains(string_split(path, '/'), '..') as unsafe, regexp_matches(lower(path), '[.](go|py|tsx|rs)$') and not list_contains(string_split(path, '/'), '..') as supported from made""")
def supported_files(spark, sf):
    """F2, F3 together: pages' paths, some through a parent folder, by whether they are safe and of a known language."""
    p = _paths(spark, sf).withColumn("path", F.regexp_replace("path", "[?].*$", ""))
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".py", ".TSX", ".txt", ".rs"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.when(F.col("path").endswith(".html"), F.col("path")).when(F.col("page_id") % 2 == 0, F.concat("path", F.lit("/../a.go"))).otherwise(F.concat("path", suffix))
    unsafe = T.unsafe_path(path)
    return p.select("page_id", unsafe.alias("unsafe"), (T.language(path).isNotNull() & ~unsafe).alias("supported"))


@query(f"""with {_PATHS}, rules(ord, neg, re) as (values (0, false, '^(?:.*/)?[^/]*e[^/]*(?:/.*)?$'), (1, true, '^(?:.*/)?[^/]*\\.net(?:/.*)?$'), (2, false, '^m\\.[^/]*(?:/.*)?$'))
select page_id, coalesce(arg_max(not neg, ord) filter (regexp_matches(path, re)), false) as ignored from paths cross join rules group by page_id""")
def ignore_rules_last_match(spark, sf):
    """The last matching ignore rule decides."""
    rules = sources.parse_rules("*e*\n!*.net\n/m.*\n")
    return sources.ignored(_paths(spark, sf), rules, path="path").select("page_id", "ignored")


@query(f"with {_PATHS} select page_id, upper(lpad(printf('%x', h), 6, '0'))[1:6] as hash from (select page_id, list_reduce(list_prepend(5381::bigint, list_transform(string_split(path, ''), lambda c: ascii(c)::bigint)), lambda a, b: (a * 33 + b) & 4294967295) as h from paths)")
def path_hash_djb2(spark, sf):
    """The short hash of a path."""
    return _paths(spark, sf).select("page_id", T.path_hash(F.col("path")).alias("hash"))


@query(f"with {_PATHS}, d as (select page_id, path, regexp_replace(path, '/?[^/]*$', '') as dir from paths), h as (select path as hp, dir as hd from d order by page_id limit 1) select page_id, cast(case when path = hp then 100 when dir = hd then 50 when dir = '' or starts_with(hd, dir || '/') then 30 else 10 end as int) as score from d cross join h")
def definition_proximity(spark, sf):
    """Nearness of every path to the first page's."""
    p = _paths(spark, sf)
    first = p.orderBy("page_id").first()
    return p.select("page_id", symbols.proximity(F.col("path"), first.path if first else "").cast("int").alias("score"))


# Tags: parts as identifiers, suppliers as files
_TAGS = "tags as (select l_suppkey as file, p_name as name, case when l_linenumber = 1 then 'def' else 'ref' end as kind, l_orderkey as line from lineitem join part on p_partkey = l_partkey)"


def _tags(spark, sf):
    """(file, name, kind, line) of all parts and lines."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    line = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), F.when(F.col("l_linenumber") == 1, "def").otherwise("ref").alias("kind"))
    return line.join(part, "l_partkey").select("file", "name", "kind", "line")


def _defs_refs(spark, sf):
    t = _tags(spark, sf)
    return t.where("kind = 'def'"), t.where("kind = 'ref'")


_EDGES = f"""{_TAGS},
d as (select distinct name, file from tags where kind = 'def'), n as (select name, count(*) as definers from d group by 1),
r as (select name, file, count(*) as c from tags where kind = 'ref' group by 1, 2),
raw as (
    select r.file as src, d.file as dst, greatest(1.0, floor(
        case when (r.name like '%\\_%' escape '\\' or r.name like '%-%' or (regexp_matches(r.name, '[a-z]') and regexp_matches(r.name, '[A-Z]'))) and length(r.name) >= 8 and not starts_with(r.name, '_') then 10.0 else 1.0 end
        * case when starts_with(r.name, '_') then 0.1 else 1.0 end * case when definers > 5 then 0.1 else 1.0 end * case when r.file in (1, 2) then 50.0 else 1.0 end * sqrt(c) + 0.5)) as weight
    from r join n on n.name = r.name join d on d.name = r.name where r.file <> d.file
    union all select file, file, 0.1 from d where name not in (select name from r)),
edges as (select src, dst, sum(weight) as weight from raw group by 1, 2)"""


def _edges(spark, sf):
    defs, refs = _defs_refs(spark, sf)
    return graph.reference_edges(defs, refs, focus=[1, 2])


def _factors(spark, sf):
    defs, refs = _defs_refs(spark, sf)
    return graph.reference_factors(defs, refs, focus=[1, 2])


@query(f"with {_EDGES} select src, dst, round(weight, 9) as weight from edges")
def def_ref_edges(spark, sf):
    """The weighted file graph."""
    return _edges(spark, sf).select("src", "dst", F.round("weight", 9).alias("weight"))


@query("with t as (select l_orderkey as name, l_suppkey as file, case when l_linenumber = 1 then 'def' else 'ref' end as kind from lineitem) select distinct name, file from t where kind = 'def' and name not in (select name from t where kind = 'ref')")
def unreferenced_selfloops(spark, sf):
    """Names that are defined and never referred to; orders as names, those of a single line are referred to nowhere."""
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("file"), (F.col("l_linenumber") == 1).alias("defines"))
    return graph.unreferenced(t.where("defines"), t.where("not defines"))


@query("""with i as (select distinct p_type as name, p_size as definers from part union select unnest(['user_service', '_private_name', 'getUserById', 'short', 'kebab-case-name', 'get_x']), 3)
select name, cast(definers as int) as definers, round(case when name = 'short' then 10.0 else 1.0 end * case when (name like '%\\_%' escape '\\' or name like '%-%' or (regexp_matches(name, '[a-z]') and regexp_matches(name, '[A-Z]'))) and length(name) >= 8 and not starts_with(name, '_') then 10.0 else 1.0 end
    * case when starts_with(name, '_') then 0.1 else 1.0 end * case when definers > 5 then 0.1 else 1.0 end, 9) as weight from i""")
def identifier_multiplier(spark, sf):
    """M5 over part types and some identifiers."""
    words = spark.createDataFrame([(w, 3) for w in ("user_service", "_private_name", "getUserById", "short", "kebab-case-name", "get_x")], "name string, definers int")
    i = table(spark, sf, "part").select(F.col("p_type").alias("name"), F.col("p_size").alias("definers")).distinct().unionByName(words)
    return i.select("name", "definers", F.round(graph.identifier_weight(F.col("name"), F.col("definers"), F.col("name") == "short"), 9).alias("weight"))


def _pagerank_sql(rounds: int, personal: str) -> str:
    steps = ", ".join(
        f"r{i} as (select b.id, 0.15 * b.p + 0.85 * (coalesce(c.came, 0) + l.lost * b.p) as rank from base b left join (select dst as id, sum(rank * w) as came from share join r{i - 1} on id = src group by 1) c on c.id = b.id cross join (select coalesce(sum(rank), 0) as lost from r{i - 1} where id not in (select src from share)) l)"
        for i in range(1, rounds + 1)
    )
    return f"with {_EDGES}, nodes as (select s_suppkey as id from supplier), share as (select src, dst, weight / sum(weight) over (partition by src) as w from edges), personal as ({personal}), base as (select n.id, coalesce(p.weight, 0) / (select sum(weight) from personal) as p from nodes n left join personal p on p.id = n.id), r0 as (select id, 1.0::double / count(*) over () as rank from nodes), {steps} select id, round(rank, 9) as rank from r{rounds}"


def _nodes(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))


@query(_pagerank_sql(10, "select id, 1.0::double as weight from nodes"))
def pagerank_fixed(spark, sf):
    """M7: ten rounds."""
    return graph.pagerank(_nodes(spark, sf), _factors(spark, sf), rounds=10, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


_FOCUS = "p as (select 100.0::double / count(*) as p from supplier), used as (select name, count(*) as n from tags where kind = 'ref' and file in (1, 2) group by 1), linked as (select d.file, sum(n) as n from d join used on used.name = d.name where d.file not in (1, 2) group by 1)"
_PERSONAL = "select s_suppkey as id, case when s_suppkey in (1, 2) then p else 0 end + case when s_suppkey = 5 then p else 0 end + coalesce(n, 0) * 0.1 * p as weight from supplier cross join p left join linked on file = s_suppkey"


def _personal(spark, sf):
    defs, refs = _defs_refs(spark, sf)
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"))
    return graph.personalization(files, focus=[1, 2], mentioned_files=[5], refs=refs, defs=defs)


@query(f"with {_EDGES}, {_FOCUS} select id as file, round(weight, 9) as weight from ({_PERSONAL})")
def personalization(spark, sf):
    """What a focus gives to files."""
    return _personal(spark, sf).select("file", F.round("weight", 9).alias("weight"))


@query(_pagerank_sql(10, _PERSONAL).replace("nodes as (", f"{_FOCUS}, nodes as (", 1))
def pagerank_personalized(spark, sf):
    """M7, M8: ten rounds with a focus."""
    personal = _personal(spark, sf).withColumnRenamed("file", "id")
    return graph.pagerank(_nodes(spark, sf), _factors(spark, sf), personal, rounds=10, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(5, "select id, 1.0::double as weight from nodes").replace("select id, round(rank, 9) as rank from r5", "select d.name, d.file, round(rank * case when d.file in (1, 2) then 20 else 1 end * case when d.file = 3 then 5 else 1 end, 9) as rank from d join r5 on r5.id = d.file"))
def tag_rank(spark, sf):
    """Definitions by their file's rank, focus and priority."""
    defs, _ = _defs_refs(spark, sf)
    ranks = graph.pagerank(_nodes(spark, sf), _factors(spark, sf), rounds=5, tolerance=None).withColumnRenamed("id", "file")
    return graph.tag_ranks(defs.select("name", "file").distinct(), ranks, focus=[1, 2], files=[3]).select("name", "file", F.round("rank", 9).alias("rank"))


@query("""with links as (select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as dst from pages), f as (select distinct dst as file from links), n as (select dst, count(*) as n from links group by 1)
select file, cast(n as bigint) as indegree, round(n::double / max(n) over () + case when file = '/the' then 2 else 0 end, 9) as rank from f join n on dst = file""")
def import_indegree_rank(spark, sf):
    """Targets of links as imported files."""
    links = table(spark, sf, "pages").select(F.col("page_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("dst"))
    files = links.select(F.col("dst").alias("file")).distinct()
    return graph.import_ranks(files, links, focus=["/the"]).select("file", "indegree", F.round("rank", 9).alias("rank"))


@query(f"with {_TAGS}, u as (select distinct file as src, name from tags where kind = 'ref' and file in (1, 2, 3)), d as (select distinct name, file as dst from tags where kind = 'def') select src, dst, min(u.name) as name, cast(0.9 as double) as confidence from u join d on d.name = u.name where src <> dst group by 1, 2")
def symbol_neighbours(spark, sf):
    """Files that define what three files refer to."""
    defs, refs = _defs_refs(spark, sf)
    return graph.symbol_neighbours(defs, refs, [1, 2, 3])


@query(f"with {_TAGS}, s as (select min(name) as symbol from tags), f as (select file, kind, row_number() over (partition by file order by line, kind) as i from tags join s on name = symbol) select file, case when kind = 'def' then 'defines' else 'references' end as edge_type, cast(case when kind = 'def' then 0.9 else 0.8 end as double) as confidence from f where i = 1")
def symbol_files(spark, sf):
    """Files with a tag of a name; the first tag decides."""
    t = _tags(spark, sf)
    first = t.agg(F.min("name")).first()[0]
    return graph.symbol_files(t, first or "")


@query(f"with {_TAGS}, hits as (select * from tags where contains(lower(name), 'blue') order by kind, name, file, line limit 50) select file, line, name, kind from hits")
def symbol_search(spark, sf):
    """Names that hold a query, definitions first."""
    return symbols.search(_tags(spark, sf), "BLUE").select("file", "line", "name", "kind")


@query(f"with {_TAGS} select file, cast(count(*) filter (kind = 'def') as bigint) as defs, cast(count(*) filter (kind = 'ref') as bigint) as refs from tags group by 1")
def tag_counts(spark, sf):
    """Definitions and references of each file."""
    return symbols.tag_counts(_tags(spark, sf))


@query(f"with {_TAGS}, f as (select file, name, min(line) as line from tags where kind = 'def' group by 1, 2), g as (select file, list(name order by line, name) as n from f group by 1) select file, array_to_string(n[1:8], '|') as symbols, cast(greatest(len(n) - 8, 0) as int) as more from g")
def file_symbols(spark, sf):
    """Each file's first defined names."""
    return symbols.file_symbols(_tags(spark, sf)).select("file", F.array_join("symbols", "|").alias("symbols"), "more")


@query("""with w as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
h as (select doc_id as file, line, list_filter(regexp_extract_all(text, '\\b([A-Za-z_$][\\w$]*)\\b', 1), lambda n: contains(lower(n), 'inorble'))[1] as name from w where contains(lower(text), 'inorble'))
select file, cast(line as int) as line, name, 'ref' as kind from h where name is not null order by kind, file, line limit 50""")
def text_line_search(spark, sf):
    """Lines that hold a query (no line of the prose is a declaration of such a name)."""
    return symbols.search_lines(table(spark, sf, "documents"), "inorBLE", path="doc_id", body="text")


@query("select distinct conv_id, role as caller from (select conv_id, role, lead(role) over (partition by conv_id order by turn) as callee from conversations) where callee = 'assistant'")
def callers_distinct(spark, sf):
    """Roles whose turn an assistant's follows, as callers of it."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("caller"), F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("callee"))
    return symbols.callers(c, "assistant").select(F.col("file").alias("conv_id"), "caller")


@query("select doc_id, cast(before as bigint) as chars_before from (select doc_id, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents) where before < 300000")
def code_scan_cutoff(spark, sf):
    """Documents in order until 300,000 characters have been read."""
    return symbols.scan_cutoff(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 300_000).select("doc_id", "chars_before")


# Changes and commits: orders as commits, parts as files
_COMMITS = "commits as (select l_orderkey as commit_id, l_partkey as path from lineitem)"


def _commits(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"))


@query(f"with {_COMMITS}, t as (select distinct commit_id from commits where path = 1), p as (select path, count(distinct commit_id) as c from commits where path <> 1 and commit_id in (select commit_id from t) group by 1) select path, cast(c as bigint) as count, round(c::double / (select count(*) from t), 9) as correlation from p order by c desc, path limit 5")
def co_commit(spark, sf):
    """What changes together with a file."""
    return graph.co_changes(_commits(spark, sf), 1).select("path", "count", F.round("correlation", 9).alias("correlation"))


@query(f"select distinct user_id from events where ts >= timestamp '{NOW}' - interval 7 day and ts <= timestamp '{NOW}'")
def recently_modified(spark, sf):
    """Users with an event in the last seven days."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("ts"))
    return logs.recent(e, NOW, days=7).select(F.col("path").alias("user_id"))


_MUTATIONS = f"""m as (
    select case when event_type = 'error' then 'breakage' else 'co_change' end as type, user_id as src, cast(json_extract(props, '$.k') as bigint) as dst, round(value / 1000, 6) as confidence, ts, event_id from events
    where ts >= timestamp '{NOW}' - interval 30 day),
dedup as (select src, dst, type, confidence, event_id from m qualify row_number() over (partition by src, dst, type order by confidence desc, ts desc, event_id) = 1)"""


def _mutations(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.when(F.col("event_type") == "error", "breakage").otherwise("co_change").alias("type"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), F.round(F.col("value") / 1000, 6).alias("confidence"), F.col("ts"), "event_id")


@query(f"with {_MUTATIONS} select src, dst, type, confidence from dedup")
def mutation_log_dedup(spark, sf):
    """Edges of the last 30 days, the most confident of each kind."""
    return logs.strongest(logs.fresh(_mutations(spark, sf), NOW), "event_id").select("src", "dst", "type", "confidence")


@query(f"with {_MUTATIONS} select distinct case when src = 7 then dst else src end as id, type from dedup where src = 7 or dst = 7")
def mutation_neighbours(spark, sf):
    """Nodes that a logged edge joins to one."""
    edges = logs.strongest(logs.fresh(_mutations(spark, sf), NOW), "event_id")
    return logs.neighbours(edges, 7).select("id", "type")


@query(f"with {_MUTATIONS} select src, dst, type, max(confidence) as confidence from m group by 1, 2, 3")
def mutation_stream(spark, sf):
    """The log as a stream, run until it has read all there is: the highest confidence of each edge."""
    return mutations.strongest_once(spark, _mutations(spark, sf).where(F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("interval 30 days")))


# Knowledge graph: nations and customers' segments as nodes, orders as links
_KG = """nodes as (select c_custkey as id, c_name as label, 'file' || c_nationkey as source_file, c_custkey % 9 as community from customer),
links as (select o_custkey as source, (o_orderkey * 7) % (select max(c_custkey) from customer) + 1 as target, o_orderpriority as relation, round(o_totalprice / 1000000, 6) as score from orders),
two as (select source as a, target as b from links union all select target, source from links),
deg as (select a as id, count(distinct b) as degree from two where a <> b group by 1)"""


def _kg(spark, sf):
    c = table(spark, sf, "customer")
    n = c.agg(F.max("c_custkey")).first()[0] or 1
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.concat(F.lit("file"), F.col("c_nationkey")).alias("source_file"), (F.col("c_custkey") % 9).alias("community"))
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") * 7 % n + 1).alias("target"), F.col("o_orderpriority").alias("relation"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence_score"))
    return nodes, links


@query(f"with {_KG} select id, cast(degree as bigint) as degree from deg")
def kg_degree(spark, sf):
    """Distinct neighbours."""
    return knowledge.degrees(_kg(spark, sf)[1])


@query(f"with {_KG} select n.id, label, cast(degree as bigint) as degree from nodes n join deg on deg.id = n.id order by degree desc, n.id limit 10")
def kg_god_nodes(spark, sf):
    """The most connected nodes."""
    return knowledge.god_nodes(*_kg(spark, sf))


@query(f"with {_KG} select source_file, cast(coalesce(max(degree), 0) as bigint) as centrality from nodes left join deg on deg.id = nodes.id group by 1")
def kg_file_centrality(spark, sf):
    """A file's highest degree."""
    return knowledge.file_centrality(*_kg(spark, sf))


@query(f"with {_KG}, n as (select source_file, community, count(*) as c from nodes group by 1, 2) select source_file, community from n qualify row_number() over (partition by source_file order by c desc, community) = 1")
def file_community_mode(spark, sf):
    """A file's most frequent community."""
    return knowledge.file_community(_kg(spark, sf)[0])


@query(f"with {_KG} select community, array_to_string(list_sort(list(distinct source_file)), '|') as files from nodes group by 1")
def community_members(spark, sf):
    """The files of each community."""
    return knowledge.community_members(_kg(spark, sf)[0]).select("community", F.array_join("files", "|").alias("files"))


@query(f"with {_KG} select cast(count(*) as bigint) as nodes, cast(count(distinct community) as bigint) as communities, cast(count(distinct source_file) as bigint) as files, (select cast(count(*) as bigint) from (select distinct source, target from links)) as links from nodes")
def kg_stats(spark, sf):
    """Sizes of the graph."""
    return knowledge.stats(*_kg(spark, sf))


@query(f"with recursive {_KG}, edges as (select distinct a, b from two), reach(id, d) as (select id, 0 from nodes where id in (1, 2, 3) union select b, d + 1 from reach join edges on a = id where d < 3) select id, cast(min(d) as int) as distance from reach group by 1")
def kg_bfs_depth3(spark, sf):
    """P20: nodes up to three links from three seeds."""
    nodes, links = _kg(spark, sf)
    return knowledge.within(nodes, links, [1, 2, 3], 3)


@query(f"with {_KG}, s as (select id, case when contains(lower(label), 'customer') then 1.0 else 0 end + case when lower(source_file) = 'x' or contains(lower(source_file), 'file1') then 0.5 else 0 end + case when contains(lower(label), 'file1') then 1 else 0 end + case when contains(lower(source_file), 'customer') then 0.5 else 0 end as score from nodes) select id, cast(score as double) as score from s where score > 0")
def kg_query_score(spark, sf):
    """Nodes by how a query's terms occur in label and file."""
    return knowledge.query_scores(_kg(spark, sf)[0], ["Customer", "file1", "of"])


@query(f"""with {_KG}, dirs as (select source as a, target as b, relation, score from links union all select target, source, relation, score from links),
f as (select dirs.*, n.source_file as path from dirs join nodes m on m.id = a and m.source_file = 'file3' join nodes n on n.id = b where n.source_file <> 'file3'),
x as (select * from f qualify row_number() over (partition by a, b order by score desc, relation) = 1)
select path, relation, score as confidence from x qualify row_number() over (partition by path order by a, score desc, b) = 1""")
def kg_related_files(spark, sf):
    """Files linked to one; its first node's best link to each."""
    return knowledge.related_files(*_kg(spark, sf), "file3")


# Packing
_SIZES = "sizes as (select doc_id, octet_length(encode(text)) as bytes, case when text = '' then 0 else len(string_split(text, chr(10))) end as n_lines, row_number() over (order by doc_id) as i from documents)"


def _sizes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.byte_count(F.col("text")).alias("bytes"), T.line_count(F.col("text")).alias("n_lines"))


@query(f"with {_SIZES} select doc_id, cast(sum(bytes + case when i > 1 then 2 else 0 end) over (order by doc_id) as bigint) as used_bytes, cast(sum(n_lines + case when i > 1 then 1 else 0 end) over (order by doc_id) as bigint) as used_lines from sizes")
def running_budget(spark, sf):
    """Bytes and lines used up to each candidate."""
    return packing.running(_sizes(spark, sf), "doc_id").select("doc_id", "used_bytes", "used_lines")


@query(f"with {_SIZES}, u as (select doc_id, i, sum(bytes + case when i > 1 then 2 else 0 end) over (order by doc_id) as b, sum(n_lines + case when i > 1 then 1 else 0 end) over (order by doc_id) as l from sizes) select doc_id from u where i < coalesce((select min(i) from u where b > 51200 or l > 2000), 1000000000)")
def pack_prefix(spark, sf):
    """P1 in request order: candidates up to the first that does not fit."""
    return packing.prefix(_sizes(spark, sf), "doc_id", 51200, 2000).select("doc_id")


@query()
def pack_skip(spark, sf):
    """P1 smallest first: what does not fit is passed over (a sequential fold, which SQL cannot do over all documents in time; tests hold it against a plain loop)."""
    return packing.skip(_sizes(spark, sf), ["bytes", "doc_id"], "doc_id", 51200, 2000)


@query("""with b as (select doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^[ \\t]*(import|require|from)\\b[^\\n]*(\\n|$)', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') as s from documents)
select doc_id, md5(case when length(s) > 1000 then substr(s, 1, 600) || chr(10) || '...' || chr(10) || right(s, 400) else s end) as digest from b""")
def compress_snippet(spark, sf):
    """Texts without imports, shortened."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.compressed(F.col("text"))).alias("digest"))


@query()
def char_chunks(spark, sf):
    """Overlapping chunks at paragraph, line or word ends (sequential; tests hold it against a plain loop)."""
    from sparksift.operators import chunking

    return chunking.chunks(table(spark, sf, "documents"), doc_id="doc_id", body="text").select("doc_id", "chunk_index", "start", "end", "estimated_tokens", "hard_split")


@query()
def symbol_chunks(spark, sf):
    """Chunks by symbol spans, by characters where there are none."""
    from sparksift.operators import chunking

    return chunking.chunks(table(spark, sf, "documents"), doc_id="doc_id", body="text", symbols=True).select("doc_id", "chunk_index", "start", "end", "kind", "name")


_EXPAND = f"""{_TAGS}, u as (select distinct name from tags where kind = 'ref' and file in (1, 2)),
c as (select distinct 0 as phase, file, cast(file as bigint) as ord from tags where file in (1, 2)
    union all select 1, d.file, min(d.line) from tags d join u on u.name = d.name where d.kind = 'def' group by 2
    union all select distinct 2, user_id, user_id from events where event_type = 'error'),
first as (select file, min(phase) as phase from c group by 1)
select c.file, cast(c.phase as int) as phase from first join c on c.file = first.file and c.phase = first.phase order by c.phase, c.ord, c.file limit 20"""


@query(f"with {_EXPAND}")
def candidate_expansion(spark, sf):
    """Seeds, then files of their symbols, then logged ones; the first source wins, 20 in all."""
    from sparksift.operators import expand

    t = _tags(spark, sf)
    seeds = t.where(F.col("file").isin(1, 2)).select("file", F.col("file").cast("long").alias("ord")).distinct()
    used = t.where((F.col("kind") == "ref") & F.col("file").isin(1, 2)).select("name").distinct()
    linked = t.where("kind = 'def'").join(used, "name", "left_semi").groupBy("file").agg(F.min("line").alias("ord"))
    logged = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("user_id").alias("ord")).distinct()
    return expand.phased([seeds, linked, logged], 20).select("file", "phase")


@query("select a.doc_id from documents a where a.lang = 'en' and a.doc_id not in (select doc_id from labels where quality = 0)")
def set_difference(spark, sf):
    """An anti join."""
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").join(bad, "doc_id", "left_anti")


@query("select doc_id from documents where lang = 'fr' union select doc_id from labels where quality = 0 union select item_id from benchmark")
def union_distinct(spark, sf):
    """A union of file sets."""
    t = lambda n: table(spark, sf, n)
    return t("documents").where("lang = 'fr'").select("doc_id").unionByName(t("labels").where("quality = 0").select("doc_id")).unionByName(t("benchmark").select(F.col("item_id").alias("doc_id"))).distinct()


@query("select not exists (select doc_id from documents except select doc_id from labels) and not exists (select doc_id from labels except select doc_id from documents) as equal")
def file_set_equal(spark, sf):
    """U4: whether two file sets are equal."""
    from sparksift.operators import expand

    return expand.same_set(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"))


@query("select conv_id, cast(count(*) as bigint) as n, cast(sum(length(text)) as bigint) as total, arg_max(turn, length(text) * 1000 + turn) as slowest, arg_min(turn, length(text) * 1000 + turn) as fastest from conversations group by 1")
def parse_stats(spark, sf):
    """A18 by conversation: turns as files, characters as times."""
    c = table(spark, sf, "conversations")
    size = F.length("text")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("total"), F.max_by("turn", F.struct(size, F.col("turn"))).alias("slowest"), F.min_by("turn", F.struct(size, F.col("turn"))).alias("fastest"))
