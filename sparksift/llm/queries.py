"""The corpus operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, near_dup, neighbours, packing, pitman_yor, quality, secrets, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int):
    """crc32 of an id as text, modulo ``n``, as a column."""
    return F.crc32(F.col(column).cast("string")) % n


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts and digest of the pattern kinds, and the spans of all kinds."""
    base, entropy = secrets.found("text")
    rows = _table(spark, sf_dir, "documents").select("doc_id", base.alias("base"), entropy.alias("entropy"))
    name = F.array(*(F.lit(k) for k in secrets.KINDS))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "entropy"))).alias("spans"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its set of 4-word shingles, its group of near copies, whether it is the one kept."""
    return near_dup.groups(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its bytes, those that a 50-byte string of an earlier document covers, in how many runs, and a digest of the rest."""
    out = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id is divisible by 20: the 20 nearest others found, by inner product."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: log10 probabilities of its words under the model and under add-one unigrams, learnt outside fold 2 of 7."""
    return pitman_yor.score(_table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and license template that it holds: the containment and where it begins."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text and that text's code points."""
    out = html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = 3000) -> quality.Model:
    """A quality model from the labels outside fold 2 of 4: at most ``max_train`` of them, those whose id hashes lowest."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id", 4) != 2)).select("doc_id", F.col("quality").alias("label"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "label").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    return quality.fit(rows, key="doc_id", max_train=max_train)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label was held out, the score, and whether that reaches 0.7."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, length bucket, batch and place."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and benchmark item that overlap: matched words, words of the stretch and its bytes in the document."""
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_near_dup, op3_suffix_dedup, op4_neighbours, op5_pitman_yor, op6_licenses, op7_html_text, op8_quality, op9_packing, op10_decontaminate)}

_SPANS = """
    select doc_id, {k} as kind, i, m[i] as value, length(g[i]) as least,
        cast(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) as start
    from (select doc_id, string_split_regex(s, {p}) as gaps, regexp_extract_all(s, {p}) as m, regexp_extract_all(s, {p}, {g}) as g, unnest(generate_series(1, len(regexp_extract_all(s, {p})))) as i from t where regexp_matches(s, {p}))"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = {
    "op1_secrets": f"""
with t as (select doc_id, coalesce(text, '') as s from documents),
hits as (
    select * from ({_SPANS.format(k=0, p=_sql(secrets.ASSIGN), g=2)}) where least >= 6
    union all select * from ({_SPANS.format(k=1, p=_sql(secrets.ACCESS), g=0)}) where least >= 20
    union all select * from ({_SPANS.format(k=2, p=_sql(secrets.HEX), g=0)}) where least >= 24),
runs as ({_SPANS.format(k=3, p=_sql(secrets.CANDIDATE), g=0)}),
scored as (
    select *, list_max(list_transform(generate_series(1, length(value) - {secrets.WINDOW} + 1), lambda i: list_aggregate(string_split(substr(value, i, {secrets.WINDOW}), ''), 'entropy'))) as bits,
        case when regexp_full_match(value, '[0-9a-f]+|[0-9A-F]+') then 3 when regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[0-9]') then 4 end as class
    from runs where not regexp_matches(value, {_sql(secrets.ALLOW)})),
every as (
    select doc_id, kind, start, start + length(value) as stop from hits
    union all select doc_id, class, start, start + length(value) from scored where (class = 3 and bits + 1e-9 >= {secrets.HEX_BITS}) or (class = 4 and bits + 1e-9 >= {secrets.BASE64_BITS})),
named as (select *, ['assign', 'access', 'hex', 'hex_entropy', 'base64_entropy'][kind + 1] || ':' || start || ':' || stop as span from every)
select t.doc_id, cast(count(*) filter (kind = 0) as bigint) as n_assign, cast(count(*) filter (kind = 1) as bigint) as n_access, cast(count(*) filter (kind = 2) as bigint) as n_hex,
    sha256(coalesce(string_agg(span, ',' order by start, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, kind), '') as spans
from t left join named on t.doc_id = named.doc_id group by t.doc_id""",
    "op3_suffix_dedup": """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as w from (select doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) as i from t where length(h) >= 100)),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by w) as least from w) where least < doc_id),
marks as (select doc_id, i, case when lag(i) over (partition by doc_id order by i) >= i - 50 then 0 else 1 end as fresh from gone),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from marks) group by doc_id, run),
kept as (
    select doc_id, string_agg(piece, '' order by a) as h from (
        select r.doc_id, r.a, substr(t.h, 2 * coalesce(lag(r.b) over (partition by r.doc_id order by r.a), 0) + 1, 2 * (r.a - coalesce(lag(r.b) over (partition by r.doc_id order by r.a), 0))) as piece from runs r join t on t.doc_id = r.doc_id
        union all select r.doc_id, 1e18, substr(t.h, 2 * max(r.b) + 1) from runs r join t on t.doc_id = r.doc_id group by r.doc_id, t.h)
    group by doc_id)
select t.doc_id, cast(length(t.h) // 2 as bigint) as n_bytes, cast(coalesce(r.n, 0) as bigint) as n_removed, cast(coalesce(r.c, 0) as bigint) as n_spans, sha256(unhex(coalesce(k.h, t.h))) as kept_sha256
from t left join (select doc_id, sum(b - a) as n, count(*) as c from runs group by 1) r on r.doc_id = t.doc_id left join kept k on k.doc_id = t.doc_id""",
    "op6_licenses": f"""
with templates(license, body) as (values {", ".join(f"({_sql(n)}, {_sql(t)})" for n, t in licenses.TEMPLATES)}),
words as (
    select 'd' as side, doc_id as id, '' as license, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents
    union all select 't', null, license, regexp_extract_all(lower(body), '[a-z0-9]+') from templates),
shingles as (
    select side, id, license, i - 1 as i, array_to_string(w[i:i+{licenses.WORDS - 1}], ' ') as s
    from (select *, unnest(generate_series(1, greatest(1, len(w) - {licenses.WORDS - 1}))) as i from words where len(w) > 0)),
sizes as (select license, count(*) as n, count(distinct s) as d from shingles where side = 't' group by 1),
hits as (select distinct x.id, y.license, x.i, x.s from shingles x join shingles y on x.side = 'd' and y.side = 't' and x.s = y.s),
windows as (
    select a.id, a.license, a.i, count(distinct b.s) as c from hits a join sizes z on z.license = a.license
    join hits b on b.id = a.id and b.license = a.license and b.i between a.i and a.i + z.n - 1 group by 1, 2, 3),
best as (select id, license, max(c) as c, arg_max(i, c * 1000000000 - i) as i from windows group by 1, 2)
select b.id as doc_id, b.license, cast(b.c as double) / z.d as containment, cast(b.i as bigint) as start_word, cast(z.n as bigint) as n_shingles
from best b join sizes z on z.license = b.license where cast(b.c as double) / z.d >= 0.8""",
    "op2_near_dup": r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (
    select distinct doc_id, array_to_string(w[i:i+3], ' ') as g
    from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from pairs join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as id, doc_id as c from documents union select e.b, r.c from reach r join edges e on e.a = r.id)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(r.c) as component_id, d.doc_id = min(r.c) as kept
from documents d join reach r on r.id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
}
