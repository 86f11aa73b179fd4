"""More queries: operators on calls, definitions, paths and lines, over rows of the given tables that stand for them, and their SQL.

A document is a file ``src/<lang>/<source>/<doc_id>``. An order's first line is a function (its part) in a file (its
supplier); the order's other lines are calls of their parts from it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparksift.functions import text as T
from sparksift.operators import extract, graph, knowledge, symbols
from sparksift.plans.catalogue import _KG, _kg, query
from sparksift.session import table
from sparksift.sources import files as sources

_FILES = "files as (select doc_id, 'src/' || lang || '/' || source || '/' || doc_id as path, text as body from documents)"


def _files(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("/", F.lit("src"), "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body"))


# Paths
@query(f"with {_FILES} select doc_id, path = 'src/en' or starts_with(path, 'src/en/') as yes from files")
def paths_inside_root(spark, sf):
    """whether a path lies in a root."""
    return _files(spark, sf).select("doc_id", T.inside(F.col("path"), "src/en/").alias("yes"))


@query("select doc_id, 'a/' || source || '/x' || case when doc_id % 2 = 0 then '' else '/y' end as path from documents")
def paths_made_normal(spark, sf):
    """Paths without empty, dot and parent segments."""
    made = F.concat(F.lit("a/./"), F.col("lang"), F.lit("/../"), F.col("source"), F.lit("//x/"), F.when(F.col("doc_id") % 2 == 0, "z/..").otherwise("y/."))
    return table(spark, sf, "documents").select("doc_id", T.normal_path(made).alias("path"))


@query("select doc_id, ['README.md', 'docs/README.md', '.github/workflows/' || lang || '.yml', 'package.json', 'src/a.ts'][doc_id % 5 + 1] as path, doc_id % 5 in (0, 2, 3) as yes from documents")
def important_files(spark, sf):
    """Files of a root that say what it is, and workflows."""
    made = F.array(F.lit("README.md"), F.lit("docs/README.md"), F.concat(F.lit(".github/workflows/"), "lang", F.lit(".yml")), F.lit("package.json"), F.lit("src/a.ts"))
    path = F.get(made, (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), sources.important(path).alias("yes"))


@query(f"with {_FILES}, f as (select path from files where regexp_replace(path, '/?[^/]*$', '') = 'src/fr/src0'), n as (select count(*) as n from f) select path, cast(n as bigint) as count_before_cap, n > 20 as capped from f cross join n order by path limit 20")
def folder_listing(spark, sf):
    """The files directly in a folder, capped."""
    return sources.listing(_files(spark, sf).select("path"), "src/fr/src0")


@query(f"with {_FILES} select path from files where contains(lower(path), 'src2') or contains(lower(path), '/de/') order by path limit 500")
def files_naming(spark, sf):
    """Files whose path holds an identifier."""
    return sources.naming(_files(spark, sf).select("path"), ["SRC2", "/de/"])


@query(f"with {_FILES} select doc_id, md5(array_to_string(string_split(body, chr(10))[2:4], chr(10))) as digest from files")
def lines_from_offset(spark, sf):
    """Three lines from the second on."""
    return _files(spark, sf).select("doc_id", F.md5(sources.line_slice(F.col("body"), 2, 3)).alias("digest"))


@query(f"""with {_FILES}, asked as (select doc_id as index, case when doc_id % 10 = 3 then 'src/../' || doc_id when doc_id % 10 = 7 then 'src/none/' || doc_id else path end as path from files)
select a.index, a.path, case when doc_id is not null then md5(string_split(body, chr(10))[1]) end as digest, doc_id is not null as ok, case when a.index % 10 = 3 then 'unsafe path' when doc_id is null then 'not found' end as error from asked a left join files f on f.path = a.path""")
def read_many_files(spark, sf):
    """What is asked for, with the reason where it cannot be read."""
    files = _files(spark, sf)
    path = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("src/../"), "doc_id")).when(F.col("doc_id") % 10 == 7, F.concat(F.lit("src/none/"), "doc_id")).otherwise(F.col("path"))
    out = sources.read_many(files.select(F.col("doc_id").alias("index"), path.alias("path")), files, limit=1)
    return out.select("index", "path", F.md5("text").alias("digest"), "ok", "error")


# Symbols and definitions
@query("with tags as (select p_brand as name, p_size as file, p_partkey as line from part), f as (select * from tags where lower(name) = 'brand#13'), one as (select name from f order by file, line, name limit 1) select name, file, line from f where name = (select name from one)")
def symbol_folded(spark, sf):
    """a name in any case, where none is exactly so."""
    tags = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("file"), F.col("p_partkey").alias("line"))
    return symbols.exact_or_folded(tags, "bRAND#13").select("name", "file", "line")


@query("""with t as (select p_brand as name, 'src/' || (p_size % 5) || '/' || p_size as file, p_partkey as line from part where p_brand = 'Brand#13'),
s as (select *, case when file = 'src/1/6' then 100 when regexp_replace(file, '/?[^/]*$', '') = 'src/1' then 50 else 10 end as score from t)
select file, line, name, score, row_number() over (partition by name order by score desc, file, line) = 1 as best from s""")
def symbol_resolution(spark, sf):
    """M11, L-lookups: a name's definitions by their nearness to a file, the best marked."""
    tags = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit("src/"), F.col("p_size") % 5, F.lit("/"), "p_size").alias("file"), F.col("p_partkey").alias("line"), F.lit("def").alias("kind"))
    return symbols.resolve(tags, "Brand#13", "src/1/6").select("file", "line", "name", "score", "best")


@query("select distinct source as file, doc_id % 50 as start_line from documents where length(trim(substr(text, 1, cast(doc_id % 20 as int)))) >= 8")
def definitions_of_some_length(spark, sf):
    """definitions of eight characters or more, one for each place."""
    defs = table(spark, sf, "documents").select(F.col("source").alias("file"), (F.col("doc_id") % 50).alias("start_line"), F.expr("substring(text, 1, cast(doc_id % 20 as int))").alias("body"))
    return symbols.useful_definitions(defs).select("file", "start_line")


@query(f"with {_FILES} select doc_id, 'File: ' || path || ' > Class: C' || doc_id || case when doc_id % 3 = 0 then '' else ' > Function: f_' || doc_id end as header from files")
def chunk_headers(spark, sf):
    """A chunk's header, from what its body declares."""
    f = _files(spark, sf)
    body = F.concat(F.lit("export class C"), "doc_id", F.lit(" {}\n"), F.when(F.col("doc_id") % 3 == 0, "const x = 1").otherwise(F.concat(F.lit("async function f_"), "doc_id", F.lit("() {}"))))
    return f.select("doc_id", T.header(F.col("path"), body).alias("header"))


# Imports
@query(f"with {_FILES} select path, unnest(list_distinct([regexp_extract(path, '^src/([a-z]+)', 1), 'os', regexp_extract(path, '^src/[a-z]+/([^/]+)', 1) || '/x'])) as specifier from files")
def python_imports(spark, sf):
    """What a file imports."""
    f = _files(spark, sf)
    part = lambda n: F.get(F.split("path", "/"), F.lit(n))
    body = F.concat(F.lit("import os, "), part(1), F.lit("\nx = 'import no'\nfrom "), part(2), F.lit(".x import y, z\nfrom __future__ import annotations\nimport os\n"))
    return extract.imports(f.select("path", F.lit("python").alias("lang"), body.alias("body")))


@query("""with f as (select distinct 'src/' || lang || '/' || source || '.ts' as path, lang, source from documents), s as (select a.path, b.source from f a join f b on a.lang = b.lang)
select distinct s.path as src, f.path as dst from s join f on f.source = s.source and regexp_replace(f.path, '/[^/]*$', '') = regexp_replace(s.path, '/[^/]*$', '') where s.path <> f.path
union select path, 'src/en/src1.ts' from f where path <> 'src/en/src1.ts' and exists (select 1 from f where path = 'src/en/src1.ts')""")
def import_resolution(spark, sf):
    """Specifiers as files: beside the importer with a suffix added, or by an alias."""
    f = table(spark, sf, "documents").select(F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit(".ts")).alias("path"), "lang", "source").distinct()
    beside = f.select("path", "lang").join(f.select("lang", "source"), "lang").select("path", F.concat(F.lit("./"), "source").alias("specifier"))
    asked = beside.unionByName(f.select("path", F.lit("@en/src1").alias("specifier"))).unionByName(f.select("path", F.lit("./none").alias("specifier")))
    return extract.resolved_imports(asked, f.select("path"), [("@en", "src/en")]).distinct()


# Calls
_CALLS = """fn as (select l_partkey as name, l_suppkey as file, l_orderkey as line from lineitem where l_linenumber = 1),
calls as (select fn.file, fn.name as caller, l.l_partkey as callee, fn.line from lineitem l join fn on fn.line = l.l_orderkey where l.l_linenumber > 1),
firsts as (select name as callee, arg_min(file, file * 100000000000 + line) as target from fn group by 1),
resolved as (select calls.*, target from calls left join firsts on firsts.callee = calls.callee)"""


def _calls(spark, sf):
    line = table(spark, sf, "lineitem")
    functions = line.where("l_linenumber = 1").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"))
    other = line.where("l_linenumber > 1").select(F.col("l_partkey").alias("callee"), F.col("l_orderkey").alias("line"))
    return other.join(functions, "line").select("file", F.col("name").alias("caller"), "callee", "line"), functions


@query(f"with {_CALLS} select file, caller, callee, line, target, target is not null as resolved from resolved")
def call_edges(spark, sf):
    """Calls and the first function of the name that they call."""
    return graph.resolved_calls(*_calls(spark, sf)).select("file", "caller", "callee", "line", "target", "resolved")


@query(f"with {_CALLS}, r as (select * from resolved where target is not null and file <> target) select distinct target as file, 'calls' as edge_type from r where file in (1, 2) union select distinct file, 'called_by' from r where target in (1, 2)")
def call_neighbours(spark, sf):
    """Files that two files' functions call or are called from."""
    return graph.call_neighbours(*_calls(spark, sf), [1, 2])


@query(f"""with {_CALLS}, o as (select file, caller as name, string_agg(callee, ',' order by callee) as calls from (select distinct file, caller, callee from calls) group by 1, 2), i as (select callee as name, string_agg(caller, ',' order by caller) as called_by from (select distinct caller, callee from calls) group by 1)
select distinct fn.name, fn.file, coalesce(calls, '') as calls, coalesce(called_by, '') as called_by from fn left join o on o.file = fn.file and o.name = fn.name left join i on i.name = fn.name""")
def call_lists(spark, sf):
    """For each function the names that it calls, and its callers."""
    calls, functions = _calls(spark, sf)
    calls = calls.withColumn("caller", F.col("caller").cast("string")).withColumn("callee", F.col("callee").cast("string"))
    functions = functions.select(F.col("name").cast("string").alias("name"), "file").distinct()
    number = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda x: x.cast("long"))), lambda x: x.cast("string")), ",")
    return graph.call_lists(calls, functions).select(F.col("name").cast("long").alias("name"), "file", number(F.col("calls")).alias("calls"), number(F.col("called_by")).alias("called_by"))


@query("with recursive deps as (select distinct o_custkey as file, o_orderkey % 400 as depends_on from orders), up(file) as (select file from deps where depends_on = 7 union select d.file from up join deps d on d.depends_on = up.file) select cast(file as varchar) as file from up where file <> 7")
def dependents_of(spark, sf):
    """All that reach a file over dependencies, cycles or not."""
    deps = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("file"), (F.col("o_orderkey") % 400).cast("string").alias("depends_on")).distinct()
    return graph.dependents(deps, ["7"])


# Knowledge graph
@query(f"with {_KG}, h as (select *, case when lower(label) = 'customer#00000012' then 1 when contains(lower(label), 'customer#00000012') then 2 end as tier from nodes) select id, label from h where tier = (select min(tier) from h)")
def kg_by_label(spark, sf):
    """Nodes of a label, or of labels that contain it."""
    return knowledge.by_label(_kg(spark, sf)[0], "CUSTOMER#00000012").select("id", "label")


@query(f"with {_KG}, c as (select source_file, cast(coalesce(max(degree), 0) as bigint) as centrality from nodes left join deg on deg.id = nodes.id group by 1) select c_custkey as id, round(c_acctbal * (1 + least(coalesce(centrality, 0), 20) / 100.0), 6) as score from customer left join c on c.source_file = 'file' || (c_nationkey + c_custkey % 3)")
def kg_boosted(spark, sf):
    """Scores raised by a file's centrality, up to a fifth."""
    scored = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("file"), F.col("c_nationkey") + F.col("c_custkey") % 3).alias("file"), F.col("c_acctbal").cast("double").alias("score"))
    return knowledge.boosted(scored, knowledge.file_centrality(*_kg(spark, sf))).select("id", F.round("score", 6).alias("score"))


# Lines
@query(f"""with {_FILES}, lines as (select doc_id as file, i as line, string_split(body, chr(10))[i] as text from (select *, unnest(generate_series(1, len(string_split(body, chr(10))))) as i from files)),
near as (select distinct file, unnest(generate_series(greatest(line - 2, 1), line + 2)) as line from lines where length(text) % 11 = 0),
shown as (select l.* from lines l join near n on n.file = l.file and n.line = l.line)
select file, cast(line as int) as line, md5(substr(text, 1, 100)) as digest, coalesce(lag(line) over (partition by file order by line), 0) + 1 < line as gap from shown""")
def lines_in_context(spark, sf):
    """Lines near those of interest, and where some were left out."""
    lines = _files(spark, sf).select(F.col("doc_id").alias("file"), F.posexplode(F.split("body", "\n", -1)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")
    shown = extract.context_lines(lines, lines.where(F.length("text") % 11 == 0).select("file", "line"))
    return shown.select("file", "line", F.md5("text").alias("digest"), "gap")
