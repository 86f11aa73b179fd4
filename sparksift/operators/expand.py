"""Candidate expansion, query probes and hypothetical documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksift.functions import text as T
from sparksift.operators.graph import first_each

# Words of a query that name no symbol.
PROBE_STOP = frozenset("""the this that these those with from file code function class method value data type what where how which find show get set list all any has not and for are
can use using used implement implementation define definition reference call called calling return returns handle handler process config configuration setting options param params
argument arguments module package library util utility helper base main app application server client route routes middleware api endpoint service provider factory manager controller
model view page pages component element node tree graph edge path name key map array object string number bool boolean int integer float double void null undefined true false promise
async await try catch throw new delete create update remove insert select search query filter sort group count sum avg min max total index primary foreign unique constraint schema
table column row field property attribute variable constant expression statement block scope context environment session cache store queue stack heap pool thread worker task job event
message signal hook callback listener observer publish subscribe emit broadcast notify trigger action reducer dispatch state effect side pure memo selector resolver saga thunk plugin
addon extension integration interface contract protocol adapter bridge proxy decorator mixin trait""".split())
HYDE_STOP = frozenset("""the this that these those with from file code function class method value data type what where how which find show get set list all any has not and for are can
use using used implement a an in on at to of is it by as or be do if was were been being have had having would could should might must shall will may need want like about into through
during before after above below between each few more most other some such no nor too very just because so than also back even still already well here there when while why who whom
whose whether however then once again further both either neither every much own same different new old first last next previous only over its our your their his her my handle handler
process config configuration setting options param params argument arguments module package library util utility helper base main app application server client route routes middleware
api endpoint service provider factory manager controller model view page component element node tree graph edge path name key map array object string number bool boolean int integer
float double void null undefined true false promise async await try catch throw delete create update remove insert select search query filter sort group return call called calling""".split())


def phased(phases: list[DataFrame], cap: int = 20, key: str = "file") -> DataFrame:
    """(key, phase) of frames (key, ord): the first phase of each, by phase, order and key, ``cap`` in all."""
    every = None
    for i, p in enumerate(phases):
        one = p.select(key, F.lit(i).alias("phase"), F.col("ord"))
        every = one if every is None else every.unionByName(one)
    return first_each(every, [key], "phase", "ord").orderBy("phase", "ord", key).limit(cap).select(key, "phase")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``equal``: whether two sets of rows are the same."""
    left, right = a.withColumn("__l", F.lit(1)), b.withColumn("__r", F.lit(1))
    both = left.distinct().join(right.distinct(), a.columns, "full")
    return both.agg((F.count_if(F.col("__l").isNull() | F.col("__r").isNull()) == 0).alias("equal"))


def probe_identifiers(query: str) -> list[str]:
    """Tokens of a query that may name symbols."""
    keep = lambda t: len(t) >= 2 and t not in PROBE_STOP and not t.isdigit() and not (not t[0].isalpha() and len(t) <= 2)
    return [t for t in T.query_tokens(query) if keep(t)]


def probe(tags: DataFrame, query: str, slots: int = 4, folded: bool = True) -> DataFrame:
    """(file, symbol): at most four files with tags named by a query's identifiers; ``folded``: in any case."""
    idents = probe_identifiers(query)
    name = F.lower("name") if folded else F.col("name")
    hits = tags.where(name.isin(idents) if idents else F.lit(False))
    place = F.array_position(F.array(*(F.lit(i) for i in idents or [""])), name)
    return first_each(hits.withColumn("ord", place), ["file"], "ord", "line").orderBy("ord", "file").limit(min(4, slots)).select("file", F.col("name").alias("symbol"))


def query_identifiers(query: str) -> list[str]:
    return [t for t in T.query_tokens(query) if len(t) >= 3 and t not in HYDE_STOP and not t.isdigit()]


def query_pattern(query: str) -> str:
    """class, config, module or function, by the query's words."""
    q = query.lower()
    for pattern, words in (("class", "class|type|interface|struct"), ("config", "config|setting|option|env"), ("module", "module|package|library|import")):
        if re.search(rf"\b(?:{words})\b", q):
            return pattern
    return "function"


def _pascal(s: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in s.split("_"))


def _camel(s: str) -> str:
    p = _pascal(s)
    return p[:1].lower() + p[1:]


def hypothetical(query: str) -> tuple[str, bool]:
    """Code that a query might be about, to be embedded in its place, and whether there is any; else the query itself."""
    names = query_identifiers(query)
    if not names:
        return query, False
    first, rest, kind = names[0], names[1:4], query_pattern(query)
    if kind == "class":
        body = [f"class {_pascal(first)} {{", *(f"  {_camel(n)}: {_pascal(n)};" for n in rest), f"  constructor({', '.join(names)}) {{}}", *(f"  get{_pascal(n)}() {{ return this.{_camel(n)}; }}" for n in rest), "}"]
    elif kind == "config":
        body = [f"// Configuration for {', '.join(names)}", f"export const {first}Config = {{", *(f"  {n}: undefined," for n in rest), "};", f"export function validate{_pascal(first)}(config) {{ return config; }}"]
    elif kind == "module":
        body = [f"// Module: {first}", *(f"import {{ {_pascal(n)} }} from './{n}';" for n in rest), f"export class {_pascal(first)}Module {{", "  init() {}", "}"]
    else:
        body = [f"// {query}", f"export function {_camel(first)}({', '.join(rest)}) {{", *(f"  const {_camel(n)} = {_camel(n)}Process();" for n in rest), f"  return {_camel(rest[0]) if rest else 'result'};", "}"]
    return "\n".join(body), True
