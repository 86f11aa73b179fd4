"""Tags, definitions, calls and imports of source files: Python by its syntax tree, other languages by patterns (then inferred)."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparksift.functions import text as T
from sparksift.operators.chunking import spans

SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs")
_CALL = re.compile(r"(?<![\w$])(?:new\s+)?([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = frozenset("if for while switch return function catch new typeof await def class fn match elif and or not in".split())
_DEF = {"go": re.compile(r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), "rust": re.compile(r"(?m)^\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|type|mod)\s+([A-Za-z_]\w*)")}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _script_imports(body: Column) -> Column:
    """The module specifier is the string after ``from`` or ``import``, in a call of ``require`` or ``import``, or of a path reference."""
    return _all(body, r"""(?:\bfrom\s*|\bimport\s*|(?<![.\w])(?:require|import)\s*\(\s*|///\s*<reference\s+path\s*=\s*)['"]([^'"\n]+)['"]""")


def _go_imports(body: Column) -> Column:
    """Every string of an import declaration, which is one line or a list in parentheses."""
    declared = _all(body, r"(?m)^import\b\s*(\([^)]*\)|[^\n(]*)")
    return F.flatten(F.transform(declared, lambda d: _all(d, r'"([^"\n]+)"')))


def _rust_imports(body: Column) -> Column:
    """Paths of ``use``, ``extern crate`` and ``mod`` items, without what names the crate itself or all of a module, or the language's own crates."""
    paths = F.transform(_all(body, r"(?m)^(?:use|extern\s+crate|mod)\s+(\w[\w:*]*);"), lambda p: F.split(p, "::"))
    own = F.array(*(F.lit(w) for w in ("crate", "self", "super")))
    paths = F.transform(paths, lambda p: F.when(F.array_contains(own, F.get(p, F.lit(0))) & (F.size(p) > 1), F.slice(p, F.lit(2), F.size(p))).otherwise(p))
    paths = F.filter(paths, lambda p: ~F.get(p, F.lit(0)).isin("std", "core", "alloc"))
    return F.filter(F.transform(paths, lambda p: F.array_join(F.filter(p, lambda x: x != "*"), "/")), lambda p: p != "tests")


def _python_imports(body: Column) -> Column:
    """Modules of ``from x import`` and the packages of ``import x, y``, as paths; relative ones have no name of their own."""
    whole = _all(body, r"(?m)^from\s+([A-Za-z_][\w.]*)\s+import\b")
    listed = F.flatten(F.transform(_all(body, r"(?m)^import\s+([^\n#;]+)"), lambda names: F.split(names, ",")))
    packages = F.transform(listed, lambda n: F.regexp_extract(n, r"^\s*([A-Za-z]\w*|_(?!_)\w*)", 1))
    return F.filter(F.concat(F.transform(whole, lambda m: F.replace(m, F.lit("."), F.lit("/"))), packages), lambda m: m != "__future__")


def imports(files: DataFrame) -> DataFrame:
    """(path, specifier): distinct imports of files (path, lang, body), natively, by the language's import grammar."""
    lang, body = F.col("lang"), F.col("body")
    every = F.when(lang.isin("javascript", "typescript", "tsx"), _script_imports(body)).when(lang == "go", _go_imports(body)).when(lang == "rust", _rust_imports(body)).when(lang == "python", _python_imports(body))
    return files.select("path", F.explode(F.array_distinct(every)).alias("specifier")).where("specifier <> ''")


def resolved_imports(specifiers: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """(src, dst) of imports that name a known file: as it is, with a suffix, as a folder's index; the first that exists wins.

    Candidates are exploded with their place and joined with the files, so no file list goes to the driver.
    """
    spec, here = F.col("specifier"), T.directory(F.col("path"))
    plain = F.when(spec.startswith("/"), F.substring(spec, 2, 1 << 20)).otherwise(F.concat_ws("/", F.when(here != "", here), spec))
    bases = [F.when(~spec.startswith(".") & spec.startswith(prefix + "/"), F.concat(F.lit(target + "/"), F.substring(spec, len(prefix) + 2, 1 << 20))) for prefix, target in aliases or []]
    base = F.transform(F.array_compact(F.array(*bases, plain)), T.normal_path)
    tails = F.array(F.lit(""), *(F.lit(s) for s in SUFFIXES), *(F.lit(f"/index{s}") for s in SUFFIXES))
    each = specifiers.select(F.col("path").alias("src"), "specifier", F.posexplode(F.flatten(F.transform(base, lambda b: F.transform(tails, lambda t: F.concat(b, t))))).alias("place", "dst"))
    found = each.join(files.select(F.col("path").alias("dst")).distinct(), "dst").groupBy("src", "specifier").agg(F.min_by("dst", "place").alias("dst"))
    return found.where("src <> dst").select("src", "dst")


def _python_tags(body: str) -> list[tuple[str, str, str, int]]:
    out = []
    for n in ast.walk(ast.parse(body)):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append((n.name, "def", "class" if isinstance(n, ast.ClassDef) else "function", n.lineno))
        elif isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.append((name, "ref", "call", n.lineno))
    return out


def tags_of(body: str, lang: str | None) -> list[tuple[str, str, str, int, str]]:
    """(name, kind, symbol_kind, line, confidence); every name that is defined here also gets its first mention as a reference."""
    try:
        found = [(*t, "extracted") for t in _python_tags(body)] if lang == "python" else None
    except (SyntaxError, ValueError):
        found = None
    if found is None:
        at = lambda i: body.count("\n", 0, i) + 1
        defs = [(m[1], "def", "function", at(m.start(1)), "inferred") for m in _DEF[lang].finditer(body)] if lang in _DEF else [(n, "def", k, at(s) + (body[s] == "\n"), "inferred") for k, n, s, _ in spans(body)]
        methods = [(m[1], "def", "method", at(m.start(1)), "inferred") for m in re.finditer(r"(?m)^\s+(?:async\s+|static\s+|public\s+|private\s+)*([A-Za-z_$][\w$]*)\s*\([^()\n]*\)\s*(?::[^{\n]+)?\{", body) if m[1] not in _NOT_CALLS] if lang not in _DEF else []
        lines = {(d[0], d[3]) for d in (*defs, *methods)}
        calls = [(m[1], "ref", "call", at(m.start(1)), "inferred") for m in _CALL.finditer(body) if m[1] not in _NOT_CALLS]
        found = [*defs, *methods, *(c for c in calls if (c[0], c[3]) not in lines)]
    mentioned = {}
    for name in {t[0] for t in found if t[1] == "def" and len(t[0]) >= 2}:
        if m := re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])", body):
            mentioned[name] = body.count("\n", 0, m.start()) + 1
    backfill = [(n, "ref", "mention", line, "inferred") for n, line in mentioned.items()]
    out: dict[tuple, tuple] = {}
    for t in (*found, *backfill):
        out.setdefault((t[3], t[0], t[1]), t)
    return sorted(out.values(), key=lambda t: (t[3], t[0], t[1]))


def calls_of(body: str, lang: str | None) -> list[tuple[str, str, int]]:
    """(caller, callee, line) of calls within functions, once for each pair; calls outside any function are left out."""
    out: dict[tuple[str, str], int] = {}
    if lang == "python":
        try:
            tree = ast.parse(body)
        except (SyntaxError, ValueError):
            return []

        def walk(node: ast.AST, inside: str | None) -> None:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                inside = node.name
            elif isinstance(node, ast.Call) and inside:
                f = node.func
                if name := f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None:
                    out.setdefault((inside, name), node.lineno)
            for child in ast.iter_child_nodes(node):
                walk(child, inside)

        walk(tree, None)
    else:
        heads = re.compile(r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:pub\s+)?(?:async\s+)?(?:function|func|fn)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)|^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>")
        from sparksift.operators.chunking import closing_brace

        for m in heads.finditer(body):
            end = closing_brace(body, m.end()) or len(body)
            inside = m[1] or m[2]
            for c in _CALL.finditer(body, m.end(), end):
                if c[1] not in _NOT_CALLS:
                    out.setdefault((inside, c[1]), body.count("\n", 0, c.start(1)) + 1)
    return [(a, b, line) for (a, b), line in out.items()]


def definitions_of(body: str, lang: str | None) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, start_line, end_line, text) of the outermost definitions."""
    at = lambda i: body.count("\n", 0, i) + 1
    return [(n, k, at(s), at(max(s, e - 1)), body[s:e].strip("\n")) for k, n, s, e in spans(body, lang)]


def _exploded(files: DataFrame, f: Callable, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *x) for p, body, lang in zip(*(b.column(c).to_pylist() for c in ("path", "body", "lang")), strict=True) for x in f(body or "", lang)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *kinds], strict=True)], names=["file", *names])

    return files.select("path", "body", "lang").mapInArrow(run, f"file string, {schema}")


def tags(files: DataFrame) -> DataFrame:
    """(file, name, kind, symbol_kind, line, confidence) of files (path, body, lang)."""
    return _exploded(files, tags_of, ["name", "kind", "symbol_kind", "line", "confidence"], [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()], "name string, kind string, symbol_kind string, line int, confidence string")


def calls(files: DataFrame) -> DataFrame:
    """(file, caller, callee, line)."""
    return _exploded(files, calls_of, ["caller", "callee", "line"], [pa.string(), pa.string(), pa.int32()], "caller string, callee string, line int")


def definitions(files: DataFrame) -> DataFrame:
    """(file, name, kind, start_line, end_line, body)."""
    return _exploded(files, definitions_of, ["name", "kind", "start_line", "end_line", "body"], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()], "name string, kind string, start_line int, end_line int, body string")


def functions(tagged: DataFrame) -> DataFrame:
    """(name, file, line): the functions among tags."""
    return tagged.where("kind = 'def' and symbol_kind in ('function', 'method', 'variable')").select("name", "file", "line")


def parents(body: Column, line: int) -> Column:
    """The numbers of the lines that enclose a line by indentation, from the outermost: before it, each with less indentation than what follows."""
    lines = F.slice(F.split(body, "\n", -1), 1, line)
    indent = lambda s: F.length(s) - F.length(F.ltrim(s))
    rows = F.reverse(F.transform(lines, lambda s, i: F.struct((i + 1).alias("n"), indent(s).alias("d"), (F.trim(s) == "").alias("blank"))))
    start = F.struct(F.get(rows, F.lit(0))["d"].alias("d"), F.array().cast("array<int>").alias("found"))
    step = lambda acc, r: F.when(~r["blank"] & (r["d"] < acc["d"]), F.struct(r["d"].alias("d"), F.concat(F.array(r["n"]), acc["found"]).alias("found"))).otherwise(acc)
    return F.aggregate(rows, start, step)["found"]


def context_lines(lines: DataFrame, interest: DataFrame, pad: int = 2, width: int = 100) -> DataFrame:
    """(file, line, text, gap): lines (file, line, text) within ``pad`` of lines of interest (file, line), cut to a width; ``gap`` where lines were left out before."""
    near = interest.select("file", F.explode(F.sequence(F.greatest(F.col("line") - pad, F.lit(1)), F.col("line") + pad)).alias("line")).distinct()
    shown = lines.join(near, ["file", "line"])
    before = F.lag("line").over(Window.partitionBy("file").orderBy("line"))
    return shown.select("file", "line", F.substring("text", 1, width).alias("text"), (F.coalesce(before, F.lit(0)) + 1 < F.col("line")).alias("gap"))
