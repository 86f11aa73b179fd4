"""Text, path and identifier functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix to language.
LANGUAGES = {
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".c": "c", ".h": "c", ".cs": "c_sharp", ".clj": "clojure", ".cljs": "clojure", ".cljc": "clojure",
    ".lisp": "commonlisp", ".cl": "commonlisp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".css": "css", ".scss": "css", ".less": "css",
    ".d": "d", ".dart": "dart", ".el": "elisp", ".ex": "elixir", ".exs": "elixir", ".elm": "elm", ".f": "fortran", ".f90": "fortran", ".f95": "fortran",
    ".gleam": "gleam", ".go": "go", ".hs": "haskell", ".lhs": "haskell", ".tf": "hcl", ".hcl": "hcl", ".java": "java", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".jl": "julia", ".kt": "kotlin", ".kts": "kotlin", ".lua": "lua", ".m": "matlab", ".ml": "ocaml", ".mli": "ocaml_interface",
    ".php": "php", ".pony": "pony", ".properties": "properties", ".py": "python", ".pyi": "python", ".pyx": "python", ".ql": "ql", ".r": "r", ".rkt": "racket",
    ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".sol": "solidity", ".swift": "swift", ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript",
    ".rules": "udev", ".zig": "zig",
}

_BREAKS = ((r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z])([A-Z][a-z])", "$1 $2"), (r"([a-zA-Z])([0-9])", "$1 $2"), (r"([0-9])([a-zA-Z])", "$1 $2"))


def _parts(token: Column) -> Column:
    """An identifier's parts: at underscores, case changes and digits; capitals alone fall to letters."""
    spaced = F.regexp_replace(token, "_", " ")
    for pattern, by in _BREAKS:
        spaced = F.regexp_replace(spaced, pattern, by)
    words = F.filter(F.split(spaced, " +"), lambda w: w != "")
    letters = lambda w: F.when(w.rlike("^[A-Z][A-Z]+$"), F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))
    return F.transform(F.flatten(F.transform(words, letters)), lambda w: F.lower(w))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens in order: each identifier whole (unless among its parts), then its parts."""
    identifiers = F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9_]+"), lambda t: t != ""))

    def each(t: Column) -> Column:
        parts = _parts(t)
        whole = F.when(F.array_contains(parts, F.lower(t)), F.array().cast("array<string>")).otherwise(F.array(F.lower(t)))
        return F.when(t.rlike("^[A-Z]?[a-z]+$"), F.array(F.lower(t))).otherwise(F.concat(whole, parts))

    return F.array_distinct(F.flatten(F.transform(identifiers, each)))


def token_set(text: Column) -> Column:
    """``tokens`` in no particular order, faster: words at once, and parts of only those identifiers that have some."""
    body = F.coalesce(text, F.lit(""))
    identifiers = F.array_distinct(F.split(body, "[^a-zA-Z0-9_]+"))
    whole = F.split(F.translate(F.array_join(identifiers, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), " ")
    compound = F.filter(identifiers, lambda t: t.rlike("[a-z][A-Z]|[A-Z][A-Z]|[0-9][a-zA-Z]|[a-zA-Z][0-9]|_"))
    return F.array_remove(F.array_union(whole, F.flatten(F.transform(compound, _parts))), "")


def query_tokens(query: str) -> list[str]:
    """As ``tokens``, for a query string on the driver."""
    out: dict[str, None] = {}
    for t in re.split(r"[^a-zA-Z0-9_]+", query):
        spaced = t.replace("_", " ")
        for pattern, by in _BREAKS:
            spaced = re.sub(pattern, by.replace("$", "\\"), spaced)
        parts = [c.lower() for w in spaced.split() for c in (w if re.fullmatch("[A-Z][A-Z]+", w) else [w])]
        for p in ([] if not t or t.lower() in parts else [t.lower()]) + parts:
            out[p] = None
    return list(out)


def language(path: Column) -> Column:
    """Language by the last suffix, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def unsafe_path(path: Column) -> Column:
    """Empty, or with a parent segment."""
    return (F.trim(path) == "") | F.exists(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: s == "..")


def inside(path: Column, root: str) -> Column:
    """Whether a normal path lies in a root, by its segments."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def normal_path(path: Column) -> Column:
    """A path without empty, dot and resolvable parent segments."""

    def fold(acc: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != "..")
        return F.when(s.isin("", "."), acc).when(back, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def directory(path: Column) -> Column:
    """The part before the last slash, or nothing."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a segment, all else literal."""
    out, i = "", 0
    while i < len(glob):
        for mark, by in (("**/", "(?:.+/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(mark, i):
                out, i = out + by, i + len(mark)
                break
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def path_hash(path: Column) -> Column:
    """A path's six hexadecimal digits: hash * 33 + code over its characters, 32 bits."""
    chars = F.filter(F.split(path, ""), lambda c: c != "")
    code = F.aggregate(chars, F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    digits = F.hex(code)
    return F.substring(F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits), 1, 6)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def line_count(text: Column) -> Column:
    """Lines; none in an empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")


def compressed(text: Column, most: int = 1000) -> Column:
    """Without import lines and runs of blank lines; long texts keep three fifths from the head and two from the tail."""
    bare = F.regexp_replace(text, r"(?m)^[ \t]*(import|require|from)\b[^\n]*(\n|$)", "")
    bare = F.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))
    head, tail = int(most * 0.6), int(most * 0.4)
    cut = F.concat(F.substring(bare, 1, head), F.lit("\n...\n"), F.substring(bare, -tail, tail))
    return F.when(F.length(bare) > most, cut).otherwise(bare)


def header(path: Column, body: Column) -> Column:
    """``File: p > Class: C > Function: f`` for what the body declares first."""
    part = lambda label, pattern: F.when(F.regexp_extract(body, pattern, 1) != "", F.concat(F.lit(label), F.regexp_extract(body, pattern, 1)))
    return F.concat_ws(" > ", F.concat(F.lit("File: "), path), part("Class: ", r"\bclass\s+([A-Za-z_$][\w$]*)"), part("Function: ", r"\b(?:function|def|fn)\s+([A-Za-z_$][\w$]*)"))


def path_overlap(path: Column, query: list[str]) -> Column:
    """How many of the query's tokens a path has."""
    return F.size(F.array_intersect(tokens(path), F.array(*(F.lit(q) for q in query)).cast("array<string>")))
