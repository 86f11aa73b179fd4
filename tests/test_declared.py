"""Declarations and imports by language, from the keyword table and the import grammars."""

import re

import pytest

from sparksift.functions import declared
from sparksift.operators import chunking, extract, symbols

FILES = [
    ("a.ts", "typescript", "import a from './a'\nimport {b} from \"b\";\nimport './side';\nexport {c} from 'c';\nconst d = require('d');\nconst e = await import('e');\n/// <reference path='f.d.ts' />\nobj.require('no'); Array.from('x')"),
    ("m.go", "go", 'package m\nimport "fmt"\nimport (\n "os"\n x "net/http"\n)\nvar s = "nope"\n'),
    ("l.rs", "rust", "use crate::a::b;\nuse std::io;\nextern crate foo;\nmod bar;\nmod tests;\nuse self::z::*;\n"),
    ("p.py", "python", "import os.path, sys\nfrom a.b import c\nfrom . import x\nfrom __future__ import y\nimport __main__\nimport _priv as q\n"),
    ("x.txt", None, "import nothing from 'x'"),
    ("n.ts", "typescript", None),
]


def test_imports_by_language(spark):
    got = {}
    for r in extract.imports(spark.createDataFrame(FILES, "path string, lang string, body string")).collect():
        got.setdefault(r.path, set()).add(r.specifier)
    assert got == {"a.ts": {"./a", "b", "./side", "c", "d", "e", "f.d.ts"}, "m.go": {"fmt", "os", "net/http"}, "l.rs": {"a/b", "foo", "bar", "z"}, "p.py": {"a/b", "os", "sys", "_priv"}}


@pytest.mark.parametrize("line, name", [("  export default async function go(x)", "go"), ("EXPORT CLASS Foo {", "Foo"), ("export async class Foo", None), ("const $a = 1", "$a"), ("  def run(self):", "run"), ("fn main() {", "main"), ("module M", "M"), ("export def x", None), ("functions x", None), ("type T", "T"), ("enum", None)])
def test_line_declarations(line, name):
    m = re.match(declared.line_pattern(), line)
    assert (m[1] if m else None) == name


def test_lines_with_a_declaration(spark):
    body = "function userLogin() {\n  return user(login);\n}\nconst other = userLogin;\nclass LoginUser {}\n"
    rows = symbols.search_lines(spark.createDataFrame([("f.ts", body)], "path string, body string"), "login").collect()
    assert [(r.kind, r.line, r.name) for r in rows] == [("def", 1, "userLogin"), ("def", 5, "LoginUser"), ("ref", 2, "login"), ("ref", 4, "userLogin")]
    only = symbols.search_lines(spark.createDataFrame([("f.ts", body)], "path string, body string"), "login", refs=False)
    assert [r.line for r in only.collect()] == [1, 5]


def test_top_level_spans():
    text = "export async function a(x) { return 1 }\nasync function b() {}\nexport class C {}\ntype T = 1;\ntype U\nconst z = 3;\nasync class D {}\nexport default function q() {}\nlet y;\n  class Inner {}\n"
    assert [(k, n) for k, n, *_ in chunking.spans(text)] == [("function", "a"), ("function", "b"), ("class", "C"), ("type_alias", "T"), ("variable", "z")]
