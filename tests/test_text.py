"""Tokens, paths and small text functions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparksift.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


CASES = {
    "snake_case": ["snake_case", "snake", "case"],
    ",,,,": [],
    "  spaces  ": ["spaces"],
    "auth": ["auth"],
    "API": ["api", "a", "p", "i"],
    "getUserById": ["getuserbyid", "get", "user", "by", "id"],
}


@pytest.mark.parametrize("text", CASES)
def test_tokens(spark, text):
    assert one(spark, text, T.tokens) == CASES[text] == T.query_tokens(text)


def test_token_members(spark):
    assert {"oauthapi", "o", "auth", "a", "p", "i"} <= set(one(spark, "OAuthAPI", T.tokens))
    assert {"v", "2"} <= set(one(spark, "userV2", T.tokens))


@given(st.text(alphabet="aBcDEf12_ é-", max_size=20))
def test_query_tokens_are_distinct(text):
    out = T.query_tokens(text)
    assert len(out) == len(set(out)) and all(t == t.lower() for t in out)


def test_token_set_has_the_tokens(spark):
    words = ["HTTPServer2 foo_bar", "", "Éaux theInor API x1y2Z", "a__b _x 9lives", None]
    rows = spark.createDataFrame([(w,) for w in words], "x string").select("x", T.tokens(F.col("x")).alias("a"), T.token_set(F.col("x")).alias("b")).collect()
    for r in rows:
        assert sorted(r.a) == sorted(r.b) == sorted(T.query_tokens(r.x or ""))


def test_paths(spark):
    assert one(spark, "src/a.test.TS", T.language) == "typescript"
    assert one(spark, "Makefile", T.language) is None
    assert one(spark, "a/../b", T.unsafe_path) and one(spark, " ", T.unsafe_path) and not one(spark, "a/b..c", T.unsafe_path)
    assert one(spark, "a/./b/../../c//d", T.normal_path) == "c/d"
    assert one(spark, "../x", T.normal_path) == "../x"
    assert one(spark, "a/b/c.ts", T.directory) == "a/b" and one(spark, "c.ts", T.directory) == ""
    assert one(spark, "a/b", lambda p: T.inside(p, "a")) and not one(spark, "ab", lambda p: T.inside(p, "a"))


def test_measures(spark):
    assert one(spark, "", T.line_count) == 0 and one(spark, "a\nb\n", T.line_count) == 3
    assert one(spark, "é", T.byte_count) == 2 and one(spark, "abcde", T.token_estimate) == 2
    h = 5381
    for c in "src/auth.ts":
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    assert one(spark, "src/auth.ts", T.path_hash) == f"{h:X}".rjust(6, "0")[:6]


def test_snippets(spark):
    body = "import x from 'y'\nclass A {}\n\n\n\nfunction f() {}"
    assert one(spark, body, T.compressed) == "class A {}\n\nfunction f() {}"
    assert len(one(spark, "z" * 5000, T.compressed)) == 1005
    assert one(spark, body, lambda b: T.header(F.lit("a.ts"), b)) == "File: a.ts > Class: A > Function: f"
