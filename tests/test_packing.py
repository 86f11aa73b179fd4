"""Packing, chunks, rendering, settings."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparksift.operators import chunking, extract, packing
from sparksift.plans import config


def sections(*sizes):
    return [packing.Section(i, f"f{i}", "\n".join(["x" * 9] * n)) for i, n in enumerate(sizes)]


def test_request_order_stops():
    s = sections(2, 300, 2)
    found = packing.plans(s, [0, 1, 2], 200, 100)
    assert found["request-order"].full == [0] and found["smallest-first"].full == [0, 2]
    assert packing.choose_many(found).strategy == "smallest-first"
    assert packing.choose_intent(found, 0).strategy == "smallest-first"
    assert found["smallest-first"].partial is None or found["smallest-first"].partial.index == 1


@given(st.lists(st.integers(0, 60), max_size=8), st.integers(0, 600), st.integers(0, 60))
def test_never_over_budget(sizes, most_bytes, most_lines):
    for p in packing.plans(sections(*sizes), list(range(len(sizes)))[::-1], most_bytes, most_lines).values():
        assert p.used[0] <= most_bytes and p.used[1] <= most_lines


def test_packing_by_force(spark, tmp_path):
    """Frames of many ranges against a plain loop, and the queries over all rows of a table."""
    import random

    from sparksift.plans import catalogue

    rng = random.Random(3)
    for n, most_bytes, most_lines in ((0, 100, 10), (300, 2000, 90), (6000, 40_000, 300), (6000, 10**6, 500)):
        rows = [(i, rng.choice([0, 3, 20, 400]), rng.randint(0, 40)) for i in range(n)]
        frame = spark.createDataFrame(rows, "k long, bytes long, n_lines long").repartition(5)
        used, at = {}, (0, 0)
        for j, (i, b, m) in enumerate(rows):
            used[i] = at = at[0] + b + 2 * (j > 0), at[1] + m + (j > 0)
        assert {r.k: (r.used_bytes, r.used_lines) for r in packing.running(frame, "k").collect()} == used
        assert {r.k for r in packing.prefix(frame, "k", most_bytes, most_lines).collect()} == {i for i, u in used.items() if u[0] <= most_bytes and u[1] <= most_lines}
        taken, at = [], (0, 0)
        for i, b, m in sorted(rows, key=lambda r: (r[1], r[0])):
            after = at[0] + b + 2 * bool(taken), at[1] + m + bool(taken)
            if after[0] <= most_bytes and after[1] <= most_lines:
                taken.append(i)
                at = after
        assert {r.k for r in packing.skip(frame, ["bytes", "k"], "k", most_bytes, most_lines).collect()} == set(taken)
    same = spark.createDataFrame([(7, 0, 0)] * 5000, "k long, bytes long, n_lines long")
    assert packing.skip(same, ["bytes", "k"], "k", 51200, 2000).count() == 2001
    spark.range(500).selectExpr("id as doc_id", "repeat('x', cast(id % 7 as int)) as text").write.parquet(f"{tmp_path}/documents.parquet")
    assert [catalogue.QUERIES[q](spark, str(tmp_path)).count() for q in ("running_budget", "pack_prefix", "pack_skip")] == [500, 500, 500]


def test_whole_texts_are_compressed(spark, tmp_path):
    import hashlib

    from sparksift.plans import catalogue

    texts = ["short", "x" * 19_999, "y" * 20_000, "import os\n" + "z" * 300_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in catalogue.QUERIES["compress_snippet"](spark, str(tmp_path)).collect()}
    short = lambda t: t if len(t) <= 1000 else f"{t[:600]}\n...\n{t[-400:]}"
    assert got == {i: hashlib.md5(short(t.removeprefix("import os\n")).encode()).hexdigest() for i, t in enumerate(texts)}


def test_heredoc():
    out = packing.heredoc([(1, "a.ts", "one\ntwo")])
    word = packing.WORDS[0]
    assert out == f"@a.ts\n<<'{word}'\n1|one\n2|two\n{word}"
    assert packing.delimiter(1, word) == f"{word}_1" and packing.delimiter(99, "") == "FILE99"


@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_chunks_are_slices(text, size, overlap):
    out = chunking.by_characters(text, size, overlap, None, 0)
    assert out[-1][1] == len(text) and out[0][0] == 0
    for (a, b, _), (c, d, _) in zip(out, out[1:], strict=False):
        assert a < c <= b and b - a <= size


def test_chunk_boundaries():
    text = "a" * 30 + "\n\n" + "b" * 30
    assert chunking.by_characters(text, 40, 0, None, 0)[0] == (0, 32, False)
    assert chunking.by_characters("x" * 100, 40, 0, None, 0)[0] == (0, 40, True)
    assert len(chunking.by_characters("x" * 1000, 40, 0, 3, 0)) == 3


def test_symbol_chunks(spark):
    code = "const a = 1;\n" + "function f() {\n  return '}';\n}\n" + "class B {\n  m() {}\n}\n"
    assert [(k, n) for k, n, _, _ in chunking.spans(code)] == [("variable", "a"), ("function", "f"), ("class", "B")]
    assert chunking.spans("def f():\n    pass\n\nclass C:\n    pass\n", "python")[1][:2] == ("class", "C")
    files = spark.createDataFrame([("a.ts", code, "typescript"), ("b.ts", None, "typescript")], "path string, body string, lang string")
    rows = chunking.chunks(files, symbols=True, lang="lang", size=40).orderBy("path", "chunk_index").collect()
    assert "".join(r.text for r in rows if r.path == "a.ts").replace("\n", "") == code.replace("\n", "")
    assert rows[0].start_line == 1


def test_context(spark):
    body = "class A {\n  f() {\n    x;\n    y;\n  }\n}\nz"
    assert spark.createDataFrame([(body,)], "b string").select(extract.parents(F.col("b"), 3).alias("p")).first().p == [1, 2]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate("abcdefghij")], "file string, line int, text string")
    interest = spark.createDataFrame([("f", 3), ("f", 8)], "file string, line int")
    out = extract.context_lines(lines, interest, pad=1).orderBy("line").collect()
    assert [r.line for r in out] == [2, 3, 4, 7, 8, 9] and [r.line for r in out if r.gap] == [2, 7]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "sparksift.config.json").write_text('{"model": "m", "chunk_size": 100}')
    monkeypatch.setenv("SPARKSIFT_MODEL", "other")
    monkeypatch.setenv("SPARKSIFT_MAX_CHUNKS", "3")
    s = config.load(str(tmp_path / "a" / "b"))
    assert (s.model, s.chunk_size, s.max_chunks) == ("m", 100, 3)
    monkeypatch.setenv("SPARKSIFT_CHUNK_OVERLAP", "-1")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))
