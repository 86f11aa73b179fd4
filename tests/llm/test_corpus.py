"""The corpus operators against plain computations, and on nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparksift.llm import decontaminate, html_text, licenses, near_dup, neighbours, packing, pitman_yor, quality, queries, secrets, suffix_dedup

RNG = np.random.default_rng(3)
SYLLABLES = "the on er an tion ing re at en or es nd ha ti ed is it st".split()


@pytest.fixture(autouse=True)
def seeded():
    """Each test's prose is its own, whichever run."""
    global RNG
    RNG = np.random.default_rng(17)


def prose(n):
    return " ".join("".join(RNG.choice(SYLLABLES, RNG.integers(1, 4))) for _ in range(n))


#: As documents, with all the odd cases and columns whose names clash with what operators use inside.
BASE = prose(120)
TEXTS = [BASE, BASE, BASE.replace(BASE.split()[60], "changed", 1), None, "", " \t\n", prose(3), prose(90) + "\n" + BASE[:300], "x" * 30_000, prose(3000), "É " + BASE[:200] + " é", BASE]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id string, n long, label int, bucket int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", "src0", None if t is None else len(t), 1, "id", 2, 3, 4, 0.5) for i, t in enumerate(TEXTS)]
    rows += [(1, BASE, "en", None, 5, 1, "id", 2, 3, 4, 0.5), (None, BASE, "en", "s", 5, 1, None, 2, 3, 4, 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


# 1
def test_secrets_places(spark):
    key = "0123456789abcdef" * 2
    text = f"é token = \"{key}\" x\nAKIA{'A1' * 10} password:short Secret=abcdef {'Zz9Qa7Lm2Xc4Vb8Nw1Ke'}{'Rt6Yu3Io'}"
    r = secrets.scan(spark.createDataFrame([(0, text), (1, None), (2, ""), (3, "AKIA token=abc 0123")], "doc_id int, text string")).collect()
    spans = {(s.kind, text[s.start : s["end"]]) for s in r[0].secrets}
    assert {("assign", f'token = "{key}'), ("hex", key), ("access", "AKIA" + "A1" * 10), ("assign", "Secret=abcdef")} <= spans
    assert any(k == "base64_entropy" for k, _ in spans) and not any("short" in v for _, v in spans)
    assert [list(x.secrets) for x in r[1:]] == [[], [], []]


def test_secret_entropy_is_the_windows(spark):
    run = "".join(RNG.choice(list("abcdef0123456789"), 60))
    best = max(-sum(c / 24 * math.log2(c / 24) for c in Counter(run[i : i + 24]).values()) for i in range(len(run) - 23))
    got = spark.createDataFrame([(run,)], "v string").select(F.expr(secrets._most_entropy("v", 24)).alias("h")).first().h
    assert got == pytest.approx(best, abs=1e-8)


def test_secrets_redacted(spark):
    t = 'a token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" b'
    r = secrets.redacted(spark.createDataFrame([(t, 1), (None, 2), ("clean text", 3)], "text string, at int")).orderBy("at").collect()
    assert [x.text for x in r] == ['a [SECRET]" b', None, "clean text"]


# 2
def components_by_force(rows, n):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(t)) else frozenset() for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    links = [(rows[a][0], rows[b][0]) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, sets


def test_near_dup_by_force(spark, docs):
    near = [(100 + i, " ".join(w if j % (9 + i) else "zz" for j, w in enumerate(BASE.split()))) for i in range(12)]
    extra = spark.createDataFrame(near, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    rows = [tuple(r) for r in both.collect()]
    label, sets = components_by_force(rows, 4)
    got = near_dup.groups(both, words=4).collect()
    assert len(got) == len(rows)
    sizes = {}
    for (i, _), s in zip(rows, sets, strict=True):
        sizes.setdefault(i, set()).add(len(s))
    for r in got:
        assert r.n_shingles in sizes[r.doc_id] and r.component_id == label.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_posterior_bounds():
    steps = near_dup.minimum_matches(0.8, 1e-6)
    assert all(a[1] <= a[0] for a in steps) and steps[-1] == (1024, pytest.approx(758, abs=8))
    same = np.ones((1, 1024), np.uint8)
    assert len(near_dup._posterior(same, same, steps)) == 1 and len(near_dup._posterior(same, same * 0, steps)) == 0


# 3
def cover_by_force(rows, n):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            if i is not None:
                first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if i is not None and first[b[k : k + n]] < i:
                gone[k : k + n] = True
        out.append((i, len(b), int(gone.sum()), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("array", [24_000, 3])
def test_suffix_dedup_by_force(docs, array):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_dedup.deduplicate(docs, length=50, array=array, part_bytes=20_000).collect()
    found = sorted([(r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got], key=str)
    assert found == cover_by_force(rows, 50)


def test_suffix_arrays():
    for trial in range(30):
        t = RNG.integers(97, 97 + RNG.integers(1, 4), RNG.integers(1, 60)).astype(np.uint8) * (trial % 3 > 0)
        b = t.astype(np.uint8).tobytes()
        order, rank = suffix_dedup.suffix_array(t.astype(np.uint8), 8)
        assert [b[i : i + 8] for i in order] == sorted(b[i : i + 8] for i in range(len(b)))
        full, _ = suffix_dedup.suffix_array(t.astype(np.uint8), len(b))
        for k, n in enumerate(suffix_dedup.common_prefixes(t.astype(np.uint8), full, 50)[1:], 1):
            x, y = b[full[k - 1] :], b[full[k] :]
            assert n == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y), 50)) or n == 50


# 4
def test_neighbours_recall(spark):
    x = RNG.standard_normal((2500, 16))
    x[7], x[9], x[11] = x[40], x[40], x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0]), (9080, [None] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, shard=1000).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 2500, 20))
    hit = 0
    for q, found in by.items():
        s = np.round(x @ x[q], 12)
        s[q] = -np.inf
        want = np.lexsort((np.arange(2500), -s))[:20]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(abs(r.score - x[r.vec_id] @ x[q]) < 1e-9 for r in found)
        hit += len(set(want.tolist()) & {r.vec_id for r in found})
    assert hit / (20 * len(by)) >= 0.9
    assert {7, 9, 11} <= {r.vec_id for r in by[40]}


def test_neighbours_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in neighbours.nearest(few, lambda i: i % 20 == 0).collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(few.limit(0), lambda i: i % 20 == 0).count() == 0


# 5
def test_pitman_yor_base(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    count = Counter(w for i, t in rows if train(i) for w in [*words(t), b"\0"])
    n, v = sum(count.values()), len(count)
    got = pitman_yor.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, bucket_bytes=20_000).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), b"\0"]), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), b"\0"]), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and r.held_out == (not train(r.doc_id)) for r in got)


# 6
def test_licenses(spark):
    body = dict(licenses.TEMPLATES)["Apache-2.0-text"]
    texts = ["a b c Released under the MIT License. d", body, body.replace("software", "x", 1), " ".join(body.split()[:9]), None, "", "x " * 500 + "Licensed under CC BY-NC 4.0."]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got[0, "MIT"] == got[1, "Apache-2.0-text"] == got[6, "CC-BY-NC-4.0"] == 1
    assert 0.8 <= got[2, "Apache-2.0-text"] < 1 and not any(i in (3, 4, 5) for i, _ in got)


# 7
def test_main_text():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One\n  two.<br><p>Three &eacute;.</p><script>var x='</p>';</script><p>Ok.</p><div class='comments'><p>First!</p></div></article><footer>&copy; me</footer>"
    assert html_text.main_text(page) == "A & B\nOne two.\nThree é.\nOk."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain words") == "plain words"
    nested = "<body><div class='sidebar'>s</div><div id='c'>" + "".join(f"<div><p>{prose(20)}</p></div>" for _ in range(5)) + "</div><div>tiny</div></body>"
    assert html_text.main_text(nested).count("\n") == 4


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (2, None, None, "t")], "page_id int, url string, html string, text string")
    assert sorted(tuple(r) for r in html_text.extract(pages, keep=["page_id", "url"]).collect()) == [(1, "u", "a"), (2, None, "")]


# 8
def test_quality(spark, docs, nothing):
    good, bad = [prose(60) for _ in range(60)], [" ".join(w + "%%%" for w in prose(40).split()) for _ in range(40)] + [" ".join([w] * 30) for w in prose(20).split()]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)]
    train = spark.createDataFrame(rows, "key long, text string, label int")
    model = quality.fit(train.where("key % 4 <> 0"))
    got = {r.key: r for r in quality.score(train, model).collect()}
    held = [k for k in got if k % 4 == 0]
    assert np.mean([(got[k].score >= 0.7) == (got[k].label == 1) for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model, keep=["doc_id"]).collect()) and quality.score(nothing, model).count() == 0
    assert {r.score for r in quality.score(docs.select("doc_id", "text"), quality.fit(train.limit(0))).collect()} == {0.5}


# 9
def test_bounds_are_optimal():
    for _ in range(20):
        hist = {int(k): int(c) for k, c in zip(RNG.choice(40, 7, replace=False), RNG.integers(1, 9, 7), strict=True)}
        pad = lambda edges: sum(c * (min(e for e in edges if e >= n) - n) for n, c in hist.items())
        best = min(pad([*some, max(hist)]) for some in combinations(sorted(hist)[:-1], 2))
        assert pad(packing.bounds(list(hist.items()), 3)) == best


def test_packing(docs, nothing):
    out = packing.pack(docs, budget=200, share=4).collect()
    assert len(out) == docs.count() and packing.pack(nothing).count() == 0
    by = {}
    for r in out:
        assert r.n_tokens <= r.bucket_len and r.n_padding == r.bucket_len - r.n_tokens
        by.setdefault(r.batch_id, []).append(r)
    for rows in by.values():
        assert len({r.bucket for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) * rows[0].bucket_len <= 200 or len(rows) == 1 or rows[0].bucket_len == 0


# 10
def test_decontamination(spark, docs, nothing):
    item = prose(40)
    w = item.split()
    swapped = " ".join("OTHER" if i % 9 == 4 else x for i, x in enumerate(w))
    texts = [f"{prose(30)} {item.upper()}! {prose(10)}", f"{prose(9)} {swapped}", prose(200), " ".join(w[:8]), None, "", f"{item} {item}"]
    corpus = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, "tiny set of words here"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(corpus, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 1)} and got[0, 1].n_matched == 40 and 30 <= got[1, 1].n_matched < 40
    raw = texts[0].encode()[got[0, 1].start_byte : got[0, 1].end_byte].decode()
    assert raw == item.upper()
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(corpus, bench, block_bytes=30).collect()} == set(got)
    assert sorted(r.doc_id for r in decontaminate.clean(corpus, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.find(nothing, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_decontamination_by_force():
    """Whole items with words substituted anywhere: found if 13 words and 80 % are left; the told stretch is the one with the most matches."""
    assert decontaminate.sure_run(13, 0.8) == 4
    for _ in range(400):
        same = RNG.random(RNG.integers(1, 40)) < RNG.choice([0.3, 0.75, 0.9])
        every = [(int(same[i:j].sum()), i - j, -i) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and same[i:j].sum() >= 0.8 * (j - i) - 1e-9]
        m, n, i = max(every, default=(0, 0, 0))
        assert decontaminate.stretch(same, 0.8) == (-i, -i - n, m)
    for size, swaps in ((10, 0), (13, 0), (14, 1), (15, 1), (15, 2), (16, 2), (16, 3), (18, 3), (20, 3), (20, 4), (24, 4), (30, 6)):
        items = [" ".join(f"w{RNG.integers(10**9)}" for _ in range(size)) for _ in range(60)]
        seeds = decontaminate.Seeds(list(enumerate(items)), decontaminate._masks(13, 0.8))
        texts, left = [], []
        for item in items:
            w, gone = item.split(), RNG.choice(size, swaps, replace=False)
            for k in gone:
                w[k] = "other"
            kept = np.delete(np.arange(size), gone)
            left.append((size - swaps, int(kept[-1] - kept[0]) + 1))
            texts.append(f"{prose(20)} {' '.join(w)} {prose(20)}")
        body, at = decontaminate.raw(decontaminate.pa.array(texts))
        got = decontaminate.matches(body, at, seeds, 13, 0.8)
        assert [x[:4] for x in got] == [(i, i, *x) for i, x in enumerate(left)], (size, swaps)


# pipeline
def test_pipeline_stages(spark, tmp_path):
    item, key = prose(40), "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    base = prose(80)
    texts = [prose(60) for _ in range(40)] + [" ".join(x + "$$$" for x in prose(30).split()) for _ in range(30)]
    texts += [base, base, f"{prose(20)} {item}", f'{prose(30)} token = "{key}" {prose(4)}', None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == at.columns, name
        assert set(range(40)) <= {r.doc_id for r in after.collect()}, name
        at = spark.createDataFrame(after.collect(), at.schema)
    left = {r.doc_id: r for r in at.collect()}
    assert set(range(40)) <= set(left) and not set(range(40, 70)) & set(left) and 70 in left and 71 not in left and 72 not in left
    assert key not in left[73].text and "[SECRET]" in left[73].text and left[73].n_chars == len(left[73].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)


# all of them on an empty table and on odd rows
def test_empty_and_odd(spark, docs, nothing):
    assert near_dup.groups(nothing).count() == 0 and suffix_dedup.deduplicate(nothing).count() == 0
    assert pitman_yor.score(nothing, F.lit(True)).count() == 0
    assert licenses.scan(nothing).count() == 0 and secrets.scan(nothing).count() == 0
    assert licenses.scan(docs).count() == 0 and secrets.scan(docs).count() == docs.count()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 11)} and "pipeline" in names
    assert set(queries.ORACLE) <= names
