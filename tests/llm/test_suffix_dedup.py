"""Covered bytes by force with every branch: heavy copies, joins by shuffling, text ids, hash collisions."""

import hashlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sparksift.llm import suffix_dedup as sd

RNG = np.random.default_rng(41)


def corpus():
    word = lambda n: " ".join(f"w{x}" for x in RNG.integers(0, 100_000, n))
    passage, texts = word(20), []
    for i in range(30):
        texts.append(f"{word(int(RNG.integers(0, 30)))} {passage[: int(RNG.integers(40, 120))]} {word(5)}" + ("é" * 60 if i % 5 == 0 else ""))
    texts += texts[:3] * 4 + ["", None, "short", passage, "z" * 400, "z" * 49, "é" * 25]
    return [(int(i), t) for i, t in zip(RNG.permutation(len(texts)), texts, strict=True)] + [(3, word(30)), (None, passage)]


def by_force(rows, n):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            if i is not None:
                first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if i is not None and first[b[k : k + n]] < i:
                gone[k : k + n] = True
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(np.pad(gone, 1).astype(int)) == 1).sum()), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("heavy, few, kind", [(100_000, 500_000, "long"), (2, 0, "int"), (2, 500_000, "string")])
def test_covered_by_force(spark, monkeypatch, heavy, few, kind):
    monkeypatch.setattr(sd, "HEAVY", heavy)
    monkeypatch.setattr(sd, "BROADCAST_KEYS", few)
    rows = corpus()
    if kind == "string":
        rows = [(i if i is None else f"d{i:04}", t) for i, t in rows]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], f"doc_id {kind}, text string, key int, id int")
    got = sd.deduplicate(docs, length=50, part_bytes=3000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == by_force(rows, 50)


def test_contexts_are_equal_by_their_bytes():
    mat = RNG.integers(0, 2, (200, 3)).astype(np.uint8)
    code, side = np.zeros(200, np.uint64), np.zeros(200, int)  # every hash collides
    order = np.arange(200)
    fresh = sd._differs(order, code, mat, side)
    assert fresh.tolist() == [True, *(mat[1:] != mat[:-1]).any(1).tolist()]
    assert sd._differs(order, code, mat * 0, np.arange(200)).all()


def test_empty(spark):
    assert sd.deduplicate(spark.createDataFrame([], "doc_id string, text string")).count() == 0


@pytest.mark.parametrize("array", [2, 7])
def test_hot_anchors_are_dealt_further(spark, array):
    line = "a common line that stands in every document, whatever comes before it or after; "
    rows = corpus() + [(1000 + i, " ".join(f"v{x}" for x in RNG.integers(0, 400, 9)) + line * int(RNG.integers(1, 3)) + "".join(RNG.choice(list("abc"), 30))) for i in range(60)]
    got = sd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), length=50, part_bytes=3000, array=array).collect()
    assert sorted((str(r.doc_id), r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == by_force(rows, 50)


def test_no_shard_holds_all_contexts_of_a_common_edge():
    n, hot = 3000, np.array([9], np.uint64)
    mat = RNG.integers(0, 256, (n, 84)).astype(np.uint8)
    mat[:, :50] = mat[0, :50]  # a line that ends with the anchor
    lo, hi = np.full(n, 34), np.full(n, 50)
    narrow, key, d, _, less, more = sd.dealt((mat, np.full(n, 9, np.uint64), np.arange(n), np.zeros(n, int), lo, hi), hot, 50)
    assert sorted(set(zip(d.tolist(), less.tolist(), more.tolist(), strict=True))) == sorted((i, 34 - a, b + 16) for i in range(n) for a, b in sd.ranges(34))
    distinct = {k: set() for k in key.tolist()}
    for k, m in zip(key.tolist(), narrow, strict=True):
        distinct[k].add(m.tobytes())
    assert max(map(len, distinct.values())) <= 256  # 3,000 before
    for a, b in sd.ranges(34):  # equal windows have equal keys
        at = (less == 34 - a) & (more == b + 16)
        for s in range(a, b + 1):
            same = {}
            for k, m in zip(key[at].tolist(), mat[d[at]], strict=True):
                assert same.setdefault(m[s : s + 50].tobytes(), k) == k


def test_messages_grow_as_the_input():
    assert sd.parts_of(100 << 20, 4 << 20) == 25
    few, many = sd.parts_of(4 << 30, 4 << 20), sd.parts_of(64 << 30, 4 << 20)
    assert many**2 <= 17 * few**2  # parts times shards; 256 times before


@pytest.mark.parametrize("batch", [1, 40, 24_000])
def test_batches_of_anchors_find_the_same(monkeypatch, batch):
    monkeypatch.setattr(sd, "BATCH", batch)
    rows = [(i, t) for i, t in corpus() if i is not None and t][:-1]
    ids = np.array([i for i, _ in rows])
    docs = pa.table({"id": ids, "text": [t for _, t in rows], "key": ids * 7, "copy": [False] * len(rows)})

    class Docs:
        def mapInArrow(self, run, _):
            return pa.Table.from_batches(list(run(iter(docs.to_batches()))))

    met = sd._meet(1, 24_000)(sd._sent(Docs(), 50, 1, 1))
    runs = sd._shard(50, 1, 24_000)(sd._context(50, 1, 1, SimpleNamespace(value=np.zeros(0, np.uint64)))(docs, met))
    got = sd._united(50)(docs, runs).to_pylist()
    force = dict((i, n) for i, _, n, *_ in by_force(rows, 50))
    assert {str(r["id"]): sum(s["end"] - s["start"] for s in r["spans"]) for r in got} == force


def test_the_first_key_takes_more_bytes_of_a_small_alphabet():
    text = RNG.choice(np.frombuffer(b"ab \xff\x00", np.uint8), 3000)
    order, rank = sd.suffix_array(text, 50)
    whole = [text[i : i + 50].tobytes() for i in range(len(text))]
    assert [whole[i] for i in order] == sorted(whole)
    assert all((rank[a] == rank[b]) == (whole[a] == whole[b]) for a, b in zip(order[1:], order[:-1], strict=True))
