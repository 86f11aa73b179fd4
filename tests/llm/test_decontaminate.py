"""Passages against every alignment of every item, repeated words, blocks."""

import time

import numpy as np

from sparksift.llm import decontaminate as d


def best_by_force(text, item, min_words, min_share):
    """(matched, words, first word in the text) over all stretches of all alignments."""
    t, s = text.split(), item.split()
    need, best = min(min_words, len(s)), None
    for diagonal in range(-len(s) + 1, len(t)):
        lo, hi = max(0, -diagonal), min(len(s), len(t) - diagonal)
        same = [t[k + diagonal] == s[k] for k in range(lo, hi)]
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                m = sum(same[i:j])
                if same[i] and same[j - 1] and m >= need and m >= min_share * (j - i) - 1e-9:
                    one = (m, i - j, -(lo + i + diagonal))
                    best = max(best, one) if best else one
    return best and (best[0], -best[1], -best[2])


def found(texts, items, min_words=13, min_share=0.8):
    seeds = d.Seeds(list(enumerate(items)), d._masks(min_words, min_share))
    body, at = d.raw(d.pa.array(texts))
    starts = d.Tokens(body, at, d.PLAIN)
    first = lambda r, byte: int(np.searchsorted(starts.start, at[r] + byte)) - int(starts.first[r])
    return {(r, i): (m, n, first(r, b)) for r, i, m, n, b, _ in d.matches(body, at, seeds, min_words, min_share)}


def test_all_alignments_by_force():
    rng = np.random.default_rng(8)
    for trial in range(60):
        letters = list("abcdefghijkl"[: int(rng.integers(1, 13))])
        pick = lambda n: " ".join(rng.choice(letters, n))
        items = [pick(int(rng.integers(1, 30))) for _ in range(3)] + ["a b " * 12, "a " * 20]
        texts = [pick(int(rng.integers(0, 40))), "a " * 30, "a b " * 15, "a b c " * 9]
        w = items[0].split()
        texts.append(pick(4) + " " + " ".join(x if rng.random() > 0.12 else "zz" for x in w) + " " + pick(4))
        got = found(texts, items)
        for r, t in enumerate(texts):
            for i, x in enumerate(items):
                want = best_by_force(t, x, 13, 0.8)
                assert got.get((r, i)) == want, (trial, t, x)


def test_series():
    at = np.array([0, 3, 6, 9, 10, 11, 40, 7])
    h = np.array([1, 1, 1, 1, 1, 1, 1, 2], np.uint64)
    runs = list(zip(*(x.tolist() for x in d.series(h, np.zeros(8, int), at)), strict=True))
    assert [(first + step * k) for x, _, first, step, n in runs if x == 1 for k in range(n)] == at[:7].tolist()
    assert (1, 0, 0, 3, 4) in runs and (2, 0, 7, 1, 1) in runs


def test_repeated_words_cost_little():
    for unit in ("a ", "a b ", "a b c "):
        began = time.time()
        got = found([unit * (100_000 // len(unit.split()))], [unit * (1000 // len(unit.split()))])
        n = 1000 // len(unit.split()) * len(unit.split())
        assert got[0, 0] == (n, n, 0) and time.time() - began < 30


def test_blocks_are_released(spark):
    item = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x {item} y", 1), (2, "nothing of the kind", 2), (None, item, 3), (4, None, 4), (1, item, 5)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, " ".join(f"other{i}" for i in range(30))), (9, None), (9, item)], "item_id long, text string")
    for size in (40, 1 << 20):
        got = sorted((str(r.doc_id), r.item_id, r.n_matched) for r in d.find(docs, bench, block_bytes=size).collect())
        assert got == sorted((str(i), j, 30) for i in (1, 1, None) for j in (7, 9)), size
        assert sorted(r.item_id for r in d.clean(docs, bench, block_bytes=size).collect()) == [2, 4]
    assert d.find(docs.limit(0), bench).count() == 0 and d.clean(docs.limit(0), bench).count() == 0 and d.clean(docs, bench.limit(0)).count() == 5
