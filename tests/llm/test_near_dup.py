"""Groups by force with every branch: blocks of a few members, parts of large buckets, heavy keys, ids joined by shuffling."""

from itertools import combinations

import numpy as np
import pytest

from sparksift.llm import near_dup

RNG = np.random.default_rng(23)


def corpus():
    """Groups of near copies within one large set of documents that share most of a passage, copies of each, empties."""
    word = lambda n: [f"w{x}" for x in RNG.integers(0, 100_000, n)]
    passage = word(60)
    texts = []
    for _ in range(12):
        own = word(30)
        for k in range(6):
            edit = list(own)
            if k:
                edit[int(RNG.integers(0, 30))] = f"x{k}"
            texts.append(" ".join(passage + edit))
    texts += texts[:5] * 2 + ["", "", None, "a b", "a b", " ".join(word(50))]
    return [(int(i), t) for i, t in zip(RNG.permutation(len(texts)), texts, strict=True)]


def by_force(rows, n):
    sets = {i: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := (t or "").split()) else frozenset() for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, sets


@pytest.mark.parametrize("heavy, ids, block, kind, large", [(100_000, 1 << 24, 512, "long", 128), (2, 0, 5, "long", 128), (3, 0, 16, "string", 128), (3, 0, 1, "long", 0)])
def test_groups_by_force(spark, monkeypatch, heavy, ids, block, kind, large):
    monkeypatch.setattr(near_dup, "LARGE", large)  # 0: all are parted by bands
    monkeypatch.setattr(near_dup, "HEAVY", heavy)
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", ids)
    rows = corpus()
    if kind == "string":
        rows = [(f"{i:05}", t) for i, t in rows]
    label, sets = by_force(rows, 4)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], f"doc_id {kind}, text string, n int, component int")
    got = near_dup.groups(docs, words=4, block=block).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), c, c == i) for i, c in label.items()} and len(got) == len(rows)
    assert len(set(label.values())) < len(rows) - 20


def test_long_chain_of_links(spark):
    links = [(i, i + 1) for i in range(90)] + [(200, 300)]
    got = {r.id: r.comp for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(91), 0), 200: 200, 300: 200}
