"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are of three groups: its words (hashed to ``WORDS`` bins), its pairs of character classes, and for
each word how many words ago it last occurred (bins by doubling distance, and one for new words). ``fit`` counts the terms of a bounded sample of labelled texts, weights them by log frequency and inverse
document frequency, brings each group to the same length, and takes the leading singular directions as the latent
space. ``score`` broadcasts the labelled vectors (at most ``max_train`` x ``dims`` floats, 1 MB at the
defaults) with the axes (``FEATURES`` x ``dims`` floats, 3 MB), takes every document's exact cosine to all of them in
blocks, and lets its ``k`` nearest vote with weight similarity ** ``sharpness``.

Null or empty texts have no terms, are equally near to all labelled rows, and get a score like any other; similarities are
taken to ``DECIMALS`` places, and ties between neighbours go to the earlier labelled row (by the hash of its key); a
document table without rows gives no rows; with no labelled row at all every score is 0.5. Duplicate rows are
scored alike, other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, Tokens, free_name, raw

CLASSES = 64
WORDS = 8192
DISTANCES = 16
#: Where each group of terms begins and ends: words, character pairs, distances.
GROUPS = tuple(np.cumsum([0, WORDS, CLASSES * CLASSES, DISTANCES]).tolist())
FEATURES = GROUPS[-1]
DECIMALS = 6


def _classes() -> np.ndarray:
    """Class of each byte: letters by lower-case letter, capitals as one, digits as one, each common mark alone."""
    out = np.full(256, 63, np.int64)
    for i in range(26):
        out[97 + i] = i
        out[65 + i] = 26
    out[48:58] = 27
    for i, c in enumerate(" \n\t\r.,;:!?'\"()[]{}<>|#$%&*+-=/_@"):
        out[ord(c)] = 28 + min(i, 33)
    out[128:256] = 62
    return out


_CLASS = _classes()


def _distances(t: Tokens) -> np.ndarray:
    """For each word the bin of the words since it last stood in its row (1, 2, 3-4, 5-8, ...); the last bin for new ones."""
    order = np.lexsort((t.hash, t.doc))  # stable: places of a word in a row ascend
    out = np.full(len(t), DISTANCES - 1)
    again = np.flatnonzero((t.hash[order][1:] == t.hash[order][:-1]) & (t.doc[order][1:] == t.doc[order][:-1])) + 1
    out[order[again]] = np.minimum(np.ceil(np.log2(order[again] - order[again - 1])), DISTANCES - 2)
    return out


def features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of each row's terms."""
    out = np.zeros((len(at) - 1, FEATURES), np.float32)
    t = Tokens(body, at)
    word, far = (t.hash >> U64(40)).astype(np.int64) % WORDS, _distances(t)
    for i in range(len(at) - 1):
        c = _CLASS[body[at[i] : at[i + 1]]]
        mine = slice(t.first[i], t.first[i + 1])
        out[i, : GROUPS[1]] = np.bincount(word[mine], minlength=WORDS)
        if len(c) > 1:
            out[i, GROUPS[1] : GROUPS[2]] = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[i, GROUPS[2] : GROUPS[3]] = np.bincount(far[mine], minlength=DISTANCES)
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.axes)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Log frequencies by inverse document frequencies, each group of terms of length one (or none, without its terms); ``out`` may be the counts."""
    x = np.log1p(counts, out=out)
    x *= idf
    for lo, hi in pairwise(GROUPS):
        x[:, lo:hi] /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x[:, lo:hi], x[:, lo:hi]))[:, None], 1e-12)
    return x


def fit(labelled: DataFrame, *, text: str = "text", label: str = "label", key: str = "key", max_train: int = 3000, dims: int = 64, seed: int = 7) -> Model:
    """A model from at most ``max_train`` rows with a label of 0 or 1: those whose ``key`` hashes lowest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                f = features(*raw(part.column("t")))
                yield pa.RecordBatch.from_arrays([part.column("l"), pa.array([x.astype(np.uint32)[nz := np.flatnonzero(x)].tobytes() + nz.astype(np.uint32).tobytes() for x in f], pa.binary()), part.column("h")], names=["l", "f", "h"])

    rows = labelled.select(F.col(label).cast("int").alias("l"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(key)).alias("h")).where("l in (0, 1)")
    rows = rows.mapInArrow(count, "l int, f binary, h long").orderBy("h", "l", "f").limit(max_train).collect()
    rows.sort(key=lambda r: (r.h, r.l, bytes(r.f)))
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        both = np.frombuffer(r.f, np.uint32)
        x[i, both[len(both) // 2 :]] = both[: len(both) // 2]
    labels = np.array([r.l for r in rows], np.float64)
    del rows
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    w = weighted(x, idf, out=x)  # in place: the driver holds one matrix of ``max_train`` x ``FEATURES``, 148 MB at the defaults
    dims = min(dims, *w.shape) if len(x) else 1
    probe = np.random.default_rng(seed).standard_normal((FEATURES, dims + 16)).astype(np.float32)
    for _ in range(3):  # power iterations of the randomised decomposition
        probe = np.linalg.qr(w.T @ (w @ probe))[0]
    _, _, v = np.linalg.svd(w @ probe, full_matrices=False)
    axes = (probe @ v.T[:, :dims]).astype(np.float32)
    model = Model(idf, axes, np.zeros((0, dims), np.float32), labels)
    model.vectors = unit(w @ axes)
    return model


def vote(model: Model, vectors: np.ndarray, k: int, sharpness: float) -> np.ndarray:
    """Share of label 1 among the weights of the k nearest labelled vectors; of equally near ones the earlier."""
    if not len(model.labels):
        return np.full(len(vectors), 0.5)
    sims = np.round(vectors @ model.vectors.T, DECIMALS)
    if k < sims.shape[1]:
        last = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        nearer, tied = sims > last, sims == last
        near = nearer | (tied & (np.cumsum(tied, 1) <= k - nearer.sum(1, keepdims=True)))
    else:
        near = np.ones(sims.shape, bool)
    row, col = np.nonzero(near)
    w = np.maximum(sims[row, col], 1e-6).astype(np.float64) ** sharpness
    total = lambda x: np.bincount(row, weights=x, minlength=len(vectors))
    return np.clip(total(w * model.labels[col]) / total(w), 0, 1)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, k: int = 15, sharpness: float = 8.0, output: str = "score", block: int = 512) -> DataFrame:
    """``keep`` columns (all, if None) and ``output``: the weighted vote, from 0 to 1."""
    names = [c for c in (docs.columns if keep is None else keep) if c != output]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), f"`{output}` double"])
    body = free_name([*names, output], "text")
    inner = docs.select(*names, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                s = vote(m, m.embed(features(*raw(part.column(body)))), k, sharpness)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s, pa.float64())], names=[*names, output])

    return inner.mapInArrow(run, schema)
