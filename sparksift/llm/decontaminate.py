"""Benchmark decontamination by spaced-seed hashing.

Texts become words (ASCII letters lower-cased, ASCII punctuation as blanks). Each of ``MASKS`` is laid on every
position of every benchmark item and of every document; it hashes the words it selects and ignores the rest,
so a passage with substituted words still collides. A further mask of ``sure_run`` words in a row (four by default)
is one that every stretch within the limits must hit. Hits on the same diagonal of a document and an item are
verified: along it, some stretch must match at least ``min_words`` words (all of an item that has fewer) and a
share of ``min_share`` of its words; of those the one with the most matches is told.

The benchmark is the broadcast side: it goes out in blocks of at most ``BLOCK_BYTES`` of text, however large it
is, and every block meets all documents. Where there are several, each one's result is written to the shared folder
and its broadcast released before the next goes out. A seed that a text repeats at equal distances (a word said
thousands of times) is handled as one series, so its diagonals are counted once and not for each pair of places. Null or empty texts and items never match. Rows that repeat an id are
judged one by one. Without documents, or without items, there are no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import PLAIN, Tokens, mix, powers, raw, slices, stored

MASKS = ("111111", "110110011", "101011011", "111001101")
BLOCK_BYTES = 8 << 20
HITS = 1 << 19
_BITS = 22


def sure_run(min_words: int, min_share: float) -> int:
    """The matching words in a row that any stretch of ``min_words`` matches or more and a share of ``min_share`` has at least."""
    runs = (-(-m // (int(m / min_share + 1e-9) - m + 1)) for m in range(min_words, min_words + 1000))
    return max(1, min(runs))


class Seeds:
    """Hashes of all masked positions of some items."""

    def __init__(self, items: list[tuple], masks: tuple[str, ...] = MASKS):
        self.ids = [i for i, _ in items]
        self.t = Tokens(*raw(pa.array([x for _, x in items], pa.string())), PLAIN)
        span = min(len(m) for m in masks)
        size = np.diff(self.t.first)
        self.masks = [*masks, *("1" * n for n in sorted({int(n) for n in size if 0 < n < span}))]
        h, at = [], []
        for m in self.masks:
            found, where = masked(self.t, m)
            if len(m) < span:  # only for the items that are no longer
                own = size[self.t.doc[where]] == len(m)
                found, where = found[own], where[own]
            h.append(found)
            at.append(where)
        h, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, at))
        order = np.argsort(h, kind="stable")
        self.hash = h[order].astype(np.uint64)
        self.series = series(self.hash, self.t.doc[at[order]], at[order])
        self.sieve = np.zeros(1 << _BITS, bool)
        self.sieve[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True


def masked(t: Tokens, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the words that ``mask`` selects, for each position where all of it lies in one row; and those positions."""
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, int(mask, 2) + (len(mask) << 20), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += t.hash[k : k + n] * powers(64)[k + 1]
    at = np.flatnonzero(t.doc[:n] == t.doc[len(mask) - 1 :])
    return mix(total[at]), at


def series(h: np.ndarray, group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of equal hashes in a group (a row or item) as series of equal steps, by hash: hash, group, first, step (1, if alone), count."""
    order = np.lexsort((at, group, h))
    h, group, at = h[order], group[order], at[order]
    same = (h[1:] == h[:-1]) & (group[1:] == group[:-1])
    step = np.where(same, at[1:] - at[:-1], 0)
    goes_on = same.copy()
    goes_on[1:] &= ~same[:-1] | (step[1:] == step[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))[: len(h)]
    count = np.diff(np.append(first, len(h)))
    return h[first], group[first], at[first], np.where(count > 1, np.append(step, 0)[first], 1) if len(h) else first, count


def _diagonals(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The differences of places of pairs of series, as series: pair, first, step, count."""
    (a, g, n), (b, k, m) = x, y
    alike = (n == 1) | (m == 1) | (g == k)
    i = np.flatnonzero(alike)
    one = i, a[i] - b[i] - (m[i] - 1) * k[i], np.where(m[i] > 1, k[i], g[i]), n[i] + m[i] - 1
    j = np.flatnonzero(~alike)  # each place of the shorter with the whole other
    less = n[j] < m[j]
    short = np.where(less, n[j], m[j])
    j, less = np.repeat(j, short), np.repeat(less, short)
    r = np.arange(len(j)) - np.repeat(np.cumsum(short) - short, short)
    first = np.where(less, a[j] + r * g[j] - b[j] - (m[j] - 1) * k[j], a[j] - b[j] - r * k[j])
    other = j, first, np.where(less, k[j], g[j]), np.where(less, m[j], n[j])
    return tuple(np.concatenate(z) for z in zip(one, other, strict=True))


def _runs(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``n`` whose sums are about ``HITS``."""
    upto, i = np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HITS, "right")))
        yield i, j
        i = j


def _distinct(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The distinct (row, item, diagonal), in order, as three rows."""
    order = np.lexsort((diagonal, item, row))
    out = np.stack([row[order], item[order], diagonal[order]]).astype(np.int64)
    return out[:, np.concatenate([[True], (out[:, 1:] != out[:, :-1]).any(0)])[: out.shape[1]]]


def _overlap(t: Tokens, s: Tokens, row, item, diagonal):
    """Where on the items' words a diagonal of a row and an item begins and ends."""
    return np.maximum(s.first[item], t.first[row] - diagonal), np.minimum(s.first[np.add(item, 1)], t.first[np.add(row, 1)] - diagonal)


def _equal(t: Tokens, s: Tokens, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The equal words on each diagonal."""
    lo, hi = _overlap(t, s, row, item, diagonal)
    out = np.zeros(len(row), np.int64)
    for i, j in _runs(hi - lo):
        n = (hi - lo)[i:j]
        first = np.cumsum(n) - n
        word = np.arange(n.sum()) + np.repeat(lo[i:j] - first, n)
        same = s.hash[word] == t.hash[word + np.repeat(diagonal[i:j], n)]
        out[i:j] = np.add.reduceat(same, first, dtype=np.int64)
    return out


def stretch(same: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """(begin, end, matched) of the stretch with the most matches among those with a share of ``min_share``; the shortest, then first, of equals."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # stretches from a match to a match: from the i-th to the j-th there are j - i + 1 matches in at[j] - at[i] + 1 words
    k = np.arange(len(at))
    before, after = k - min_share * at, k + 1 - min_share * (at + 1)
    least = np.minimum.accumulate(before)
    i = np.searchsorted(-least, -after - 1e-9, "left")  # the first match from which the share is reached
    matched, words = k - i + 1, at - at[i] + 1
    j = int(np.lexsort((at, words, -matched))[0])
    return int(at[i[j]]), int(at[j]) + 1, int(matched[j])


def matches(body: np.ndarray, at: np.ndarray, seeds: Seeds, min_words: int, min_share: float) -> list[tuple[int, int, int, int, int, int]]:
    """The best (row, item, matched, words, start byte, end byte) of each row and item."""
    t, s = Tokens(body, at, PLAIN), seeds.t
    need = np.minimum(min_words, np.diff(s.first))
    seen = []
    known, items, firsts, steps, counts = seeds.series
    for m in seeds.masks:
        h, where = masked(t, m)
        some = np.flatnonzero(seeds.sieve[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at_seed = np.minimum(np.searchsorted(seeds.hash, h[some]), max(len(seeds.hash) - 1, 0))
        some = some[seeds.hash[at_seed] == h[some]] if len(seeds.hash) else some[:0]
        h, row, first, step, count = series(h[some], t.doc[where[some]], where[some])
        lo, hi = (np.searchsorted(known, h, side) for side in ("left", "right"))
        for i, j in _runs(hi - lo):
            n = (hi - lo)[i:j]
            x = np.repeat(np.arange(i, j), n)
            y = np.repeat(lo[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pair, begin, by, many = _diagonals((first[x], step[x], count[x]), (firsts[y], steps[y], counts[y]))
            for u, v in _runs(many):
                k = many[u:v]
                which = np.repeat(np.arange(u, v), k)
                diagonal = begin[which] + by[which] * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
                found = _distinct(row[x[pair[which]]], items[y[pair[which]]], diagonal)
                equal = _equal(t, s, *found)
                good = equal >= need[found[1]]
                seen.append(np.vstack([found, equal])[:, good])
    if not seen:
        return []
    row, item, diagonal, equal = np.concatenate(seen, axis=1)
    lo, hi = _overlap(t, s, row, item, diagonal)
    order = np.lexsort((lo + diagonal, -equal, item, row))  # the most that can match first, of those the earliest
    best: dict[tuple[int, int], tuple] = {}
    for k in order.tolist():
        pair = int(row[k]), int(item[k])
        most, words, start = best.get(pair, ((-1, 0, 0),))[0]
        if equal[k] < most or (equal[k] == most == -words and lo[k] + diagonal[k] >= -start):
            continue
        begin, end, matched = stretch(t.hash[lo[k] + diagonal[k] : hi[k] + diagonal[k]] == s.hash[lo[k] : hi[k]], min_share)
        first, n = int(lo[k] + diagonal[k]) + begin, end - begin
        if matched >= need[item[k]] and (matched, -n, -first) > (most, words, start):
            best[pair] = (matched, -n, -first), *pair, matched, n, int(t.start[first] - at[row[k]]), int(t.end[first + n - 1] - at[row[k]])
    return [x[1:] for _, x in sorted(best.items())]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES, masks: tuple[str, ...] = MASKS) -> Iterator[tuple[Seeds, bool]]:
    """The benchmark's items in blocks of about ``block_bytes`` of text, by a hash of their rows; and whether a block is the only one."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("length(t) > 0")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield Seeds(sorted({(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()}, key=str), masks), n == 1


def _masks(min_words: int, min_share: float) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*MASKS, "1" * sure_run(min_words, min_share)]))


def find(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", min_words: int = 13, min_share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches: doc_id, item_id, n_matched, n_words (of the stretch), start_byte, end_byte (in the document)."""
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, n_matched long, n_words long, start_byte long, end_byte long"
    inner = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for seeds, alone in blocks(benchmark, item_id, "text", block_bytes, _masks(min_words, min_share)):
        held = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, body, at in slices(batch, "text"):
                    if found := matches(body, at, held.value, min_words, min_share):
                        row, item, *rest = zip(*found, strict=True)
                        ids = pa.array([held.value.ids[i] for i in item])
                        yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), ids, *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "item_id", "n_matched", "n_words", "start_byte", "end_byte"])

        here = inner.mapInArrow(run, schema)
        out = here if alone else out.union(_released(here, held, "matches"))
    return out


def _released(df: DataFrame, held, name: str) -> DataFrame:
    """``df`` written, and what it was made with given back."""
    out = stored(df, name)
    held.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", min_words: int = 13, min_share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns; a pass over the rows for each block, without a join."""
    spark = docs.sparkSession
    out = docs
    for seeds, alone in blocks(benchmark, item_id, "text", block_bytes, _masks(min_words, min_share)):
        held = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, body, at in slices(batch, text):
                    hit = np.zeros(part.num_rows, bool)
                    hit[[x[0] for x in matches(body, at, held.value, min_words, min_share)]] = True
                    yield part.filter(pa.array(~hit))

        out = out.mapInArrow(run, docs.schema)
        out = out if alone else _released(out, held, "clean")
    return out
