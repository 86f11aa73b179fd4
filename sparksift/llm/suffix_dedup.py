"""Suffix-array deduplication of exact substrings across documents.

A byte goes if a string of ``length`` bytes around it also starts in a document of smaller id. In four steps:

1. Anchors. Of the ``GRAM``-byte hashes in any window of ``length`` bytes the least marks an anchor, so equal
   windows hold equal anchors. Anchor hashes meet in buckets; those of one document only are done with. A
   slice of documents sends a hash once, whatever its count there.
2. Contexts. Around every anchor that other documents share, the bytes of all windows that hold it go to the
   anchor's shard: once for each part of the corpus, with the least id there (greater ids are covered by it).
   An anchor of more occurrences than a suffix array takes is dealt further: its windows are parted by where they
   begin (``ranges``), and each part's contexts, narrowed to it, go by the bytes that all of its windows hold. So
   equal windows still meet, and an anchor at the edge of a common line is no longer one shard's work.
3. Shards. A shard's suffixes are ordered by Larsson-Sadakane refinement, ranks of prefixes doubling until
   ``length`` bytes are told apart; Kasai's common prefixes cut the order into equal windows, and each window
   learns its least id. Where one anchor still has more contexts than a suffix array takes, these make several,
   whose ordered windows are merged by binary search.
4. Runs of covered bytes go back to their documents, where they unite.

Every part writes to every shard, so beyond ``PARTS`` parts their number grows with the square root of the input, as
do their sizes; messages then keep their size and grow in number as the input does.

Texts are judged as UTF-8 on the input. Copies of a whole text are found first, by 128 bits of hash and the length:
all but the least id's go as a whole and take no further part. Contexts count as equal only where their bytes are.
A row is known by its id together with a 64-bit hash of id and text, so two rows are taken for one only if both agree.
Ids that are no integers are numbered in their order first. Null texts are empty and lose nothing, as do texts under
``length`` bytes. A null id is neither source nor loser. Rows with the same id do not remove each other's bytes. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .text import U64, mix, raw, settle, slices, stored, substrings

GRAM = 16
SLICE = 8 << 20
#: Contexts in a suffix array: positions and two ranks of 21 bits fill a sort key. Anchors of more occurrences are dealt further.
ARRAY = 24_000
#: Contexts of several anchors that are sorted together: their suffixes stay in a core's own cache.
BATCH = 1_000
#: Parts up to which they are of the bytes given.
PARTS = 256
#: Copies up to which their ids and keys are broadcast (16 bytes each); beyond, they are joined by shuffling.
BROADCAST_KEYS = 500_000
#: Copies of one text beyond which its least id is broadcast (at most rows / ``HEAVY`` texts), and shares for the others.
HEAVY, SHARES = 100_000, 8
_NONE = np.iinfo(np.int64).max


def suffix_array(text: np.ndarray, depth: int, need: Callable[[np.ndarray, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes (shorter before longer), and each one's rank (see ``ranks``)."""
    rank = ranks(text, depth, need)
    return np.argsort(rank, kind="stable"), rank


def ranks(text: np.ndarray, depth: int, need: Callable[[np.ndarray, int], np.ndarray] | None = None) -> np.ndarray:
    """Each suffix's rank by its first ``depth`` bytes; equal prefixes share a rank.

    Larsson and Sadakane's refinement: groups of equal rank are sorted by the rank ``h`` places on, and only
    groups that are not single yet; ``h`` doubles. ``need(positions, h)``, if given, says which suffixes have to be
    told apart by ``h`` bytes; the place of others is not defined. The first key takes as many bytes as it can hold of
    an alphabet of those that occur.
    """
    n = len(text)
    bits = max(1, int(n + 1).bit_length())
    there = np.bincount(text, minlength=256) > 0
    letters = int(there.sum()) + 1
    wide = 1
    while wide < depth and letters ** (wide + 1) <= 1 << (64 - bits):
        wide += 1
    key = np.zeros(n, U64)
    padded = np.concatenate([np.cumsum(there).astype(U64)[text], np.zeros(wide, U64)])
    for k in range(wide):
        key = key * U64(letters) + padded[k : k + n]
    order = (np.sort((key << U64(bits)) | np.arange(n, dtype=np.uint64)) & U64((1 << bits) - 1)).astype(np.int64)
    rank = _ranks(key[order], order)
    h = wide
    while h < depth:
        step = min(h, depth - h)  # overlapping halves tell exactly ``depth`` bytes apart
        size = np.bincount(rank, minlength=n + 1)
        open_ = np.flatnonzero(size[rank] > 1)
        if need is not None:
            open_ = open_[need(open_, h + step)]
        if not len(open_):
            break
        far = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        low = max(1, int(len(open_)).bit_length())
        if 2 * bits + low <= 64:
            packed = (((rank[open_].astype(U64) << U64(bits)) | far.astype(U64)) << U64(low)) | np.arange(len(open_), dtype=np.uint64)
            place = (np.sort(packed) & U64((1 << low) - 1)).astype(np.int64)
        else:
            place = np.lexsort((far, rank[open_]))
        at = open_[place]
        first, second = rank[at], far[place]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        group = np.concatenate([[True], first[1:] != first[:-1]])
        begin = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
        new = np.maximum.accumulate(np.where(fresh, first + np.arange(len(at)) - begin, 0))
        rank = rank.copy()
        rank[at] = new
        h += step
    return rank


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks in text order for sorted keys: the place of the first equal one."""
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return rank


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefixes of neighbours in the order (of all suffixes, or of some), up to ``most`` bytes (the first: 0).

    In text order a common prefix falls by one at most, so after a match of ``most`` bytes only the rest need
    comparing; all positions are compared at once, in words of 8 bytes, and those that differ stop.
    """
    n = len(text)
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    padded = np.concatenate([text, np.zeros(8 + most, np.uint8)])
    word = np.zeros(n + most, U64)
    for k in range(8):
        word = (word << U64(8)) | padded[k : k + n + most].astype(U64)
    before = np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    live = order[1:].copy()
    got = np.zeros(n, np.int64)
    for h in range(0, most, 8):
        same = word[live + h] == word[before[live] + h]
        stop = live[~same]
        x = word[stop + h] ^ word[before[stop] + h]
        lead = np.zeros(len(stop), np.int64)
        for k in range(1, 8):
            lead += x < (U64(1) << U64(64 - 8 * k))
        got[stop] = h + lead
        live = live[same]
        got[live] = h + 8
    got = np.minimum(got, np.minimum(most, n - np.maximum(np.arange(n), before)))
    got[order[0]] = 0
    return got[order]


def anchors(body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's anchors and their hashes."""
    h = substrings(body, GRAM)
    w = length - GRAM + 1
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, U64)

    def sliding(x: np.ndarray, f: np.ufunc) -> np.ndarray:
        span = 1
        while 2 * span <= w:
            x = f(x[:-span], x[span:])
            span *= 2
        return f(x[: len(x) - (w - span)], x[w - span :]) if w > span else x

    least = sliding(h, np.minimum)
    pad = np.zeros(w - 1, U64)
    most = sliding(np.concatenate([pad, least, pad]), np.maximum)
    at = np.flatnonzero(h == most)
    return at, h[at]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


_FIELDS = ("x", "y", "z", "u", "v", "w", "s")
_SCHEMA = "k long, kind int, " + ", ".join(f"{f} binary" for f in _FIELDS)
_HASHES, _SHARED, _CONTEXTS, _RUNS, _HOT = range(5)


class Rows:
    """Output rows: a key, a kind and arrays."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, k: int, kind: int, *arrays: np.ndarray) -> None:
        self.rows.append((int(k), kind, *(a.tobytes() for a in arrays), *[None] * (len(_FIELDS) - len(arrays))))

    def table(self) -> pa.Table:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * (2 + len(_FIELDS))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * len(_FIELDS)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["k", "kind", *_FIELDS])

    def shared(self, docs: tuple[np.ndarray, np.ndarray], h: np.ndarray, parts: int, buckets: int = 0) -> None:
        """Shared hashes for their rows (key, id), by part; through a bucket, if there are buckets."""
        self._by_part(docs, parts, lambda p, s, of: self.add(p if not buckets else p % buckets, _SHARED, *of, h[s], np.array([p])))

    def runs(self, docs: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, parts: int, shards: int = 0) -> None:
        self._by_part(docs, parts, lambda p, s, of: self.add(p if not shards else p % shards, _RUNS, *of, a[s].astype(np.uint32), b[s].astype(np.uint32), np.array([p])))

    def _by_part(self, docs: tuple[np.ndarray, np.ndarray], parts: int, put) -> None:
        key, ids = docs
        part = (key.view(np.uint64) % U64(parts)).astype(np.int64)
        order = np.lexsort((ids, key, part))
        cut = np.flatnonzero(np.diff(part[order])) + 1
        for s in np.split(order, cut):
            if len(s):
                fresh = np.concatenate([[True], (key[s][1:] != key[s][:-1]) | (ids[s][1:] != ids[s][:-1])])
                back = np.cumsum(fresh) - 1
                put(int(part[s[0]]), s, (key[s[fresh]], ids[s[fresh]], back.astype(np.uint32)))


def _by_row(key: np.ndarray, ids: np.ndarray, back: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Each row (key, id) of a message of ``shared`` or ``runs`` with its places there."""
    edges = np.searchsorted(back, np.arange(len(key) + 1))
    for i, row in enumerate(zip(key.tolist(), ids.tolist(), strict=True)):
        yield row, np.arange(edges[i], edges[i + 1])


def _read(row: dict, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(row[f], k) for f, k in kinds.items()]


def _dicts(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {n: (v.as_buffer() if v.is_valid and hasattr(v, "as_buffer") else v.as_py()) for n, v in ((n, batch.column(n)[i]) for n in names)}


def _pack(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True), np.uint8)


def _unpack(buffer: pa.Buffer) -> pa.Buffer:
    return pa.decompress(buffer[8:], int.from_bytes(buffer[:8].to_pybytes(), "little"), "zstd")


def _sent(docs: DataFrame, length: int, buckets: int, parts: int, slice_bytes: int = SLICE) -> DataFrame:
    """Step 1, by slice: hashes of anchors and how often each occurs to their buckets, those shared within the slice to their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, at in slices(batch, "text", slice_bytes):
                ids, keys = part.column("id").to_numpy(), part.column("key").to_numpy()
                hs, ds, ns = [], [], []
                for i in range(part.num_rows):
                    text = body[at[i] : at[i + 1]]
                    if len(text) >= length:
                        h, times = np.unique(anchors(text, length)[1], return_counts=True)
                        hs.append(h)
                        ns.append(times)
                        ds.append(np.full(len(h), i))
                rows = Rows()
                if hs:
                    h, d, times = np.concatenate(hs), np.concatenate(ds), np.concatenate(ns)
                    order = np.argsort(h)
                    h, d, times = h[order], d[order], times[order]
                    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    n = np.diff(np.append(first, len(h)))
                    low, high = np.minimum.reduceat(ids[d], first), np.maximum.reduceat(ids[d], first)
                    every = np.add.reduceat(times, first)
                    known = low != high
                    again = np.repeat(known, n)
                    rows.shared((keys[d[again]], ids[d[again]]), h[again], parts, buckets)
                    bucket = _bucket(h[first], buckets)
                    for b in np.unique(bucket).tolist():
                        g = np.arange(*np.searchsorted(bucket, [b, b + 1]))
                        alone = g[~known[g]]
                        one = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in alone]) if (n[alone] > 1).any() else first[alone]
                        docs_of, back = np.unique(d[one], return_inverse=True)
                        both = g[known[g]]
                        rows.add(b, _HASHES, h[one], back.astype(np.uint32 if len(docs_of) > 65535 else np.uint16), ids[docs_of], keys[docs_of], h[first[both]], low[both], np.concatenate([times[one], every[both]]).astype(np.uint32))
                yield from rows.table().to_batches()

    return docs.mapInArrow(run, _SCHEMA)


def _meet(parts: int, array: int):
    """Step 1, by bucket: hashes that several documents share, for the parts of these; those that occur more than ``array`` times for all."""

    def run(table: pa.Table) -> pa.Table:
        rows, hs, ids, keys, ns = Rows(), [], [], [], []
        for row in _dicts(table):
            if row["kind"] == _SHARED:
                key, doc, back, h, part = _read(row, x=np.int64, y=np.int64, z=np.uint32, u=U64, v=np.int64)
                rows.add(part[0], _SHARED, key, doc, back, h, part)
                continue
            h, doc_ids, doc_keys, known, low, times = _read(row, x=U64, z=np.int64, u=np.int64, v=U64, w=np.int64, s=np.uint32)
            back = np.frombuffer(row["y"], np.uint32 if len(doc_ids) > 65535 else np.uint16)
            hs += [h, known, known]
            ids += [doc_ids[back], low, np.full(len(known), _NONE)]  # two ids that differ: shared already
            keys += [doc_keys[back], np.zeros(2 * len(known), np.int64)]
            ns += [times, np.zeros(len(known), np.uint32)]
        if hs:
            h, i, k, n = np.concatenate(hs), np.concatenate(ids), np.concatenate(keys), np.concatenate(ns)
            wants = np.concatenate([np.full(len(x), j % 3 == 0) for j, x in enumerate(hs)])
            order = np.argsort(h)
            h, i, k, n, wants = h[order], i[order], k[order], n[order], wants[order]
            if len(h):
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                several = np.minimum.reduceat(i, first) != np.maximum.reduceat(i, first)
                yes = np.repeat(several, np.diff(np.append(first, len(h)))) & wants
                rows.shared((k[yes], i[yes]), h[yes], parts)
                hot = h[first[several & (np.add.reduceat(n, first, dtype=np.int64) > array)]]
                if len(hot):
                    rows.add(0, _HOT, hot)
        return rows.table()

    return run


def _codes(mat: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each context: its anchor, extent and bytes."""
    words = np.zeros((len(mat), -(-mat.shape[1] // 8) * 8), np.uint8)
    words[:, : mat.shape[1]] = mat
    code = h + (lo * 256 + hi).astype(U64)
    for c in words.view(U64).T:
        code = mix(code ^ c)
    return code


def _differs(order: np.ndarray, code: np.ndarray, mat: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Where contexts in order differ from the one before, in their bytes or else."""
    fresh = np.ones(len(order), bool)
    fresh[1:] = code[order][1:] != code[order][:-1]
    alike = np.flatnonzero(~fresh)
    for i in range(0, len(alike), 1 << 16):
        x, y = order[alike[i : i + (1 << 16)]], order[alike[i : i + (1 << 16)] - 1]
        fresh[alike[i : i + (1 << 16)]] = (mat[x] != mat[y]).any(1) | np.any([o[x] != o[y] for o in others], axis=0)
    return fresh


def ranges(last: int) -> list[tuple[int, int]]:
    """The places 0 .. ``last`` at which a context's windows begin, in runs that double from both ends.

    At the edge of a common line windows differ by what lies beyond it; a run from ``a`` holds about as many such
    bytes in all its windows as it adds, so few of its contexts stay together, or few differ.
    """
    out, a, b, step = [], 0, last, 1
    while a <= b:
        out.append((a, min(a + step - 1, b)))
        a += step
        if a <= b:
            out.append((max(b - step + 1, a), b))
            b -= step
        step *= 2
    return sorted(out)


def dealt(found: tuple[np.ndarray, ...], hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Contexts (bytes, anchor, document, place, extent to the left and right), those of ``hot`` anchors narrowed to each of ``ranges``.

    For the anchor's hash stands one of it and the bytes that all windows of the range hold.
    """
    mat, h, d, p, lo, hi = found
    left = length - GRAM
    far = np.isin(h, hot)
    if not far.any():
        return found
    out, at, column = [tuple(x[~far] for x in found)], np.flatnonzero(far), np.arange(mat.shape[1])
    for a, b in ranges(left):
        less, more = np.minimum(lo[at], left - a), np.minimum(hi[at], b + GRAM)
        holds = less + more >= length
        s, less, more = at[holds], less[holds], more[holds]
        narrow = np.where((column >= left - less[:, None]) & (column < left + more[:, None]), mat[s], 0).astype(np.uint8)
        none = np.zeros(len(s), np.int64)
        out.append((narrow, mix(_codes(narrow[:, b : a + length], h[s] + U64(a + 1), none, none)), d[s], p[s], less, more))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _context(length: int, shards: int, parts: int, hot):
    """Step 2, by part: contexts to their shards; what a smaller id covers within the part, as runs."""
    left, right = length - GRAM, length

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows = Rows()
        known: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in _dicts(replies):
            key, doc, back, h = _read(row, x=np.int64, y=np.int64, z=np.uint32, u=U64)
            for name, s in _by_row(key, doc, back):
                known.setdefault(name, []).append(h[s])
        if not texts.num_rows or not known:
            return rows.table()
        body, offs = raw(texts.column("text"))
        ids, keys = texts.column("id").fill_null(0).to_numpy(), texts.column("key").to_numpy()
        mats, hs, ds, ps, ls, rs = [], [], [], [], [], []
        done: set[tuple[int, int]] = set()
        skip = [c or i is None for c, i in zip(texts.column("copy").to_pylist(), texts.column("id").to_pylist(), strict=True)]
        for i, name in enumerate(zip(keys.tolist(), ids.tolist(), strict=True)):
            if skip[i] or name not in known or name in done:
                continue
            done.add(name)
            text = body[offs[i] : offs[i + 1]]
            at, h = anchors(text, length)
            keep = np.isin(h, np.concatenate(known[name]))
            at, h = at[keep], h[keep]
            if len(at):
                padded = np.concatenate([np.zeros(left, np.uint8), text, np.zeros(right, np.uint8)])
                mats.append(np.lib.stride_tricks.sliding_window_view(padded, left + right)[at])
                hs.append(h)
                ds.append(np.full(len(at), i))
                ps.append(at)
                ls.append(np.minimum(left, at))
                rs.append(np.minimum(right, len(text) - at))
        if not hs:
            return rows.table()
        mat, h, d, p, lo, hi = dealt(tuple(np.concatenate(x) for x in (mats, hs, ds, ps, ls, rs)), hot.value, length)
        del mats, known
        code = _codes(mat, h, lo, hi)
        order = np.lexsort((ids[d], code))
        fresh = _differs(order, code, mat, h, lo, hi)
        least = ids[d][order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        mine = ids[d][order] == least
        gone = order[~mine]
        gone = gone[lo[gone] + hi[gone] >= length]
        rows.runs((keys[d[gone]], ids[d[gone]]), p[gone] - lo[gone], p[gone] + hi[gone], parts, shards)
        order = order[mine]
        context = np.cumsum(fresh)[mine] - 1
        heads = order[np.concatenate([[True], context[1:] != context[:-1]])]
        shard = _bucket(mix(h), shards)
        of = np.argsort(shard[heads], kind="stable")
        cut = np.flatnonzero(np.diff(shard[heads][of])) + 1
        first = np.searchsorted(context, np.arange(len(heads)))
        n = np.diff(np.append(first, len(context)))
        for g in np.split(of, cut):
            e = heads[g]
            occ = np.concatenate([order[first[j] : first[j] + n[j]] for j in g]) if (n[g] > 1).any() else order[first[g]]
            docs_of, back = np.unique(d[occ], return_inverse=True)
            where = np.stack([np.repeat(np.arange(len(g)), n[g]), back.ravel(), p[occ]]).astype(np.uint32)
            rows.add(shard[e[0]], _CONTEXTS, _pack(mat[e]), h[e], np.stack([lo[e], hi[e]]).astype(np.uint16), ids[d[e]], _pack(where), keys[docs_of], ids[docs_of])
        return rows.table()

    return run


def least_ids(mat: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows of bytes: each distinct window's (context, offset), by window; the first of each window; and its least id."""
    n, width = mat.shape
    left = width - length
    text = np.ascontiguousarray(mat).ravel()
    rank = ranks(text, length, lambda at, h: at % width <= left + length - h)
    order = (np.arange(n)[:, None] * width + np.arange(left + 1)).ravel()  # where a window can begin
    order = order[np.argsort(rank[order], kind="stable")]
    group = np.cumsum(common_prefixes(text, order, length) < length)
    row, off = order // width, order % width
    whole = (off >= left - lo[row]) & (off <= np.minimum(left, left + hi[row] - length))
    at, group = order[whole], group[whole]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at, first, np.minimum.reduceat(ids[at // width], first) if len(first) else np.zeros(0, np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Least ids of ordered distinct windows over several arrays, found in each other by binary search."""
    out = [ids.copy() for _, ids in parts]
    for i, (windows, _) in enumerate(parts):
        for j, (other, ids) in enumerate(parts):
            if i != j and len(other):
                at = np.minimum(np.searchsorted(other, windows), len(other) - 1)
                same = other[at] == windows
                out[i][same] = np.minimum(out[i][same], ids[at[same]])
    return out


def _shard(length: int, parts: int, array: int):
    """Step 3, by shard: runs of covered bytes, by part."""
    left = length - GRAM
    width = left + length

    def run(table: pa.Table) -> pa.Table:
        rows, got = Rows(), []
        for row in _dicts(table):
            if row["kind"] == _RUNS:
                key, doc, back, a, b, part = _read(row, x=np.int64, y=np.int64, z=np.uint32, u=np.uint32, v=np.uint32, w=np.int64)
                rows.add(part[0], _RUNS, key, doc, back, a, b, part)
                continue
            h, sides, ids, keys, docs = _read(row, y=U64, z=np.uint16, u=np.int64, w=np.int64, s=np.int64)
            mat = np.frombuffer(_unpack(row["x"]), np.uint8).reshape(-1, width)
            where = np.frombuffer(_unpack(row["v"]), np.uint32).reshape(3, -1).astype(np.int64)
            got.append((mat, h, sides.reshape(2, -1).astype(np.int64), ids, where, keys, docs))
        if not got:
            return rows.table()
        start = np.concatenate([[0], np.cumsum([len(x[1]) for x in got])[:-1]])
        mat, h, ids = (np.concatenate([x[i] for x in got]) for i in (0, 1, 3))
        lo, hi = np.concatenate([x[2] for x in got], 1)
        occ = np.concatenate([x[4][0] + s for x, s in zip(got, start, strict=True)])
        occ_key, occ_id = (np.concatenate([x[k][x[4][1]] for x in got]) for k in (5, 6))
        occ_at = np.concatenate([x[4][2] for x in got])
        del got
        # equal contexts are one for the array: all but their least id are covered throughout
        code = _codes(mat, h, lo, hi)
        order = np.lexsort((ids, code))
        fresh = _differs(order, code, mat, h, lo, hi)
        cls = np.empty(len(h), np.int64)
        cls[order] = np.cumsum(fresh) - 1
        rep = order[fresh]
        least_of = ids[rep]
        by_anchor = np.argsort(h[rep], kind="stable")
        edge = np.append(np.flatnonzero(np.concatenate([[True], h[rep][by_anchor][1:] != h[rep][by_anchor][:-1]])), len(rep))
        several = np.repeat(np.diff(edge) > 1, np.diff(edge))  # an anchor with one context has no other windows to meet
        by_anchor = by_anchor[several]
        g = h[rep][by_anchor]
        edge = np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g)) if len(g) else np.zeros(1, np.int64)
        covered_rep = np.zeros((len(rep), left + 1), bool)
        i = 0
        while i < len(edge) - 1:  # whole anchors, some at a time; one anchor alone may take several arrays
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + min(array, BATCH), "right")) - 1)
            some = by_anchor[edge[i] : edge[j]]
            pieces = [some[k : k + array] for k in range(0, len(some), array)]
            found = [least_ids(mat[rep[s]], lo[rep[s]], hi[rep[s]], least_of[s], length) for s in pieces]
            least = [f[2] for f in found]
            if len(pieces) > 1:
                least = _merge([(_windows(mat[rep[s]], f[0][f[1]], length), f[2]) for s, f in zip(pieces, found, strict=True)])
            for s, (at, first, _), best in zip(pieces, found, least, strict=True):
                low = np.repeat(best, np.diff(np.append(first, len(at))))
                c, off = at // width, at % width
                hit = low < least_of[s][c]
                covered_rep[s[c[hit]], off[hit]] = True
            i = j
        offs = np.arange(left + 1)
        whole = (offs >= left - lo[:, None]) & (offs + length <= left + hi[:, None])
        covered = np.where((ids > least_of[cls])[:, None], whole, covered_rep[cls])
        edges = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        c0, a = np.nonzero(edges == 1)
        _, b = np.nonzero(edges == -1)
        n = np.bincount(c0, minlength=len(h))
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        times = n[occ]
        which = np.repeat(first[occ], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        base = np.repeat(occ_at - left, times)
        rows.runs((np.repeat(occ_key, times), np.repeat(occ_id, times)), base + a[which], base + b[which] - 1 + length, parts)
        return rows.table()

    return run


def _windows(mat: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Windows as byte strings that compare as the suffixes do; a mark after each keeps trailing zeros."""
    view = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(mat).ravel(), length)[at]
    return np.ascontiguousarray(np.hstack([view, np.ones((len(view), 1), np.uint8)])).view(f"S{length + 1}").ravel()


def _united(length: int):
    """Step 4, by part: each row's covered runs."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        body, at = raw(texts.column("text"))
        runs: dict[tuple[int, int], list] = {}
        for row in _dicts(found):
            key, doc, back, a, b = _read(row, x=np.int64, y=np.int64, z=np.uint32, u=np.uint32, v=np.uint32)
            for name, s in _by_row(key, doc, back):
                runs.setdefault(name, []).append((a[s], b[s]))
        spans, kept, copy = [], [], texts.column("copy").to_pylist()
        for i, name in enumerate(zip(texts.column("key").to_pylist(), texts.column("id").to_pylist(), strict=True)):
            text = body[at[i] : at[i + 1]]
            depth = np.zeros(len(text) + 1, np.int64)
            for a, b in runs.get(name, ()):
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
            gone = np.full(len(text), True) if copy[i] and len(text) >= length else np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
            kept.append(text[~gone].tobytes())
        return pa.table({"id": texts.column("id"), "n_bytes": pa.array(np.diff(at)), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    return run


def parts_of(size: int, part_bytes: int) -> int:
    """Parts for ``size`` bytes: of ``part_bytes``, and beyond ``PARTS`` as the square root of the size."""
    n = max(1, -(-size // part_bytes))
    return n if n <= PARTS else isqrt(PARTS * n)


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50, part_bytes: int = 4 << 20, array: int = ARRAY) -> DataFrame:
    """Per row: ``doc_id``, n_bytes, spans (removed runs of bytes: start, end), kept (the other bytes)."""
    whole = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if not isinstance(whole.schema["id"].dataType, IntegralType):
        numbers = stored(whole.select("id").where("id is not null").distinct().orderBy("id").withColumn("number", F.monotonically_increasing_id()), "numbers")
        named = deduplicate(whole.join(numbers, "id", "left").select(F.col("number").alias("id"), "text"), doc_id="id", length=length, part_bytes=part_bytes, array=array)
        return named.withColumnRenamed("id", "number").join(numbers, "number", "left").select(F.col("id").alias(doc_id), "n_bytes", "spans", "kept")
    whole = whole.withColumn("id", F.col("id").cast("long"))
    whole = whole.withColumn("key", F.xxhash64("id", "text"))
    same = whole.where("id is not null").select("id", "key", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").alias("n"))
    size, rows = same.agg(F.sum("n"), F.count("*")).first()
    parts = parts_of(size or 0, part_bytes)
    least = same.groupBy("h", "g", "n").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("copies")).where("least <> most")
    least = stored(least.drop("most"), "least")
    few = F.broadcast(least.where(F.col("copies") > HEAVY))
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    rest = same.join(few, ["h", "g", "n"], "left_anti").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
    rest = rest.join(least.where(F.col("copies") <= HEAVY).select("*", share), ["h", "g", "n", "share"])
    both = same.join(few, ["h", "g", "n"]).select("id", "key", "least").union(rest.select("id", "key", "least"))
    copies = stored(both.where("id > least").select("id", "key").distinct(), "copies")
    few = copies.count() <= BROADCAST_KEYS
    copies = copies.withColumn("copy", F.lit(True))
    texts = whole.join(F.broadcast(copies) if few else copies, ["id", "key"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    texts = texts.withColumn("k", F.expr(f"cast((cast(key as decimal(20,0)) + if(key < 0, 18446744073709551616BD, 0BD)) % {parts} as bigint)"))
    judged = texts.where("id is not null and not copy").select("id", "text", "key")
    sent = _sent(judged, length, parts, parts, max(SLICE, 2 * (size or 0) // parts))
    met = stored(sent.groupBy("k").applyInArrow(_meet(parts, array), _SCHEMA), "met")
    settle(docs.sparkSession)  # the anchors' shuffle goes before the contexts' comes
    hot = met.where(F.col("kind") == _HOT).select("x").collect()  # at most all occurrences / ``array``
    hot = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, U64), *(np.frombuffer(r.x, U64) for r in hot)])))
    met = met.where(F.col("kind") == _SHARED)
    contexts = texts.groupBy("k").cogroup(met.groupBy("k")).applyInArrow(_context(length, parts, parts, hot), _SCHEMA)
    runs = contexts.groupBy("k").applyInArrow(_shard(length, parts, array), _SCHEMA)
    out = texts.groupBy("k").cogroup(runs.groupBy("k")).applyInArrow(_united(length), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", doc_id)
