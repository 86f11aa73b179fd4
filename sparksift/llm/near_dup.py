"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct word shingles (with fewer words, the whole sequence; without words, empty
and linked with nothing). Documents link where the Jaccard similarity of their whole sets is at least
``threshold``; a group is a connected component of links.

1. One pass makes each set's size, a 128-bit hash of the whole set and the band keys of its minima. Equal sets
   meet by that hash and go on as one representative, so copies never make pairs.
2. Representatives that share a band key are candidates. At the defaults (32 bands of 4) a pair at
   similarity 0.8 shares none with probability (1 - 0.8**4)**32 < 6e-8. Buckets with the same members count once.
   For candidates the set and a signature of ``SIGNATURE`` minima (8 bits of each) are made from their texts.
3. Signatures are compared in batches. After n minima with m equal the similarity has the posterior
   Beta(m + 1, n - m + 1); the pair goes once P(similarity >= threshold) < ``miss``.
4. Survivors are verified on the whole sets.

Members are first compared with their bucket's least; what this joins needs no other pair. Buckets that still
hold several groups are compared throughout: blocks of ``block`` members outside the bucket's largest group meet
blocks of all, and only pairs across groups go on: no bucket is cut, none is gathered in one task, and a member is
copied once for each block of those outside the largest group. Where these would be more than 128 blocks, first
those members meet that share one of 128 bands of 8 of the signature's minima: a pair at similarity 0.8 shares none
with probability (1 - 0.8**8)**128 < 1e-10.

Hot keys: joins on a bucket, and on the least of a bucket, are dealt by the other side's id into as many shares as
the bucket has blocks. Texts with more than ``HEAVY`` copies (so there are at most rows / ``HEAVY``) get their group from
a broadcast, empty ones without a join.

Null texts count as empty. A null id is linked with nothing and keeps its row; rows that repeat an id get its
group, or the least of theirs. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import U64, Tokens, mix, powers, slices, stored

SIGNATURE = 1024
#: Compared minima after which a pair may go.
BATCHES = (16, 32, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
#: Bytes of candidates' ids up to which they are broadcast to fetch their texts; beyond, texts and ids are shuffled.
BROADCAST_BYTES = 16 << 20
HEAVY = 100_000
#: Minima in a band that parts a large bucket, and the blocks beyond which it is one: from there bands make fewer copies.
SUB = 8
LARGE = SIGNATURE // SUB


def minimum_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """After n compared minima, the fewest matches at which P(similarity >= threshold) is at least ``miss``."""
    out = []
    for n in BATCHES:
        tail, need = 0.0, n + 1
        for m in range(n + 1):
            tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log1p(-threshold))
            if tail >= miss:
                need = m
                break
        out.append((n, need))
    return out


def set_of(t: Tokens, i: int, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of row ``i``."""
    h = t.hash[t.first[i] : t.first[i + 1]]
    if len(h) == 0:
        return h
    w = min(words, len(h))
    total = np.zeros(len(h) - w + 1, U64)
    for k in range(w):
        total += h[k : len(h) - w + 1 + k] * powers(64)[k + 1]
    return np.unique(mix(total + U64(w)))


def signatures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, bands: int = 32, rows: int = 4, seed: int = 1) -> DataFrame:
    """id, n (set size), a and b (hash of the whole set), keys (a long for each band)."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    weight = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * U64(2) + U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, at in slices(batch, "text"):
                t = Tokens(body, at)
                sets = [set_of(t, i, words) for i in range(part.num_rows)]
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                keys = [None] * len(sets)
                a, b = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    a[full] = mix(np.add.reduceat(every * U64(0xD6E8FEB86659FD93), first)).view(np.int64)
                    b[full] = mix(np.bitwise_xor.reduceat(mix(every), first) + size[full].astype(U64)).view(np.int64)
                    low = (every >> U64(32)).astype(np.uint32) ^ every.astype(np.uint32)
                    least = np.empty((len(full), bands * rows), np.uint32)
                    for k in range(bands * rows):
                        x = low * mul[k]
                        x ^= x >> np.uint32(15)
                        x *= np.uint32(0x2C1B3C6D)
                        x ^= add[k]
                        least[:, k] = np.minimum.reduceat(x, first)
                    key = (mix(least.astype(U64).reshape(len(full), bands, rows) * weight).sum(2) + np.arange(bands, dtype=np.uint64) * U64(0xA24BAED4963EE407)).view(np.int64)
                    for j, i in enumerate(full):
                        keys[i] = key[j]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(a), pa.array(b), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "a", "b", "keys"])

    inner = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return inner.mapInArrow(run, f"id {inner.schema['id'].dataType.simpleString()}, n long, a long, b long, keys array<long>")


def _posterior(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two matrices of minima survive all batches."""
    alive, matched, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, need in steps:
        matched = matched + (x[alive, done:n] == y[alive, done:n]).sum(1)
        stay = matched >= need
        alive, matched, done = alive[stay], matched[stay], n
    return alive


def candidate_sets(docs: DataFrame, ids: DataFrame, words: int, seed: int = 2) -> DataFrame:
    """(id, s, sig): the set and signature of the documents (id, text) with these ids, one row for each id."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 31, (SIGNATURE, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, (SIGNATURE, 1), dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, at in slices(batch, "text"):
                t = Tokens(body, at)
                sets = [set_of(t, i, words) for i in range(part.num_rows)]
                sigs = []
                for s in sets:
                    low, least = (s >> U64(32)).astype(np.uint32) ^ s.astype(np.uint32), np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
                    for i in range(0, len(low), 256):
                        x = low[i : i + 256] * mul
                        x ^= x >> np.uint32(15)
                        x *= np.uint32(0x2C1B3C6D)
                        x ^= add
                        np.minimum(least, x.min(1), out=least)
                    sigs.append((least ^ (least >> np.uint32(16))).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sigs, pa.binary())], names=["id", "s", "sig"])

    few = (ids.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 8)).first()[0] or 0) <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return texts.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, s binary, sig binary").dropDuplicates(["id"])


def _signed(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)


def _verified(pairs: DataFrame, sets: DataFrame, steps: list[tuple[int, int]], percent: int, block: int) -> DataFrame:
    """The pairs (a, b) of ids that survive by signature and whose whole sets reach the threshold; a pair's ``a`` is met in as many shares as ``n`` has blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for i in _posterior(_signed(batch.column("u"), batch.num_rows), _signed(batch.column("v"), batch.num_rows), steps).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U64) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left, right = (sets.select(F.col("id").alias(i), F.col("s").alias(s), F.col("sig").alias(sig)) for i, s, sig in (("a", "x", "u"), ("b", "y", "v")))
    dealt = pairs.withColumn("share", _share("b", block, "n"))
    copies = dealt.select("a", "n", "share").distinct().join(left, "a")
    return dealt.join(copies, ["a", "n", "share"]).join(right, "b").select("a", "b", "u", "v", "x", "y").mapInArrow(run, pairs.select("a", "b").schema)


def _blocks(n: str, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")


def _share(of: str, block: int, n: str) -> Column:
    """The share of an id, of as many as ``n`` has blocks."""
    return F.pmod(F.xxhash64(of), _blocks(n, block)).cast("int")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for the ids of undirected links (a, b): the least id reachable. Labels take the least of their neighbours' and then their label's label, until none changes."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "label")
    while True:  # labels only fall, so this ends
        near = edges.join(label.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = label.join(near, "id").select("id", "comp", F.least("comp", "c").alias("to"))
        jump = step.join(label.select(F.col("id").alias("to"), F.col("comp").alias("c")), "to", "left").select("id", "comp", F.least("to", F.coalesce("c", "to")).alias("to"))
        new = stored(jump, "label")
        if new.where("comp <> to").isEmpty():
            return new.select("id", F.col("to").alias("comp"))
        label = new.select("id", F.col("to").alias("comp"))


def _spread(rows: DataFrame, size: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``size`` (with each key's ``n``) on ``keys``; keys of more than ``HEAVY`` rows are broadcast."""
    heavy = F.broadcast(size.where(F.col("n") > HEAVY))
    light = rows.join(F.broadcast(size.where(F.col("n") > HEAVY).select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(light.join(size.where(F.col("n") <= HEAVY), keys))


def _mixed(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The rows (id, comp, n) of keys that hold several groups, with the largest group (``main``), the members of ``others`` and of all (``total``); a key is met in as many shares as ``n`` has blocks."""
    sizes = rows.groupBy(*keys, "comp").agg(F.count("*").alias("c"), F.max("n").alias("most"))
    several = sizes.groupBy(*keys).agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("others"), F.sum("c").alias("total"), F.max("most").alias("most")).where("others > 0")
    shares = several.select(*keys, "main", "others", "total", F.explode(F.sequence(F.lit(0), _blocks("most", block) - 1)).alias("share"))
    return rows.withColumn("share", _share("id", block, "n")).join(shares, [*keys, "share"]).drop("share")


_MEMBER = ("bucket", "band", "part", "id", "comp", "main", "others", "total", "sig", "all")


def _refined(large: DataFrame, block: int) -> DataFrame:
    """Members of large buckets by each band of their signatures (``band``, ``part``)."""
    part = F.expr(f"transform(sequence(0, {SIGNATURE // SUB - 1}), j -> xxhash64(substring(sig, {SUB} * j + 1, {SUB})))")
    parted = stored(large.select("bucket", F.col("total").alias("n"), "id", "comp", F.posexplode(part).alias("band", "part")), "bands")
    own = large.select("id", "sig", "all").dropDuplicates(["id"])
    return _mixed(parted, ["bucket", "band", "part"], block).join(own, "id").select(*_MEMBER)


def _across(rest: DataFrame, sets: DataFrame, steps: list[tuple[int, int]], block: int) -> DataFrame:
    """Of buckets (bucket, id, comp, main, others, total): the surviving pairs (a, b, n) of different groups.

    Blocks of members outside the bucket's largest group meet blocks of all members; a pair comes from the least bucket, and the first band, that it shares.
    """
    lists = rest.groupBy("id").agg(F.array_sort(F.collect_list("bucket")).alias("all"))  # one for each band at most
    members = stored(rest.join(lists, "id").join(sets.select("id", "sig"), "id"), "members")
    large = F.col("others") > LARGE * block
    m = members.where(~large).withColumns({"band": F.lit(-1), "part": F.lit(0).cast("long")}).select(*_MEMBER)
    if not members.where(large).isEmpty():
        m = m.union(_refined(members.where(large), block))
    few, many = ("others", block), ("total", block)
    every = lambda of: F.explode(F.sequence(F.lit(0), _blocks(*of) - 1))
    left = m.where("comp <> main").withColumn("lo", _share("id", few[1], few[0])).withColumn("hi", every(many)).withColumn("left", F.lit(True))
    right = m.withColumn("hi", _share("id", many[1], many[0])).withColumn("lo", every(few)).withColumn("left", F.lit(False))
    kind = rest.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one = lambda c: table.column(c)[0].as_py()
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        sig = _signed(table.column("sig"), table.num_rows)
        _, comp = np.unique(column("comp"), return_inverse=True)
        _, order = np.unique(column("id"), return_inverse=True)
        other, is_left, bucket, band = column("comp") != column("main"), column("left"), one("bucket"), one("band")
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        every = [set(x) for x in table.column("all").to_pylist()]
        bands = np.ascontiguousarray(sig).view(U64)
        out_a, out_b = [], []
        for p in left:
            q = right[(comp[right] != comp[p]) & (~other[right] | (order[right] > order[p]))]
            if band >= 0 and len(q):
                q = q[np.argmax(bands[q] == bands[p], axis=1) == band]
            if len(q):
                q = q[_posterior(np.broadcast_to(sig[p], (len(q), sig.shape[1])), sig[q], steps)]
                q = np.array([x for x in q.tolist() if min(every[p] & every[x]) == bucket], np.int64)
                out_a.append(np.full(len(q), p))
                out_b.append(q)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "n": pa.array(np.full(len(a), one("total")), pa.int64())})

    found = left.union(right).groupBy("bucket", "band", "part", "lo", "hi").applyInArrow(run, f"a {kind}, b {kind}, n long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").groupBy("a", "b").agg(F.max("n").alias("n"))


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, miss: float = 1e-6, block: int = 512) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, n_shingles, component_id (least id reachable, itself included), kept (it is its group's least)."""
    steps = minimum_matches(percent / 100, miss)
    whole = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    every = stored(signatures(docs, doc_id=doc_id, text=text, words=words, bands=bands, rows=rows), "signatures")
    full = every.where("n > 0 and id is not null")
    reps = stored(full.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "reps")
    keyed = every.join(reps, [every.a == reps.a, every.b == reps.b, every.id == reps.rep], "left_semi").select("id", "keys").dropDuplicates(["id"])
    bands_of = stored(keyed, "keys").select("id", F.explode("keys").alias("bucket"))
    shared = bands_of.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lead"), F.max("id").alias("last"), F.expr("sum(cast(xxhash64(id) as decimal(20,0)))").alias("s"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("x")).where("n > 1")
    once = stored(shared.groupBy("n", "lead", "last", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "lead"), "buckets")
    members = stored(_spread(bands_of, once, ["bucket"]).select("bucket", "n", "lead", "id"), "members")
    sets = stored(candidate_sets(whole, members.select("id").distinct(), words), "sets")

    star = stored(members.where("lead <> id").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n")), "star")
    links = stored(_verified(star, sets, steps, percent, block), "links")
    comp = components(links)
    rest = members.select("bucket", "n", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rest = stored(_mixed(rest, ["bucket"], block), "rest")
    if not rest.isEmpty():
        more = _across(rest, sets, steps, block).join(star.select("a", "b"), ["a", "b"], "left_anti")
        more = stored(_verified(stored(more, "across"), sets, steps, percent, block), "links")
        if not more.isEmpty():
            comp = components(links.union(more))
    named = reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("a", "b", "n", F.coalesce("comp", "rep").alias("component"))
    some = every.select("id", F.col("n").alias("size"), "a", "b")
    alone = (F.col("size") > 0) & F.col("id").isNotNull()
    out = _spread(some.where(alone), stored(named, "named"), ["a", "b"]).select("id", "size", "component")
    out = out.unionByName(some.where(~alone).select("id", "size", F.col("id").alias("component")))
    return out.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
