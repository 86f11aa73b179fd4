"""Vectorised tokens and hashes over Arrow string columns, shared by the corpus operators.

A batch is worked on in slices of about ``SLICE_BYTES`` of text (one document at least), so memory
follows the slice and not the batch. Hashes are 64-bit: a random value per byte, weighted by powers of
an odd base (so any substring's hash comes from a prefix sum), then mixed.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparksift.session import shared_dir

SLICE_BYTES = 2 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: As LOWER, with ASCII punctuation and control characters as blanks.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(2)
def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(n, base, U64))])


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**n, kept for sizes rounded up to a power of two."""
    return _powers(1 << max(16, int(n).bit_length()), int(base))[: n + 1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes of text: the rows, their bytes, their offsets."""
    body, at = raw(batch.column(name))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), body[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Tokens:
    """Words of some documents: ``start``, ``end`` (bytes), ``hash``, ``doc`` (row), ``first`` (of each row, n + 1 long)."""

    def __init__(self, body: np.ndarray, at: np.ndarray, fold: np.ndarray = LOWER):
        text = fold[body]
        word = ~WORD_SPACE[text]
        fresh = np.zeros(len(text) + 1, bool)
        fresh[at] = True
        before = np.empty(len(text), bool)
        before[:1] = False
        before[1:] = word[:-1]
        before &= ~fresh[:-1]
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(len(text), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        after &= ~fresh[1:]
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.text = text
        total = prefix_sums(text)
        self.hash = mix((total[self.end] - total[self.start]) * powers(len(text), _INV)[self.start] + (self.end - self.start).astype(U64))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``n`` words within a row, and the word at which each begins."""
        if len(self) < n:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        keep = np.flatnonzero(self.doc[: len(self) - n + 1] == self.doc[n - 1 :])
        total = np.zeros(len(self) - n + 1, U64)
        for k in range(n):
            total += self.hash[k : len(self) - n + 1 + k] * powers(64)[k + 1]
        return mix(total[keep]), keep


def prefix_sums(text: np.ndarray) -> np.ndarray:
    """Sums from which the hash of text[i:j] is (s[j] - s[i]) * base**-i."""
    out = np.zeros(len(text) + 1, U64)
    np.cumsum(_BYTE[text] * powers(len(text))[: len(text)], out=out[1:])
    return out


def substrings(text: np.ndarray, n: int) -> np.ndarray:
    """The hash of each substring of ``n`` bytes."""
    if len(text) < n:
        return np.zeros(0, U64)
    total = prefix_sums(text)
    return mix((total[n:] - total[:-n]) * powers(len(text), _INV)[: len(text) - n + 1])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, which is also set as the context's where it has none."""
    sc, found = spark.sparkContext, shared_dir(spark)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def settle(spark: SparkSession) -> None:
    """Let go of finished jobs' plans on both sides of the driver, so that the context cleaner deletes their shuffle files now."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for this frame; nothing may read it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no taken name equals it, in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)


def some(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches gathered to tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in rows_of(batches):
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def flat(lists: list[list]) -> list:
    return list(chain.from_iterable(lists))
