"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import ARROW_BYTES, small_batches  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(df: DataFrame, n: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``. A null id has fold -1."""
    return F.coalesce(F.crc32(df[key].cast("string")) % n, F.lit(-1))


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of a piece stays near ``chars`` bytes; a longer single row is a piece of its own."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(batch):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list:
    return batch.column(column).to_pylist()


class Memo(dict):
    """Word to 64-bit hash, remembered for frequent words; it starts anew when it grows large."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = value
        return value


MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX2
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], width: int, memo: Memo, distinct: bool = True) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``width``-word shingles; a shorter text is one shingle, no words give none.
    Not ``distinct``: in order of the text."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for j in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out) if distinct else out


def tidy(run: Callable, *empty: Callable[[], object]) -> Callable:
    """``run`` for ``mapInArrow``; when a task is through, ``empty`` is called and freed memory goes back to the system. Python workers outlive tasks and stages: what one leaves, the next one carries."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for call in empty:
                call()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return wrapped
