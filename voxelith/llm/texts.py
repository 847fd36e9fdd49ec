"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the queries count it: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> None:
    """Hand texts to Python workers few at a time: their memory follows a batch, bounded in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Give back what an earlier stage has left in this Python worker."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept_columns(keep: Iterable[str], own: Iterable[str]) -> list[str]:
    """The columns named in ``keep``, each once, without those that an operator's results replace."""
    taken = set(own)
    return [c for c in dict.fromkeys(keep) if c not in taken]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``limit``; one item may exceed it alone."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


def hashed_ngrams(codes: np.ndarray, owner: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, bucket) of each n-gram of ``codes`` that lies within one owner."""
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = codes[:m] * np.uint32(0x85EBCA6B) + np.uint32(n)
        for k in range(1, n):
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h += codes[k : m + k]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - bits)
        inside = owner[:m] == owner[n - 1 :]
        yield (owner[:m], h) if inside.all() else (owner[:m][inside], h[inside])
