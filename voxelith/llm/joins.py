"""Joins of many rows with a table of one row a key, when few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.storage import stored

#: No more keys than this can each hold more than its part of all rows; only such keys are sent to all executors.
HOT_KEYS = 10_000


def hot_bar(total: int) -> int:
    """A key with more rows than this is hot: of ``total`` rows at most HOT_KEYS keys are."""
    return max(1000, total // HOT_KEYS)


def meet(rows: DataFrame, found: DataFrame, on: list[str], times: str) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row a key and, in ``times``, its number of rows.

    Rows of hot keys meet a broadcast of at most HOT_KEYS rows and are not shuffled; the others meet by shuffle,
    where no key has more rows than the bar. Keys are not null. ``found`` should be stored: it is read three times.
    """
    bar = hot_bar(found.agg(F.sum(times)).first()[0] or 0)
    hot, cold = found.where(F.col(times) > bar), found.where(F.col(times) <= bar)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def shared(rows: DataFrame, key: str, name: str, buckets: int = 1 << 16) -> DataFrame:
    """``rows`` (stored) whose ``key`` others have too, with ``n``, the number of rows of that key.

    Rows are counted by buckets of the key's hash first, a count that combines before its shuffle. Keys in buckets
    with no more rows than the bar are counted in windows, with one shuffle of their rows; those in fuller buckets,
    of which there are at most HOT_KEYS, by aggregation and ``meet``.
    """
    bar = hot_bar(rows.count())
    cut = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(7), key), F.lit(buckets)).cast("int"))
    full = cut.groupBy("__bucket").agg(F.count("*").alias("n")).where(F.col("n") > bar)
    full = F.broadcast(stored(full.select("__bucket"), f"{name}-full"))
    easy = cut.join(full, "__bucket", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n > 1")
    hard = cut.join(full, "__bucket", "left_semi")
    counts = stored(hard.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), f"{name}-counts")
    return easy.drop("__bucket").unionByName(meet(hard.drop("__bucket"), counts, [key], "n").select(*easy.drop("__bucket").columns))
