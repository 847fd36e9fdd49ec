"""Sharding by fixed virtual slots, in DataFrame operations only.

Records hash into thousands of virtual slots by id, text and a number that tells equal records apart, so that
neither null ids nor copies fill one slot. Bytes are summed by slot (a table of bounded size), and a versioned map
from slots to shards is kept in a folder: version 0 deals slots out in turn, and a rebalancing reads the latest
version, edits it and writes the next one. It moves as few slots as it needs from shards above the mean (or that
are no more) to those below, then exchanges slots while that brings sizes nearer. The law that holds is ``bytes``:
sizes of shards are near equal. A record's place in its shard counts the records of its shard's earlier slots and
those before it in its own, so no task ranks a whole shard. Equal records are numbered within the parts of the
table that hold them, with the counts of the parts before added, so no task gets all copies of one.

Defined cases: a null text has no bytes beyond the fixed ones of a record, and the crc of the empty text. A null
id is a value like any other. Repeated rows are records of their own: the numbers given to n of them are 0 to
n - 1, whichever row gets which. Texts are only measured, so their length does not matter. Other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelith.llm.storage import shared_dir, stored

OVERHEAD = 8
MAP = "version int, slot int, shard int, bytes long, records long"


def rebalance(shard_of: list[int], sizes: list[int], shards: int, swaps: int = 2000, slack: float = 0.002) -> list[int]:
    """The map of slots to shards, edited so that bytes come near equal; arguments are lists over slots.

    Slots of shards from ``shards`` on, which are no more, go to others; shards without slots get theirs. A map
    whose sizes differ by less than ``slack`` of their mean stays as it is.
    """
    shard_of, held = list(shard_of), [0] * shards
    slots: list[list[int]] = [[] for _ in range(shards)]
    loose = [slot for slot, shard in enumerate(shard_of) if shard >= shards]
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            held[shard] += sizes[slot]
            slots[shard].append(slot)
    mean = sum(sizes) / shards
    if not loose and max(held) - min(held) <= slack * mean:
        return shard_of
    for shard in range(shards):
        for slot in sorted(slots[shard], key=lambda s: (sizes[s], s)):
            if held[shard] <= mean:
                break
            if sizes[slot]:
                held[shard] -= sizes[slot]
                loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
        shard = min(range(shards), key=lambda k: (held[k], k))
        shard_of[slot] = shard
        held[shard] += sizes[slot]
    for _ in range(swaps):
        high, low = max(range(shards), key=lambda k: (held[k], -k)), min(range(shards), key=lambda k: (held[k], k))
        gap = held[high] - held[low]
        ups = sorted((sizes[s], s) for s in range(len(sizes)) if shard_of[s] == high)
        downs = sorted([(sizes[s], s) for s in range(len(sizes)) if shard_of[s] == low] + [(0, -1)])
        best, j = (gap, None, None), 0
        for size, slot in ups:  # moving size - other bytes changes the gap by twice that
            while j + 1 < len(downs) and 2 * (size - downs[j + 1][0]) >= gap:
                j += 1
            for other, back in downs[j : j + 2]:
                best = min(best, (abs(gap - 2 * (size - other)), slot, back), key=lambda x: x[0])
        if best[1] is None or best[0] >= gap:
            break
        moved = sizes[best[1]] - (sizes[best[2]] if best[2] >= 0 else 0)
        shard_of[best[1]] = low
        if best[2] >= 0:
            shard_of[best[2]] = high
        held[high] -= moved
        held[low] += moved
    return shard_of


def read_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of a map; None where none is stored."""
    try:
        kept = spark.read.schema(MAP).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    latest = kept.agg(F.max("version")).first()[0]
    return None if latest is None else kept.where(F.col("version") == latest)


def slot_map(sized: DataFrame, shards: int, slots: int, path: str | None = None) -> DataFrame:
    """The latest version of the map (version, slot, shard, bytes, records) in ``path``, after an edit for balance.

    Where none is stored, version 0 deals the slots out in turn. A map that needs no edit for these sizes stays.
    The driver edits it over one number a slot; its size is fixed by ``slots``.
    """
    spark = sized.sparkSession
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sums = {r["slot"]: (r["bytes"], r["records"]) for r in sized.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records")).collect()}

    def write(version: int, shard_of: list[int]) -> None:
        rows = [(version, s, k, *sums.get(s, (0, 0))) for s, k in enumerate(shard_of)]
        spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)

    if read_map(spark, path) is None:
        write(0, [s % shards for s in range(slots)])
    held = {r["slot"]: r for r in read_map(spark, path).collect()}
    if len(held) != slots:
        raise ValueError(f"the map in {path} has {len(held)} slots, not {slots}")
    now = rebalance([held[s]["shard"] for s in range(slots)], [sums.get(s, (0, 0))[0] for s in range(slots)], shards)
    if any(held[s]["shard"] != now[s] or (held[s]["bytes"], held[s]["records"]) != sums.get(s, (0, 0)) for s in range(slots)):
        write(held[0]["version"] + 1, now)
    return read_map(spark, path)


def numbered(docs: DataFrame, parts: str = "part") -> DataFrame:
    """Rows (doc_id, size, text_crc32 and the column ``parts``) with ``tie``, 0 to n - 1 for n equal ones."""
    keys = ["doc_id", "size", "text_crc32"]
    within = F.row_number().over(Window.partitionBy(*keys, parts).orderBy(F.lit(0))) - 1
    counts = docs.groupBy(*keys, parts).agg(F.count("*").alias("n"))
    # several parts hold one record: their counts add up, in a window over parts, not rows
    split = counts.join(counts.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").drop("k").withColumnsRenamed({k: f"__{k}" for k in keys}), F.expr(" and ".join(f"{k} <=> __{k}" for k in keys)), "left_semi")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = split.select(*[F.col(c).alias(f"__{c}") for c in [*keys, parts]], before.alias("before")).where("before > 0")
    joined = docs.withColumn("tie", within).join(offsets, F.expr(" and ".join(f"{c} <=> __{c}" for c in [*keys, parts])), "left")
    return joined.select(*keys, (F.col("tie") + F.coalesce("before", F.lit(0))).alias("tie"))


def assign_shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 24, slots: int = 8192, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (the place in the shard, from 0) and map_version.

    ``path`` names the folder of the map, for tables that are sharded again; a new one by default.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    records = numbered(stored(sized, "records"))
    slotted = stored(records.withColumn("slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "tie"), F.lit(slots)).cast("int")), "slotted")
    plan = slot_map(slotted, shards, slots, path)
    offset = F.coalesce(F.sum("records").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = plan.select("version", "slot", "shard", offset.alias("offset"))
    order = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size", "tie")
    ranked = slotted.withColumn("rank", F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(placed), "slot")  # one row a slot: its size is fixed
    return joined.select("doc_id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), F.col("version").alias("map_version"))
