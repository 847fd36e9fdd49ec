"""Joins by coordinate arithmetic: voxels with coarser fields and masks, slab boundaries, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.operators.voxels import ZYX

Shape = tuple[int, int, int]


def coarse_index(c: str, fine: int, coarse: int) -> Column:
    """floor(c * coarse / fine), at most coarse - 1, in whole numbers."""
    return F.least(F.expr(f"cast((cast({c} as bigint) * {coarse}) div {fine} as int)"), F.lit(coarse - 1))


def with_field(vol: DataFrame, field: DataFrame, shape: Shape, coarse: Shape, how: str = "inner") -> DataFrame:
    """Voxels with the value ``f`` of the coarser voxel that holds them: an equi-join on computed keys."""
    keyed = vol
    for c, n, m in zip(ZYX, shape, coarse, strict=True):
        keyed = keyed.withColumn(f"c{c}", coarse_index(c, n, m))
    side = field.select(*[F.col(c).alias(f"c{c}") for c in ZYX], "f")
    return keyed.join(side, ["cz", "cy", "cx"], how).drop("cz", "cy", "cx")


def block_mask(vol: DataFrame, mask: DataFrame, scale: int, last_z: int) -> DataFrame:
    """Voxels under a mask that is ``scale`` times coarser; its last layer also covers the remainder in z."""
    keys = [F.least(F.expr(f"cast(z div {scale} as int)"), F.lit(last_z)).alias("mz"), F.expr(f"cast(y div {scale} as int)").alias("my"), F.expr(f"cast(x div {scale} as int)").alias("mx")]
    side = mask.select(F.col("z").alias("mz"), F.col("y").alias("my"), F.col("x").alias("mx"))
    return vol.select("*", *keys).join(side, ["mz", "my", "mx"], "left_semi").drop("mz", "my", "mx")


#: A table of at most so many rows is sent to all tasks.
SMALL = 1_000_000


def small(table: DataFrame, rows: int = SMALL) -> DataFrame:
    """``table``, to be broadcast if it has at most ``rows`` rows, else joined by shuffle; counts no further than that."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def with_table(vol: DataFrame, prob: DataFrame) -> DataFrame:
    """Look up a probability table (material, field_bin, voxel_bin, p), which has a row a bin."""
    return vol.join(small(prob), ["field_bin", "voxel_bin"])


def slab_pairs(labels: DataFrame, height: int) -> DataFrame:
    """Pairs of labels that meet across the boundary of slabs of ``height`` slices: last layer with first layer."""
    low = labels.where(f"z % {height} = {height - 1}").select((F.col("z") + 1).alias("z"), "y", "x", F.col("label").alias("label_a"))
    high = labels.where(f"z % {height} = 0 and z > 0").select("z", "y", "x", F.col("label").alias("label_b"))
    return low.join(high, ZYX).select("label_a", "label_b").distinct()


def starts(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Running start of each row of a small catalog table (subvolumes, chunks)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def chunks(nz: int, size: int) -> list[tuple[int, int, int]]:
    """(chunk, first slice, slices) of a volume cut into chunks."""
    return [(i, z, min(size, nz - z)) for i, z in enumerate(range(0, nz, size))]


def join_subvolumes(vol: DataFrame, sizes: list[int], shifts: list[int], keep: str = "upper") -> DataFrame:
    """Scans that overlap by ``shifts`` slices, as one volume.

    ``keep`` says whose slices stay in an overlap: ``upper`` drops the first slices of the next scan, ``lower`` the
    last slices of the one before.
    """
    rows, out, z = [], 0, 0
    for i, n in enumerate(sizes):
        first = z + (shifts[i - 1] if keep == "upper" and i else 0)
        last = z + n - 1 - (shifts[i] if keep == "lower" and i < len(shifts) else 0)
        rows.append((first, last, out - first))
        out += last - first + 1
        z += n
    move = F.lit(None).cast("int")
    for first, last, d in reversed(rows):
        move = F.when(F.col("z").between(first, last), F.lit(d)).otherwise(move)
    return vol.withColumn("__d", move).where("__d is not null").withColumn("z", F.col("z") + F.col("__d")).drop("__d")


def match_scores(top: DataFrame, bottom: DataFrame, top_height: int, overlap: int, area: int, shifts: tuple[int, int]) -> DataFrame:
    """Score of each candidate shift of two overlapping scans: mean squared difference of the slices that meet.

    Slices of ``top`` count up to ``top_height``; a shift s below ``overlap`` lays the last s slices of it on the
    first s of ``bottom``, a larger one its last ``overlap`` slices on those of ``bottom`` from s - overlap on.
    """
    s = F.explode(F.sequence(F.lit(shifts[0]), F.lit(shifts[1]))).alias("shift")
    n = F.least(F.col("shift"), F.lit(overlap))
    a = top.where(F.col("z") >= top_height - overlap).select("*", s).where(F.col("z") >= top_height - n)
    a = a.select("shift", (F.col("z") - (top_height - n) + F.greatest(F.lit(0), F.col("shift") - overlap)).cast("int").alias("z"), "y", "x", F.col("v").cast("double").alias("a"))
    d = a.join(bottom.select("z", "y", "x", F.col("v").cast("double").alias("b")), ZYX)
    diff = (F.col("a") - F.col("b")) / (F.least(F.col("shift"), F.lit(overlap)) * F.lit(float(area)))
    return d.groupBy("shift").agg(F.sum(diff * diff).alias("score"))


def best_shift(scores: DataFrame, first: int = 2) -> DataFrame:
    """The shift with the least score, the smallest of equals, and its index in a list that starts at ``first``."""
    return scores.agg(F.min(F.struct("score", "shift")).alias("m")).select(F.col("m.shift").alias("shift"), (F.col("m.shift") - first).alias("ref_index"))


def match_volume(top: DataFrame, bottom: DataFrame, overlap: int, region: int, area: int) -> DataFrame:
    """(shift): where the last ``overlap`` slices of ``top``, numbered from 0, lie in ``bottom``.

    Of the first ``region`` starts in ``bottom`` the one with the least root of the summed squared differences by
    ``area``, the first of equals, and ``overlap`` more.
    """
    s = F.explode(F.sequence(F.lit(0), F.lit(region - 1))).alias("start")
    moved = top.select("*", s).select("start", (F.col("z") + F.col("start")).alias("z"), "y", "x", F.col("v").cast("double").alias("a"))
    met = moved.join(bottom.select("z", "y", "x", F.col("v").cast("double").alias("b")), ZYX)
    d = F.col("a") - F.col("b")
    scores = met.groupBy("start").agg(F.sqrt(F.sum(d * d) / area).alias("score"))
    return scores.agg(F.min(F.struct("score", "start")).alias("m")).select((F.col("m.start") + overlap).cast("int").alias("shift"))


def common_size(shapes: list[Shape], multiple: int = 32) -> tuple[int, int]:
    """Lines and columns that all scans have, as multiples of a number."""
    return tuple(min(s[k] for s in shapes) // multiple * multiple for k in (1, 2))


def crop_centre(vol: DataFrame, shape: Shape, size: tuple[int, int]) -> DataFrame:
    """The middle ``size`` lines and columns of every slice, numbered from 0."""
    for c, n, m in (("y", shape[1], size[0]), ("x", shape[2], size[1])):
        low = n // 2 - m // 2
        vol = vol.where(F.col(c).between(low, low + m - 1)).withColumn(c, (F.col(c) - low).cast("int"))
    return vol
