"""Neighbourhood operators: morphology with spheres and boxes, separable convolution, diffusion.

A neighbourhood is never a band join. A sphere is a set of runs along x, one for each (dz, dy): masks are taken as
intervals along x, grown by the run's half-width, merged and expanded again, so a sphere of radius r costs about
pi r^2 rows an interval, not 4/3 pi r^3 rows a voxel. Boxes and Gaussians go axis by axis.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.operators.histogram import kernel
from voxelith.operators.voxels import ZYX, mask_and_not

Shape = tuple[int, int, int]


def sphere_runs(radius: float) -> list[tuple[int, int, int]]:
    """(dz, dy, half-width in x) of the voxels within ``radius`` of the origin."""
    r = int(radius)
    return [(dz, dy, math.isqrt(int(radius * radius) - dz * dz - dy * dy)) for dz in range(-r, r + 1) for dy in range(-r, r + 1) if dz * dz + dy * dy <= radius * radius]


def ball(n: int) -> list[tuple[int, int, int]]:
    """Voxels of an n^3 cube in the unit ball over linspace(-1, 1)."""
    c = [2 * i / max(1, n - 1) - 1 for i in range(n)]
    return [(z, y, x) for z in range(n) for y in range(n) for x in range(n) if c[z] ** 2 + c[y] ** 2 + c[x] ** 2 <= 1 + 1e-12]


def intervals(mask: DataFrame) -> DataFrame:
    """Maximal runs (z, y, a, b) of a mask along x."""
    w = Window.partitionBy("z", "y").orderBy("x")
    groups = mask.select(*ZYX).distinct().withColumn("g", F.col("x") - F.row_number().over(w))
    return groups.groupBy("z", "y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("g")


def _expand(runs: DataFrame) -> DataFrame:
    """Voxels of intervals (z, y, a, b) that may overlap, each once."""
    w = Window.partitionBy("z", "y").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = runs.withColumn("lo", F.greatest("a", F.coalesce(F.max("b").over(w) + 1, F.col("a")))).where("lo <= b")
    return fresh.select("z", "y", F.explode(F.sequence("lo", "b")).alias("x"))


def dilate(mask: DataFrame, radius: float, shape: Shape) -> DataFrame:
    """All voxels of the volume within ``radius`` of the mask."""
    return _expand(_grown(intervals(mask), radius, shape))


def _grown(found: DataFrame, radius: float, shape: Shape) -> DataFrame:
    """Intervals moved and widened by each run of a sphere, within the volume."""
    nz, ny, nx = shape
    runs = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dz, dy, w in sphere_runs(radius)])
    moved = found.select("*", F.explode(runs).alias("o"))
    moved = moved.select((F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), F.greatest(F.lit(0), F.col("a") - F.col("o.w")).alias("a"), F.least(F.lit(nx - 1), F.col("b") + F.col("o.w")).alias("b"))
    return moved.where(F.col("z").between(0, nz - 1) & F.col("y").between(0, ny - 1))


def gaps(mask: DataFrame, shape: Shape, lines: int | None = None) -> DataFrame:
    """Maximal runs (z, y, a, b) along x that the mask leaves out of the volume's first ``lines`` lines (z, y), all by default."""
    nz, ny, nx = shape
    count = max(nz * ny, lines or 0)
    inside = F.col("z").between(0, (count - 1) // ny) & (F.col("z") * ny + F.col("y") < count) & F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)
    every = mask.sparkSession.range(count).select(F.expr(f"cast(id div {ny} as int)").alias("z"), F.expr(f"cast(id % {ny} as int)").alias("y"))
    ends = [every.select("z", "y", F.lit(k).alias("a"), F.lit(k).alias("b")) for k in (-1, nx)]
    w = Window.partitionBy("z", "y").orderBy("a")
    runs = intervals(mask.where(inside)).union(ends[0]).union(ends[1]).withColumn("lo", F.lag("b").over(w) + 1)
    return runs.where("lo < a").select("z", "y", F.col("lo").alias("a"), (F.col("a") - 1).alias("b"))


def complement(mask: DataFrame, shape: Shape, lines: int | None = None) -> DataFrame:
    return gaps(mask, shape, lines).select("z", "y", F.explode(F.sequence("a", "b")).alias("x"))


def erode(mask: DataFrame, radius: float, shape: Shape, lines: int | None = None) -> DataFrame:
    """Voxels of the mask all of whose neighbours within ``radius`` are in it; what lies outside the volume counts as in.

    The gaps of the mask are grown, and what they leave of each line is the result: no dense volume is built. A
    volume whose last slice is incomplete has ``lines`` lines, beyond the complete slices of its shape; the mask's
    voxels outside the shape stay as they are.
    """
    nz, ny, nx = shape
    inside = F.col("z").between(0, nz - 1) & F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)
    grown = _grown(gaps(mask, shape, lines), radius, shape)
    held = mask.where(inside).select("z", "y").distinct()
    ends = held.select("z", "y", F.lit(nx).alias("a"), F.lit(nx).alias("b"))
    w = Window.partitionBy("z", "y").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    left = grown.union(ends).withColumn("lo", F.coalesce(F.max("b").over(w) + 1, F.lit(0))).where("lo < a")
    kept = left.select("z", "y", F.explode(F.sequence("lo", F.col("a") - 1)).alias("x"))
    return kept.union(mask.where(~inside).select(*ZYX).distinct())


def opened(mask: DataFrame, radius: float, shape: Shape, lines: int | None = None) -> DataFrame:
    return dilate(erode(mask, radius, shape, lines), radius, shape)


def closed(mask: DataFrame, radius: float, shape: Shape, lines: int | None = None) -> DataFrame:
    return erode(dilate(mask, radius, shape), radius, shape, lines)


def split_radius(radius: int, part: int = 16) -> list[int]:
    """A radius as passes of at most ``part``; composing spheres so only approximates the large one."""
    return [part] * (radius // part) + ([radius % part] if radius % part else [])


def morph(mask: DataFrame, radius: int, shape: Shape, how: str = "dilate", split: int | None = None) -> DataFrame:
    """Dilation or erosion, exact, or with ``split`` in passes of at most that radius."""
    step = {"dilate": dilate, "erode": erode}[how]
    for r in [radius] if split is None else split_radius(radius, split):
        mask = step(mask, r, shape)
    return mask


def dilate_box(mask: DataFrame, passes: int, shape: Shape, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """``passes`` steps of one voxel both ways along each axis."""
    for axis in axes:
        n = shape[ZYX.index(axis)]
        reach = F.explode(F.sequence(F.greatest(F.lit(0), F.col(axis) - passes), F.least(F.lit(n - 1), F.col(axis) + passes)))
        mask = mask.select(*[c for c in ZYX if c != axis], reach.alias(axis)).distinct().select(*ZYX)
    return mask


def dilate_cross(mask: DataFrame, passes: int, shape: Shape, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """``passes`` steps to face neighbours along ``axes``: all voxels within that many steps, bounded by the shape along ``axes``."""
    moves = []
    ranges = [range(-passes, passes + 1) if a in axes else (0,) for a in ZYX]
    for dz in ranges[0]:
        for dy in ranges[1]:
            for dx in ranges[2]:
                if abs(dz) + abs(dy) + abs(dx) == passes or abs(dz) + abs(dy) + abs(dx) < passes:
                    moves.append((dz, dy, dx))
    offsets = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(m, ZYX, strict=True)]) for m in moves])
    moved = mask.select(*ZYX).select("*", F.explode(offsets).alias("o")).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in ZYX])
    inside = F.lit(True)
    for c, n in zip(ZYX, shape, strict=True):
        inside = inside & F.col(c).between(0, n - 1) if c in axes else inside
    return moved.where(inside).distinct()


def erode_cross(mask: DataFrame, passes: int, shape: Shape, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    return mask_and_not(mask.select(*ZYX), dilate_cross(complement(mask, shape), passes, shape, axes))


def fill_holes(mask: DataFrame, shape: Shape) -> DataFrame:
    """The mask with all background that can't be reached from the volume's border."""
    from voxelith.operators.components import label_volume

    empty = label_volume(complement(mask, shape))
    edge = F.lit(False)
    for c, n in zip(ZYX, shape, strict=True):
        edge = edge | (F.col(c) == 0) | (F.col(c) == n - 1)
    outer = empty.where(edge).select("label").distinct()
    inner = empty.join(outer, "label", "left_anti").select(*ZYX)
    return mask.select(*ZYX).union(inner).distinct()


def convolve(field: DataFrame, weights: list[float], axis: str, shape: Shape, value: str = "f", lines: int = 64, source: DataFrame | None = None) -> DataFrame:
    """Correlation along one axis with a zero border; zero voxels are absent, and so are voxels that no weight reaches.

    A task's group is a strip of up to ``lines`` lines, so every voxel is shuffled once, whatever the number of
    weights. Voxels of ``source`` are set to one afterwards.
    """
    n, r = shape[ZYX.index(axis)], len(weights) // 2
    outer, inner = (c for c in ZYX if c != axis)
    rows = field.select(*ZYX, F.col(value).cast("double").alias("f"))
    if source is not None:
        rows = rows.union(source.select(*ZYX, F.lit(None).cast("double")))

    def run(pdf):
        own, line = np.unique(pdf[inner].to_numpy(), return_inverse=True)
        place, f = pdf[axis].to_numpy() + r, pdf["f"].to_numpy()
        given = ~np.isnan(f)
        held, near = np.zeros((len(own), n + 2 * r)), np.zeros((len(own), n + 2 * r + 1), np.int32)
        held[line[given], place[given]] = f[given]
        near[line[given], place[given] + 1] = 1
        near = near.cumsum(1)
        out = sum(w * held[:, k : k + n] for k, w in enumerate(weights))
        reached = near[:, 2 * r + 1 :] > near[:, :n]
        if not given.all():
            inside = ~given & (place >= r) & (place < n + r)
            out[line[inside], place[inside] - r] = 1.0
        i, p = np.nonzero(reached)
        cols = {outer: np.full(len(i), pdf[outer].iloc[0], np.int32), inner: own[i].astype(np.int32), axis: p.astype(np.int32)}
        return pd.DataFrame({**{c: cols[c] for c in ZYX}, "f": out[i, p]})

    strips = rows.where(F.col(axis).between(-r, n - 1 + r)).groupBy(outer, F.expr(f"{inner} div {lines}").alias("__strip"))
    return strips.applyInPandas(run, "z int, y int, x int, f double").withColumnRenamed("f", value)


def diffusion_step(field: DataFrame, source: DataFrame, weights: list[float], shape: Shape) -> DataFrame:
    """Three passes; the source within the volume is then set to one again."""
    for axis in ZYX:
        field = convolve(field, weights, axis, shape, source=source if axis == "x" else None)
    return field


def diffuse(mask: DataFrame, sigma: float, repetitions: int, shape: Shape, radius: int | None = None, every: int = 4) -> DataFrame:
    """Repeated diffusion of a mask, as 16-bit values; lineage is cut every few steps through the checkpoint folder."""
    w = kernel(sigma, radius)
    source = mask.select(*ZYX).distinct()
    field = source.withColumn("f", F.lit(1.0))
    for i in range(repetitions):
        field = diffusion_step(field, source, w, shape)
        if i % every == every - 1 and i + 1 < repetitions and field.sparkSession.conf.get("spark.checkpoint.dir", None):
            field = field.checkpoint()
    return field.select(*ZYX, F.floor(F.col("f") * 65535.0 + 1e-7).cast("int").alias("f"))


def diffuse_blocks(mask: DataFrame, sigma: float, repetitions: int, shape: Shape, radius: int | None = None, block: int = 64) -> DataFrame:
    """The same as ``diffuse`` in blocks with a halo: a step is one shuffle, of every voxel to the blocks it reaches.

    A group is a block of ``block`` voxels a side and the kernel's radius around it. Every step's field is stored.
    """
    w = kernel(sigma, radius)
    r = len(w) // 2
    span = block + 2 * r

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.array([pdf[f"__{c}"].iloc[0] for c in ZYX], np.int64) * block
        at = tuple(pdf[c].to_numpy() - low[i] + r for i, c in enumerate(ZYX))
        f = pdf["f"].to_numpy()
        given = ~np.isnan(f)
        held, near = np.zeros((span,) * 3), np.zeros((span,) * 3, bool)
        inner = tuple(a[given] for a in at)
        held[inner], near[inner] = f[given], True
        for axis in range(3):
            n = held.shape[axis] - 2 * r
            cut = lambda a, k, axis=axis, n=n: np.take(a, np.arange(k, k + n), axis)
            held = sum(x * cut(held, k) for k, x in enumerate(w))
            near = np.logical_or.reduce([cut(near, k) for k in range(2 * r + 1)])
        lit = tuple(a[~given] - r for a in at)
        own = np.all([(a >= 0) & (a < block) for a in lit], axis=0) if len(lit[0]) else np.zeros(0, bool)
        held[tuple(a[own] for a in lit)] = 1.0
        ends = [min(block, n - b) for n, b in zip(shape, low.tolist(), strict=True)]
        near[ends[0] :], near[:, ends[1] :], near[:, :, ends[2] :] = False, False, False
        p = np.nonzero(near)
        return pd.DataFrame({**{c: (p[i] + low[i]).astype(np.int32) for i, c in enumerate(ZYX)}, "f": held[p]})

    from voxelith.sources.scratch import kept

    inside = F.lit(True)
    for c, n in zip(ZYX, shape, strict=True):
        inside = inside & F.col(c).between(0, n - 1)
    source = mask.select(*ZYX).where(inside).distinct()
    field = source.withColumn("f", F.lit(1.0))
    for _ in range(repetitions):
        rows = field.union(source.withColumn("f", F.lit(None).cast("double")))
        for c, n in zip(ZYX, shape, strict=True):
            rows = rows.withColumn(f"__{c}", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - r) / block), F.floor(F.least(F.lit(n - 1), F.col(c) + r) / block))))
        field = kept(rows.groupBy("__z", "__y", "__x").applyInPandas(run, "z int, y int, x int, f double"), "diffusion")
    return field.select(*ZYX, F.floor(F.col("f") * 65535.0 + 1e-7).cast("int").alias("f"))


def local_threshold(plane: DataFrame, half: int, k: float = 0.2, r: float = 32768.0) -> DataFrame:
    """Adaptive threshold of each slice: mean (1 + k (sd / r - 1)) over a square of 2 half + 1, from sums along y and x."""
    sums = plane.select(*ZYX, F.col("v").cast("double").alias("s"), (F.col("v").cast("double") * F.col("v")).alias("q"), F.lit(1).alias("n"))
    for axis, others in (("x", ("z", "y")), ("y", ("z", "x"))):
        w = Window.partitionBy(*others).orderBy(axis).rangeBetween(-half, half)
        sums = sums.select(*ZYX, *[F.sum(c).over(w).alias(c) for c in ("s", "q", "n")])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return plane.join(sums.select(*ZYX, (mean * (1.0 + k * (sd / r - 1.0))).alias("t")), ZYX)
