"""Filters, packing and mask algebra on voxel tables (z, y, x, v); an absent row is a zero voxel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.scalar import cylinder, dbl, in_box, to_full_range

ZYX = ["z", "y", "x"]


def threshold(vol: DataFrame, t: float) -> DataFrame:
    return vol.where(F.col("v") > t)


def value_range(vol: DataFrame, lo: float, hi: float) -> DataFrame:
    return vol.where(F.col("v").between(lo, hi) & (F.col("v") != 0))


def bounding_box(vol: DataFrame, box: tuple[int, int, int, int, int, int]) -> DataFrame:
    return vol.where(in_box(F.col("z"), F.col("y"), F.col("x"), box))


def membership(vol: DataFrame, ids: DataFrame, column: str = "label") -> DataFrame:
    """1 where the column's value is among ``ids`` (a table with that column), else 0."""
    marked = ids.select(column).distinct().withColumn("__in", F.lit(1))
    return vol.join(marked, column, "left").withColumn("member", F.coalesce("__in", F.lit(0))).drop("__in")


def pack_bits(mask: DataFrame) -> DataFrame:
    """32 voxels adjacent in x to a word, the lowest x in the highest bit; words without voxels are absent."""
    bit = F.expr("shiftleft(1L, 31 - x % 32)")
    return mask.groupBy("z", "y", F.expr("cast(x div 32 as int)").alias("xw")).agg(F.bit_or(bit).alias("w"))


def unpack_bits(words: DataFrame) -> DataFrame:
    bits = F.expr("filter(sequence(0, 31), i -> shiftright(w, 31 - i) & 1L = 1L)")
    return words.select("z", "y", "xw", F.explode(bits).alias("i")).select("z", "y", F.expr("xw * 32 + i").cast("int").alias("x"))


def packed_slice(words: DataFrame, box: tuple[int, int, int, int, int, int]) -> DataFrame:
    """Words in a closed box aligned to words in x, moved to its corner."""
    z0, z1, y0, y1, x0, x1 = box
    if x0 % 32 or (x1 + 1) % 32:
        raise ValueError("x must be aligned to words")
    inside = F.col("z").between(z0, z1) & F.col("y").between(y0, y1) & F.col("xw").between(x0 // 32, x1 // 32)
    return words.where(inside).select((F.col("z") - z0).alias("z"), (F.col("y") - y0).alias("y"), (F.col("xw") - x0 // 32).alias("xw"), "w")


def packed_and(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.alias("a").join(b.alias("b"), ["z", "y", "xw"])
    return both.select("z", "y", "xw", F.expr("a.w & b.w").alias("w")).where("w <> 0")


def packed_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.alias("a").join(b.alias("b"), ["z", "y", "xw"], "left")
    return both.select("z", "y", "xw", F.expr("a.w & (4294967295L ^ coalesce(b.w, 0L))").alias("w")).where("w <> 0")


def packed_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("z", "y", "xw").agg(F.bit_or("w").alias("w"))


def packed_dilate(words: DataFrame, radius: int, shape: tuple[int, int, int]) -> DataFrame:
    """Words of all voxels within ``radius``, at most 31, of the mask's: whole words are smeared by shifts along x.

    A word reaches its own place and the two beside it; each run (dz, dy) of the sphere shifts by its half-width.
    """
    from voxelith.operators.stencil import sphere_runs

    if radius > 31:
        raise ValueError("words reach 31 voxels at most")
    nz, ny, nx = shape
    last, full = (nx - 1) // 32, 0xFFFFFFFF
    runs = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dz, dy, k in sphere_runs(radius)])
    moved = words.select("*", F.explode(runs).alias("o")).select((F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), "xw", "w", F.col("o.k").alias("k"))
    moved = moved.where(F.col("z").between(0, nz - 1) & F.col("y").between(0, ny - 1))
    # what stays in the word, and what runs over into the words after and before it
    steps = "transform(sequence(0, k), i -> {})"
    own = F.expr(f"aggregate({steps.format('(shiftrightunsigned(w, i) | shiftleft(w, i)) & 4294967295L')}, 0L, (a, b) -> a | b)")
    after = F.expr(f"aggregate({steps.format('shiftleft(w, 32 - i) & 4294967295L')}, 0L, (a, b) -> a | b)")
    before = F.expr(f"aggregate({steps.format('shiftrightunsigned(w, 32 - i)')}, 0L, (a, b) -> a | b)")
    parts = F.array(*[F.struct((F.col("xw") + d).cast("int").alias("xw"), c.alias("w")) for d, c in ((0, own), (1, after), (-1, before))])
    spread = moved.select("z", "y", F.explode(parts).alias("p")).select("z", "y", "p.xw", "p.w").where(f"w <> 0 and xw between 0 and {last}")
    edge = full ^ ((1 << (32 * (last + 1) - nx)) - 1)  # bits of the last word that lie in the volume
    met = spread.groupBy("z", "y", "xw").agg(F.bit_or("w").alias("w"))
    return met.select("z", "y", "xw", F.when(F.col("xw") == last, F.col("w").bitwiseAND(F.lit(edge))).otherwise(F.col("w")).alias("w")).where("w <> 0")


def packed_complement(words: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Words of the voxels that the mask leaves out: all words of the volume are made, a 32nd of its voxels."""
    nz, ny, nx = shape
    n = (nx + 31) // 32
    edge = 0xFFFFFFFF ^ ((1 << (32 * n - nx)) - 1)
    every = words.sparkSession.range(nz * ny * n).select(F.expr(f"cast(id div {ny * n} as int)").alias("z"), F.expr(f"cast(id div {n} % {ny} as int)").alias("y"), F.expr(f"cast(id % {n} as int)").alias("xw"))
    full = every.withColumn("w", F.when(F.col("xw") == n - 1, F.lit(edge).cast("long")).otherwise(F.lit(0xFFFFFFFF).cast("long")))
    return packed_and_not(full, words)


def packed_erode(words: DataFrame, radius: int, shape: tuple[int, int, int]) -> DataFrame:
    """Words of the mask's voxels whose neighbours within ``radius`` are all in it; what lies outside the volume counts as in."""
    return packed_and_not(words, packed_dilate(packed_complement(words, shape), radius, shape))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*ZYX), ZYX, "left_semi")


def mask_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*ZYX), ZYX, "left_anti")


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*ZYX).union(b.select(*ZYX)).distinct()


def projection(axis: tuple[float, float, float], centre: tuple[float, float, float]) -> Column:
    """Dot product of (x, y, z) - centre with an axis, both in x, y, z order."""
    terms = [(dbl(F.col(c)) - float(m)) * float(a) for c, a, m in zip("xyz", axis, centre, strict=True)]
    return terms[0] + terms[1] + terms[2]


def zero_outside(vol: DataFrame, centre, axes, lows, highs) -> DataFrame:
    """Voxels whose projections on all three axes lie within their bounds; the others become zero, that is, absent."""
    keep = F.lit(True)
    for axis, lo, hi in zip(axes, lows, highs, strict=True):
        keep = keep & projection(axis, centre).between(float(lo), float(hi))
    return vol.where(keep)


def row_normalize(hist: DataFrame, mode: str = "one") -> DataFrame:
    """n / (1 + row maximum), or n / row maximum where that isn't zero."""
    top = F.max("n").over(Window.partitionBy("row"))
    by = top + 1 if mode == "one" else top + F.when(top == 0, 1).otherwise(0)
    return hist.withColumn("share", dbl(F.col("n")) / by)


def subsample(hist: DataFrame, step: int) -> DataFrame:
    return hist.where((F.col("row") % step == 0) & (F.col("bin") % step == 0)).select((F.col("row") / step).cast("int").alias("row"), (F.col("bin") / step).cast("int").alias("bin"), "n")


def value_bounds(vol: DataFrame, column: str = "v") -> DataFrame:
    """Least and greatest value, and the least with zero counted as one."""
    return vol.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.greatest(F.min(column), F.lit(1)).alias("masked_lo"))


def combine_fields(gauss: DataFrame, edt: DataFrame, ny: int, nx: int) -> DataFrame:
    """g / max g - e / max e, moved to zero, scaled to one, within the cylinder, as 16 bits: three passes.

    A field that is zero everywhere stays zero; fields that share no voxel give no rows.
    """
    both = gauss.select(*ZYX, F.col("f").alias("g")).join(edt.select(*ZYX, F.col("f").alias("e")), ZYX)
    gm, em = both.agg(F.max("g"), F.max("e")).first()
    raw = both.withColumn("c", dbl(F.col("g")) / float(gm or 1) - dbl(F.col("e")) / float(em or 1))
    lo, hi = (x or 0.0 for x in raw.agg(F.min("c"), F.max("c")).first())
    moved = (F.col("c") + abs(lo)) / (hi + abs(lo) or 1.0)
    return raw.where(cylinder(F.col("y"), F.col("x"), ny, nx)).select(*ZYX, to_full_range(moved, 0.0, 1.0).alias("f"))


def subvolume_of(z: Column, sizes: list[int]) -> Column:
    """Number of the subvolume that a slice belongs to, from the subvolumes' heights."""
    out, start = F.lit(None).cast("int"), sum(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        end, start = start, start - sizes[i]
        out = F.when((z >= start) & (z < end), F.lit(i)).otherwise(out)
    return out


def middle_planes(vol: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The three planes through the middle, marked by axis; a voxel may lie in several."""
    hits = [F.when(F.col(a) == n // 2, F.lit(a)) for a, n in zip(ZYX, shape, strict=True)]
    return vol.withColumn("axis", F.explode(F.array_compact(F.array(*hits))))
