"""Changes of scale and sampling at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.scalar import cylinder, dbl
from voxelith.operators.voxels import ZYX

Shape = tuple[int, int, int]


def downsample(vol: DataFrame, factor: int, shape: Shape, masked: bool = True) -> DataFrame:
    """Mean of factor^3 voxels, truncated, within the cylinder of the result; an incomplete rim is dropped."""
    small = tuple(n // factor for n in shape)
    keys = [F.expr(f"cast({c} div {factor} as int)").alias(c) for c in ZYX]
    out = vol.groupBy(*keys).agg(F.expr(f"cast(sum(cast(v as bigint)) div {factor**3} as int)").alias("v"))
    inside = (F.col("z") < small[0]) & (F.col("y") < small[1]) & (F.col("x") < small[2])
    out = out.where(inside & (F.col("v") > 0))
    return out.where(cylinder(F.col("y"), F.col("x"), small[1], small[2], inclusive=True)) if masked else out


def pyramid(vol: DataFrame, levels: int, shape: Shape) -> dict[int, DataFrame]:
    """Scales 2, 4, ... each from the one before, truncated at every level."""
    out, scale = {}, 1
    for _ in range(levels):
        vol, shape, scale = downsample(vol, 2, shape), tuple(n // 2 for n in shape), scale * 2
        out[scale] = vol
    return out


def upsample(field: DataFrame, factor: int, shape: Shape, last: int | None = None) -> DataFrame:
    """Each voxel as a block; the last layer in z, that of the last whole block by default, also fills the remainder."""
    nz = shape[0]
    last = (nz // factor) - 1 if last is None else last
    z1 = F.when(F.col("z") == last, F.lit(nz - 1)).otherwise(F.col("z") * factor + factor - 1)
    out = field.where(F.col("z") <= last).withColumn("__z", F.explode(F.sequence(F.col("z") * factor, z1)))
    for c, n in (("y", shape[1]), ("x", shape[2])):
        out = out.withColumn(f"__{c}", F.explode(F.sequence(F.col(c) * factor, F.least(F.lit(n - 1), F.col(c) * factor + factor - 1))))
    return out.drop(*ZYX).withColumnsRenamed({f"__{c}": c for c in ZYX})


def _corner(c: str, n: int) -> Column:
    """The two voxels around a position and their weights; the nearest alone within half a voxel of the border."""
    p = F.col(c)
    lo = F.floor(p - 0.5)
    frac = (p - 0.5) - lo
    near = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(p))).cast("int")
    two = F.array(F.struct(lo.cast("int").alias("i"), (1.0 - frac).alias("w")), F.struct((lo + 1).cast("int").alias("i"), frac.alias("w")))
    return F.when((p >= 0.5) & (p <= n - 0.5), two).otherwise(F.array(F.struct(near.alias("i"), F.lit(1.0).alias("w"))))


def trilinear(points: DataFrame, vol: DataFrame, shape: Shape, key: list[str]) -> DataFrame:
    """Value at points (pz, py, px in voxels, voxel i spanning i to i + 1): up to eight corners joined and summed."""
    rows = points
    for c, n in zip(ZYX, shape, strict=True):
        rows = rows.withColumn(f"__{c}", F.explode(_corner(f"p{c}", n))).withColumn(c, F.least(F.lit(n - 1), F.col(f"__{c}.i")))
    rows = rows.withColumn("__w", F.col("__z.w") * F.col("__y.w") * F.col("__x.w")).where(F.col("__w") > 0)
    hit = rows.join(vol.select(*ZYX, dbl(F.col("v")).alias("__v")), ZYX, "left")
    return hit.groupBy(*key).agg(F.sum(F.col("__w") * F.coalesce("__v", F.lit(0.0))).alias("value"))


def sample_plane(vol: DataFrame, shape: Shape, centre, u, v, bounds: tuple[float, float, float, float], size: tuple[int, int], voxel: float = 1.0) -> DataFrame:
    """(i, j, value): the plane centre + u U + v V (x, y, z order, in units of ``voxel``), rounded; 0 outside.

    Values are rounded to six digits first, so that the order of a sum decides no tie.
    """
    du, dv = (bounds[1] - bounds[0]) / size[0], (bounds[3] - bounds[2]) / size[1]
    grid = vol.sparkSession.range(size[0] * size[1]).select(F.expr(f"cast(id div {size[1]} as int)").alias("i"), F.expr(f"cast(id % {size[1]} as int)").alias("j"))
    a, b = bounds[0] + F.col("i") * du, bounds[2] + F.col("j") * dv
    points = grid.select("*", *[((float(centre[k]) + a * float(u[k]) + b * float(v[k])) / voxel).alias(f"p{c}") for k, c in enumerate("xyz")])
    inside = F.lit(True)
    for c, n in zip(ZYX, shape, strict=True):
        inside = inside & (F.col(f"p{c}") >= 0.5) & (F.col(f"p{c}") <= n - 0.5)
    found = trilinear(points.where(inside), vol, shape, ["i", "j"])
    return grid.join(found, ["i", "j"], "left").select("i", "j", F.round(F.round(F.coalesce("value", F.lit(0.0)), 6)).alias("value"))


def bilinear(points: DataFrame, image: DataFrame, key: list[str], ref_compat: bool = False, half: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Value of an image (y, x, v) at points (py, px) with voxel centres at whole numbers, or with ``half`` half a voxel on.

    ``ref_compat`` swaps the two right-hand taps; ``by`` names further columns that points and images share (a slice).
    """
    off = 0.5 if half else 0.0
    py, px = F.col("py") - off, F.col("px") - off
    y0, x0 = F.floor(py).cast("int"), F.floor(px).cast("int")
    fy, fx = py - F.floor(py), px - F.floor(px)
    right = [(1, 0), (0, 1)] if ref_compat else [(0, 1), (1, 0)]
    taps = [(0, (1 - fy) * (1 - fx), 0), (1, fy * (1 - fx), 0), (right[0][0], (1 - fy) * fx, 1), (right[0][1], fy * fx, 1)]
    four = F.array(*[F.struct((y0 + dy).alias("y"), (x0 + dx).alias("x"), w.alias("w")) for dy, w, dx in taps])
    rows = points.withColumn("t", F.explode(four)).select("*", "t.*").drop("t")
    hit = rows.join(image.select(*by, "y", "x", dbl(F.col("v")).alias("__v")), [*by, "y", "x"], "left")
    return hit.groupBy(*key).agg(F.sum(F.col("w") * F.coalesce("__v", F.lit(0.0))).alias("value"))


def cart_to_polar(image: DataFrame, centre: tuple[float, float], radii: int, angles: int, inner: float = 0.0, outer: float | None = None, half: bool = False, ref_compat: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(r, theta, value) of an image on a polar grid from the radius ``inner`` up to ``outer``, one voxel a step by default; with ``by`` of each of several images."""
    grid = image.sparkSession.range(radii * angles).select(F.expr(f"cast(id div {angles} as int)").alias("r"), F.expr(f"cast(id % {angles} as int)").alias("theta"))
    if by:
        grid = image.select(*by).distinct().crossJoin(F.broadcast(grid))  # radii x angles rows
    step = 1.0 if outer is None else (outer - inner) / radii
    t, r = F.col("theta") * (2.0 * 3.141592653589793 / angles), F.col("r") * step + inner
    points = grid.select("*", (F.lit(centre[0]) + r * F.sin(t)).alias("py"), (F.lit(centre[1]) + r * F.cos(t)).alias("px"))
    return bilinear(points, image, [*by, "r", "theta"], ref_compat, half, by)


def polar_to_cart(polar: DataFrame, shape: tuple[int, int], centre: tuple[float, float], radii: int, angles: int) -> DataFrame:
    """(y, x, value) from (r, theta, value); absent where the radius is out of range."""
    ny, nx = shape
    grid = polar.sparkSession.range(ny * nx).select(F.expr(f"cast(id div {nx} as int)").alias("iy"), F.expr(f"cast(id % {nx} as int)").alias("ix"))
    dy, dx = F.col("iy") - centre[0], F.col("ix") - centre[1]
    points = grid.select("*", F.sqrt(dy * dy + dx * dx).alias("py"), (F.pmod(F.atan2(dy, dx), F.lit(2.0 * 3.141592653589793)) * (angles / (2.0 * 3.141592653589793))).alias("px"))
    wrapped = polar.select(F.col("r").alias("y"), F.col("theta").alias("x"), F.col("value").alias("v"))
    wrapped = wrapped.union(wrapped.where("x = 0").withColumn("x", F.lit(angles)))
    return bilinear(points.where(F.col("py") < radii - 1), wrapped, ["iy", "ix"]).select(F.col("iy").alias("y"), F.col("ix").alias("x"), "value")


def field_at_centres(vol: DataFrame, field: DataFrame, shape: Shape, coarse: Shape) -> DataFrame:
    """(z, y, x, v, f): a coarser field sampled trilinearly at the centre of each voxel."""
    at = [((F.col(c) + 0.5) * (m / n)).alias(f"p{c}") for c, n, m in zip(ZYX, shape, coarse, strict=True)]
    points = vol.select(*[F.col(c).alias(f"i{c}") for c in ZYX], F.col("v").alias("iv"), *at)
    found = trilinear(points, field.withColumnRenamed("f", "v"), coarse, ["iz", "iy", "ix", "iv"])
    return found.select(*[F.col(f"i{c}").alias(c) for c in ZYX], F.col("iv").alias("v"), F.col("value").alias("f"))


def sampled_field_histogram(vol: DataFrame, field: DataFrame, shape: Shape, coarse: Shape, vrange, frange, bins: tuple[int, int]) -> DataFrame:
    """Counts by bin of the field, sampled trilinearly at voxel centres, and of the value."""
    from voxelith.functions.scalar import value_bin
    from voxelith.operators.voxels import value_range

    at = [((F.col(c) + 0.5) * (m / n)).alias(f"p{c}") for c, n, m in zip(ZYX, shape, coarse, strict=True)]
    points = value_range(vol, *vrange).select(*[F.col(c).alias(f"i{c}") for c in ZYX], F.col("v").alias("iv"), *at)
    found = trilinear(points, field.withColumnRenamed("f", "v"), coarse, ["iz", "iy", "ix", "iv"])
    kept = found.withColumn("f", F.round("value", 6)).where(F.col("f").between(*frange))
    return kept.groupBy(value_bin(F.col("f"), *frange, bins[0]).alias("row"), value_bin(F.col("iv"), *vrange, bins[1]).alias("bin")).agg(F.count("*").alias("n"))
