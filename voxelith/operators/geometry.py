"""Moments, frames of reference and projections of voxel tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.scalar import affine, dbl
from voxelith.operators.voxels import projection

AXES = ("z", "y", "x")


def centre_of_mass(vol: DataFrame, weight: str = "v") -> DataFrame:
    w = dbl(F.col(weight))
    return vol.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"c{c}") for c in AXES])


def centres_of_mass(labels: DataFrame) -> DataFrame:
    """Mean position of each label but 0."""
    return labels.where("label <> 0").groupBy("label").agg(*[F.avg(c).alias(f"c{c}") for c in AXES], F.count("*").alias("n"))


PAIRS = tuple((a, b) for i, a in enumerate(AXES) for b in AXES[i:])
BLOCK = 64


def _tensor(rows: DataFrame, keys: list[str], c: dict[str, Column]) -> DataFrame:
    """The inertia tensor from sums of products of coordinates about the centre."""
    out = {"izz": c["yy"] + c["xx"], "iyy": c["zz"] + c["xx"], "ixx": c["zz"] + c["yy"], "izy": -c["zy"], "izx": -c["zx"], "iyx": -c["yx"]}
    return rows.select(*keys, *[v.alias(k) for k, v in out.items()])


def inertia(vol: DataFrame, weight: str = "v") -> DataFrame:
    """The inertia tensor about the centre of mass.

    Moments are taken within blocks, from each block's corner, and joined by the parallel-axis theorem over one row
    a block, so that no large numbers cancel however large the volume is.
    """
    w = dbl(F.col(weight))
    cut = vol.select(w.alias("w"), *[F.expr(f"cast({a} div {BLOCK} as int)").alias(f"b{a}") for a in AXES], *[F.expr(f"cast({a} % {BLOCK} as double)").alias(a) for a in AXES])
    sums = [F.sum("w").alias("m")] + [F.sum(F.col("w") * F.col(a)).alias(f"s{a}") for a in AXES] + [F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in PAIRS]
    blocks = cut.groupBy("bz", "by", "bx").agg(*sums).where("m <> 0")
    blocks = blocks.select("m", *[(F.col(f"s{a}") / F.col("m") + F.col(f"b{a}") * BLOCK).alias(f"c{a}") for a in AXES], *[(F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("m")).alias(f"p{a}{b}") for a, b in PAIRS])
    centre = blocks.agg(*[(F.sum(F.col("m") * F.col(f"c{a}")) / F.sum("m")).alias(f"g{a}") for a in AXES])
    about = blocks.crossJoin(F.broadcast(centre))  # one row
    far = {a: F.col(f"c{a}") - F.col(f"g{a}") for a in AXES}
    total = about.agg(*[F.sum(F.col(f"p{a}{b}") + F.col("m") * far[a] * far[b]).alias(a + b) for a, b in PAIRS])
    return _tensor(total, [], {a + b: F.col(a + b) for a, b in PAIRS})


def inertias(labels: DataFrame) -> DataFrame:
    """The same for each label but 0, with unit weights: covariances, which Spark merges about their means."""
    sums = [(F.covar_pop(dbl(F.col(a)), dbl(F.col(b))) * F.count("*")).alias(a + b) for a, b in PAIRS]
    return _tensor(labels.where("label <> 0").groupBy("label").agg(*sums), ["label"], {a + b: F.col(a + b) for a, b in PAIRS})


def eigenvalues(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Eigenvalues of symmetric matrices (izz, iyy, ixx, izy, izx, iyx), ascending, by the trigonometric formula."""
    a, b, c, d, e, f = (F.col(k) for k in ("izz", "iyy", "ixx", "izy", "izx", "iyx"))
    off = d * d + e * e + f * f
    q = (a + b + c) / 3.0
    p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2.0 * off) / 6.0)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / F.nullif(2.0 * p * p * p, F.lit(0.0))))
    phi = F.acos(F.coalesce(r, F.lit(1.0))) / 3.0
    hi, lo = q + 2.0 * p * F.cos(phi), q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)
    return rows.select(*keys, lo.alias("e1"), (3.0 * q - hi - lo).alias("e2"), hi.alias("e3"))


def eigen_frame(tensor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and unit eigenvectors as rows of one 3 x 3 matrix."""
    values, vectors = np.linalg.eigh(np.asarray(tensor, float))
    return values, vectors.T


def axis_frame(vectors: np.ndarray) -> np.ndarray:
    """Rows u, v, w: the eigenvectors whose largest component is along z, y and x, each pointing up its axis."""
    left, out = [*np.asarray(vectors, float)], []
    for axis in range(3):
        k = int(np.argmax([abs(v[axis]) for v in left]))
        v = left.pop(k)
        out.append(v if v[axis] >= 0 else -v)
    return np.array(out)


def gram_schmidt(u, v, w) -> np.ndarray:
    """Orthonormal rows spanning the same nested spaces."""
    rows: list[np.ndarray] = []
    for x in (u, v, w):
        x = np.asarray(x, float)
        for r in rows:
            x = x - (x @ r) * r
        rows.append(x / np.linalg.norm(x))
    return np.array(rows)


def linear(matrix) -> np.ndarray:
    """A 3 x 3 matrix as a homogeneous one."""
    out = np.eye(4)
    out[:3, :3] = matrix
    return out


def translation(shift) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = shift
    return out


def to_implant_frame(centre, axes, w0, centre_prime, axes_prime) -> np.ndarray:
    """zyx to U'V'W': move to the centre, turn to u, v, w, move by (0, 0, w0), to the circle's centre, turn again."""
    steps = [translation(-np.asarray(centre, float)), linear(axes), translation([0, 0, -w0]), translation(-np.asarray(centre_prime, float)), linear(axes_prime)]
    out = np.eye(4)
    for s in steps:
        out = s @ out
    return out


def transform(points: DataFrame, matrix, names: tuple[str, str, str] = ("u", "v_", "w")) -> DataFrame:
    """Coordinates under a homogeneous matrix, whose entries are literals of the plan."""
    cols = affine(F.col("z"), F.col("y"), F.col("x"), matrix)
    return points.select("*", *[c.alias(n) for c, n in zip(cols, names, strict=True)])


def circle_centre(rows: DataFrame) -> DataFrame:
    """Centre and radius of the circle through (x1, y1), (x2, y2), (x3, y3); null for points on a line."""
    x1, y1, x2, y2, x3, y3 = (F.col(c) for c in ("x1", "y1", "x2", "y2", "x3", "y3"))
    s1, s2, s3 = x1 * x1 + y1 * y1, x2 * x2 + y2 * y2, x3 * x3 + y3 * y3
    d = F.nullif(2.0 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2)), F.lit(0.0))
    cx, cy = (s1 * (y2 - y3) + s2 * (y3 - y1) + s3 * (y1 - y2)) / d, (s1 * (x3 - x2) + s2 * (x1 - x3) + s3 * (x2 - x1)) / d
    return rows.select("*", cx.alias("cx"), cy.alias("cy")).withColumn("radius", F.sqrt((F.col("x1") - F.col("cx")) * (F.col("x1") - F.col("cx")) + (F.col("y1") - F.col("cy")) * (F.col("y1") - F.col("cy"))))


def integrate_axes(vol: DataFrame, origin, v_axis, w_axis, v_min: float, w_min: float, shape: tuple[int, int]) -> DataFrame:
    """Sums of voxels over a plane: (i, j) are rounded projections on two axes; those outside the image drop."""
    i = F.round(projection(v_axis, origin) - v_min).cast("int")
    j = F.round(projection(w_axis, origin) - w_min).cast("int")
    kept = vol.select(i.alias("i"), j.alias("j"), "v").where(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1))
    return kept.groupBy("i", "j").agg(F.sum("v").alias("total"))


def outside_ellipsoid(labels: DataFrame, params: DataFrame) -> DataFrame:
    """Of each label the voxels outside its ellipsoid; ``params`` (one row a label): cz, cy, cx, a, b, c."""
    joined = labels.join(params, "label")
    r = sum(((dbl(F.col(p)) - F.col(f"c{p}")) / F.col(h)) * ((dbl(F.col(p)) - F.col(f"c{p}")) / F.col(h)) for p, h in zip(AXES, "abc", strict=True))
    return joined.groupBy("label").agg(F.count_if(r >= 1.0).alias("outside"), F.count("*").alias("n"))


def front_mask(points: DataFrame, w_min: float) -> DataFrame:
    """Points (solid, w): in front where they aren't solid and lie beyond ``w_min``."""
    return points.withColumn("front", F.when(F.col("solid") > 0, 0).otherwise((F.col("w") > w_min).cast("int")))


def front_back_masks(points: DataFrame, shell: float = 0.7, far: float = 50.0) -> DataFrame:
    """Solid, front and back marks of points (z, w, r, m): one global and one per-slice maximum.

    w is counted from the least of the mask; r is the distance from the implant's axis.
    """
    w0 = points.where("m > 0").agg(F.min("w")).first()[0] or 0.0
    rmax = F.max(F.when(F.col("m") > 0, F.col("r"))).over(Window.partitionBy("z"))
    rows = points.withColumn("rmax", F.coalesce(rmax, F.lit(0.0))).withColumn("w", F.col("w") - float(w0))
    inner = F.col("r") < shell * F.col("rmax")
    solid = ((F.col("m") > 0) & ~inner) | (F.col("m") > 0) | (inner & (F.col("w") >= 0))
    rows = rows.withColumn("solid", solid)
    return rows.withColumn("back", F.col("w") < 0).withColumn("front", (F.col("w") > far) & ~F.col("solid"))


def segment_radii(points: DataFrame, u_min: float, u_max: float, segments: int) -> DataFrame:
    """Of each of ``segments`` parts of the axis the greatest squared distance of mask points (u, v_, w), and angles."""
    i = F.floor((F.col("u") - u_min) / (u_max - u_min) * (segments - 1)).cast("int")
    kept = points.where(F.col("u").between(u_min, u_max)).withColumn("segment", i)
    theta = F.atan2("v_", "w")
    return kept.groupBy("segment").agg(F.max(F.col("v_") * F.col("v_") + F.col("w") * F.col("w")).alias("r2"), F.min(theta).alias("theta_min"), F.max(theta).alias("theta_max"))


def fill_solid(points: DataFrame, radii: DataFrame, u_min: float, u_max: float, segments: int, w_min: float, fraction: float) -> DataFrame:
    """Points (u, v_, w, m) that are solid: in a segment, beyond ``w_min``, in the mask or within its radius.

    ``radii`` has one row a segment and is sent to all tasks.
    """
    i = F.floor((F.col("u") - u_min) / (u_max - u_min) * (segments - 1)).cast("int")
    joined = points.where(F.col("u").between(u_min, u_max)).withColumn("segment", i).join(F.broadcast(radii.select("segment", "r2")), "segment")
    r2 = F.col("v_") * F.col("v_") + F.col("w") * F.col("w")
    return joined.where((F.col("w") >= w_min) & ((F.col("m") > 0) | (r2 <= fraction * F.col("r2"))))


def solid_profile(solid: DataFrame, theta: tuple[float, float]) -> DataFrame:
    """Solid points of each segment within its radius and a window of angles."""
    r2 = F.col("v_") * F.col("v_") + F.col("w") * F.col("w")
    kept = solid.where(F.atan2("v_", "w").between(*theta) & (r2 <= F.col("r2")))
    return kept.groupBy("segment").agg(F.count("*").alias("n"))


def cylinder_image(points: DataFrame, d: tuple[float, float], theta: tuple[float, float], u: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """Image over (angle, u) of points (u, v_, w, dist, p) at distance d[0] < dist <= d[1]: sums of p / 255 and counts of p > 0."""
    t = F.atan2("v_", "w")
    kept = points.where((F.col("dist") > d[0]) & (F.col("dist") <= d[1]) & F.col("u").between(*u) & t.between(*theta))
    ti = F.floor((t - theta[0]) / (theta[1] - theta[0]) * (shape[0] - 1)).cast("int")
    ui = F.floor((F.col("u") - u[0]) / (u[1] - u[0]) * (shape[1] - 1)).cast("int")
    return kept.groupBy(ti.alias("theta_i"), ui.alias("u_i")).agg(F.sum(dbl(F.col("p")) / 255.0).alias("image"), F.count_if(F.col("p") > 0).alias("n"))


def slab_circles(points: DataFrame, u: tuple[float, float], slabs: int) -> DataFrame:
    """Circle of each slab of points (u, v_, w) through (0, max w), (min v, 0), (max v, 0)."""
    i = F.least(F.floor((F.col("u") - u[0]) / (u[1] - u[0]) * slabs), F.lit(slabs - 1)).cast("int")
    ends = points.where(F.col("u").between(*u)).groupBy(i.alias("slab")).agg(F.min("v_").alias("lo"), F.max("v_").alias("hi"), F.max("w").alias("top"), F.avg("u").alias("u"))
    three = ends.select("slab", "u", F.lit(0.0).alias("x1"), F.col("top").alias("y1"), F.col("lo").alias("x2"), F.lit(0.0).alias("y2"), F.col("hi").alias("x3"), F.lit(0.0).alias("y3"))
    return circle_centre(three).select("slab", "u", "cx", "cy", "radius")


def axis_slope(circles: DataFrame) -> DataFrame:
    """Least-squares slopes of the centres along u, through the first slab's centre."""
    first = circles.where("cx is not null").agg(F.min(F.struct("slab", "u", "cx", "cy")).alias("f")).select("f.*").first()
    if first is None:
        return circles.sparkSession.createDataFrame([], "slope_v double, slope_w double")
    du = F.col("u") - first["u"]
    return circles.agg((F.sum(du * (F.col("cx") - first["cx"])) / F.sum(du * du)).alias("slope_v"), (F.sum(du * (F.col("cy") - first["cy"])) / F.sum(du * du)).alias("slope_w"))


def axis_bounds(axis, centre, shape: tuple[int, int, int]) -> tuple[float, float]:
    """Least and greatest projection of a box's corners (x, y, z order) on an axis."""
    nz, ny, nx = shape
    corners = [(x, y, z) for x in (0, nx) for y in (0, ny) for z in (0, nz)]
    dots = [sum((c - m) * a for c, m, a in zip(p, centre, axis, strict=True)) for p in corners]
    return min(dots), max(dots)


def bounding_projections(vol: DataFrame, centre, axes) -> DataFrame:
    """Support of the projections on each axis: the bounding box in another frame."""
    return vol.agg(*[f(projection(a, centre)).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))])


def bounding_cylinder(vol: DataFrame, centre, axes) -> DataFrame:
    """Extent along the first axis and greatest distance from it."""
    a, b, c = (projection(x, centre) for x in axes)
    return vol.agg(F.min(a).alias("lo"), F.max(a).alias("hi"), F.sqrt(F.max(b * b + c * c)).alias("radius"))
