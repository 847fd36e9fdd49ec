"""Composite plans: the steps that a tomography job runs, each a chain of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators import components, distance, geometry, histogram, models, stencil, voxels
from voxelith.plans import fixtures as fx
from voxelith.plans.queries_geometry import rounded
from voxelith.plans.registry import Registry

REGISTRY = query = Registry()
ZYX = ["z", "y", "x"]
Shape = tuple[int, int, int]


def segment_implant(vol: DataFrame, level: float, slab: int = 16) -> DataFrame:
    """The largest component above a level."""
    return components.largest_mask(voxels.threshold(vol, level), slab)


def level_index(lo: float, hi: float, target: float, levels: int = 65536) -> int:
    """The index whose value on an even grid of ``levels`` is nearest to ``target``."""
    return max(0, min(levels - 1, round((target - lo) / (hi - lo) * (levels - 1))))


def segment_implant_at(vol: DataFrame, lo: float, hi: float, target: float, slab: int = 16) -> DataFrame:
    """The largest component above the 16-bit level whose value, of a scan with values lo to hi, is nearest to ``target``."""
    return segment_implant(vol, level_index(lo, hi, target), slab)


def frame_of_reference(mask: DataFrame, slabs: int = 5) -> dict:
    """Centre, axes and the implant's own frame of a mask, from one pass of moments and one of slab circles."""
    m = mask.withColumn("m", F.lit(1))
    c = geometry.centre_of_mass(m, "m").first()
    t = geometry.inertia(m, "m").first()
    axes = geometry.axis_frame(geometry.eigen_frame([[t.izz, t.izy, t.izx], [t.izy, t.iyy, t.iyx], [t.izx, t.iyx, t.ixx]])[1])
    turned = geometry.transform(mask, geometry.linear(axes) @ geometry.translation([-c.cz, -c.cy, -c.cx]))
    ends = turned.agg(F.min("u"), F.max("u"), F.min("w")).first()
    slope = geometry.axis_slope(geometry.slab_circles(turned, (ends[0], ends[1]), slabs)).first()
    u = [1.0, slope.slope_v or 0.0, slope.slope_w or 0.0]
    tilt = geometry.gram_schmidt(u, [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    return {"centre": (c.cz, c.cy, c.cx), "axes": axes, "w0": ends[2], "tilt": tilt, "matrix": geometry.to_implant_frame((c.cz, c.cy, c.cx), axes, ends[2], (0, 0, 0), tilt)}


def bone_region(vol: DataFrame, implant: DataFrame, shape: Shape, bins: int, close: int, open_: int, grow: int, slab: int = 16) -> DataFrame:
    """Bone around an implant: a threshold between the two highest peaks, closed, opened, without the grown implant, largest part."""
    one = histogram.axis_histograms(vol.withColumn("z", F.lit(0)), 1, 65535, bins, shape, ("z",)).drop("axis")
    cut = histogram.valley(histogram.dense(one, bins), bins, 3).first()
    level = 1 + (cut["bin"] if cut else bins // 2) * 65534 / (bins - 1)
    bone = stencil.opened(stencil.closed(voxels.threshold(vol, level).select(*ZYX), close, shape), open_, shape)
    return components.largest_mask(voxels.mask_and_not(bone, stencil.dilate(implant, grow, shape)), slab)


def healthy_bone_share(soft: DataFrame, bone: DataFrame, shape: Shape, radius: int, grow: int) -> DataFrame:
    """Of opened bone the share near soft tissue that was closed, opened and grown."""
    near = stencil.dilate(stencil.opened(stencil.closed(soft, radius, shape), radius, shape), grow, shape)
    base = stencil.opened(bone, radius, shape)
    marked = base.join(near.withColumn("hit", F.lit(1)), ZYX, "left")
    return marked.agg((F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("share"), F.count("*").alias("n"))


def cells(mask: DataFrame, size: tuple[int, int], ratio: float, error: float, slab: int = 16) -> DataFrame:
    """Components of a mask that look like cells: label, n, axes, and the mark."""
    lab = components.label_volume(mask, slab)
    sizes = lab.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n").between(*size))
    some = lab.join(sizes.select("label"), "label", "left_semi")
    centre, axes = geometry.centres_of_mass(some), geometry.eigenvalues(geometry.inertias(some), ["label"])
    half = lambda a, b, c: F.sqrt(F.greatest(F.lit(0.25), 2.5 * (a + b - c) / F.col("n")))
    e1, e2, e3 = F.col("e1"), F.col("e2"), F.col("e3")
    par = centre.join(axes, "label").select("label", "cz", "cy", "cx", half(e2, e3, e1).alias("a"), half(e1, e3, e2).alias("b"), half(e1, e2, e3).alias("c"))
    out = geometry.outside_ellipsoid(some, par)
    return components.classify_cells(par.join(out, "label"), size, ratio, error)


# registered runs ----------------------------------------------------------------------------------------------


@query()
def q1_segment_implant(spark, d):
    return segment_implant(fx.vox(spark, d), 38000, 5)


@query()
def q2_frame_of_reference(spark, d):
    f = frame_of_reference(fx.vox(spark, d).where("v > 50000").select(*ZYX))
    return spark.createDataFrame([[float(v) for v in r] for r in f["matrix"][:3]], "a double, b double, c double, d double")


@query()
def q3_bone_region(spark, d):
    v = fx.vox(spark, d)
    return bone_region(v, v.where("v > 58000").select(*ZYX), fx.extent(spark, d), 256, 1, 1, 1, 5)


@query()
def q5_fields(spark, d):
    """Diffusion and distance around the mask, combined."""
    n = fx.extent(spark, d)
    m = fx.vox(spark, d).where("v > 58000").select(*ZYX)
    return voxels.combine_fields(stencil.diffuse(m, 1.0, 2, n, 2), distance.distances(m, n), n[1], n[2])


@query()
def q6_histograms(spark, d):
    """Field histogram without its border rows, smoothed in the plane."""
    nz = fx.shape(spark, d)[0]
    hist = histogram.field_histogram(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (32, 64))
    return rounded(histogram.smooth_plane(hist.where("row > 0 and row < 31"), 32, 64, 3), 6)


@query()
def q7_ridges(spark, d):
    """Peaks of smoothed rows, closed to ridges and labelled."""
    nz = fx.extent(spark, d)[0]
    smooth = histogram.smooth_rows(histogram.axis_histograms(fx.vox(spark, d), 1, 65535, 64, (nz, 20, 64), ("z",)).drop("axis"), 64, 3)
    dots = histogram.peaks(smooth, "s").select(F.lit(0).alias("z"), F.col("row").alias("y"), F.col("bin").alias("x"))
    plane = (1, nz, 64)
    ridge = stencil.erode_cross(stencil.dilate_cross(dots, 3, plane, ("y", "x")), 2, plane, ("y", "x"))
    return components.canonical(components.label_volume(ridge, 1)).where("n > 5")


@query()
def q9_segmentation(spark, d):
    """From a histogram to probabilities of two materials for every voxel."""
    nz = fx.shape(spark, d)[0]
    hist = histogram.field_histogram(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (16, 32))
    table = models.otsu_probabilities(hist, 32, least=10).withColumnsRenamed({"row": "field_bin", "bin": "voxel_bin"})
    return models.material_probability(fx.vox(spark, d), fx.field2(spark, d), table, (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (16, 32))


@query()
def q11_cells(spark, d):
    return rounded(cells(fx.vox(spark, d).where("v > 42000"), (3, 200), 1.2, 0.9, 5).drop("label"), 4)


@query()
def q13_healthy_bone(spark, d):
    v = fx.vox(spark, d)
    return healthy_bone_share(v.where("v between 20000 and 32000").select(*ZYX), v.where("v > 22000").select(*ZYX), fx.extent(spark, d), 1, 1)


@query()
def stream_histograms(spark, d):
    """Histograms of slabs that arrive as files: equal to those of the whole volume."""
    import uuid

    from voxelith.sources import scratch
    from voxelith.streaming import histograms as stream

    path, name = scratch.fresh(spark, "slabs"), f"stream_{uuid.uuid4().hex}"
    fx.vox(spark, d).repartition(5, (F.col("z") / 5).cast("int")).write.parquet(path)
    q = stream.to_memory(stream.axis_counts(stream.slabs(spark, path, 1), 1, 65535, 64, ("z",)), name)
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def _stream_oracle() -> None:
    from voxelith.plans.queries_histogram import REGISTRY as other

    REGISTRY.oracles["stream_histograms"] = other.oracles["a1_axis_histogram_z"]


_stream_oracle()
