"""Queries of the remaining rows: halos, trims, variants of histograms, labels and composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelith.operators import align, components, geometry, histogram, models, resample, stencil, voxels
from voxelith.plans import composite
from voxelith.plans import fixtures as fx
from voxelith.plans.registry import Registry
from voxelith.sources import raw, scratch

REGISTRY = query = Registry()
ZYX = ["z", "y", "x"]
BIN = "CAST(floor(CAST(v - 1 AS DOUBLE) * 63 / 65534) AS INT)"


@query("vox", """SELECT slab, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM vox JOIN (SELECT CAST(id AS INT) slab FROM range(200) r(id)) s
ON s.slab BETWEEN greatest(0, z - 2) // 5 AND (z + 2) // 5 GROUP BY 1""")
def s6_halo_slabs(spark, d):
    return raw.with_halo(fx.vox(spark, d), 5, 2).groupBy("slab").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("vox", """SELECT CAST(slab AS INT) AS slab, count(*) AS n, CAST(sum(v) AS BIGINT) AS total
FROM (SELECT v, unnest(range(greatest(0, z - 2) // 5, (z + 2) // 5 + 1)) slab FROM vox) GROUP BY 1""")
def s6_halo_slabs_all(spark, d):
    """The same with SQL for any number of slabs."""
    return raw.with_halo(fx.vox(spark, d), 5, 2).groupBy("slab").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("", """WITH s AS (SELECT CAST((max(vec_id) + 1) // 20 AS INT) nz FROM embeddings)
SELECT CAST(id AS INT) AS chunk, CAST(id * 8 AS INT) AS start, CAST(least(8, nz - id * 8) AS INT) AS size FROM s, range(1000) r(id) WHERE id * 8 < nz""")
def s20_chunks(spark, d):
    return spark.createDataFrame(align.chunks(fx.shape(spark, d)[0], 8), "chunk int, start int, size int")


@query("vox", "SELECT z, y, x, v FROM vox WHERE z < 6")
def s21_replace_partition(spark, d):
    """A stored volume whose second slab was written twice: the last writing holds, the others stay."""
    path, v = scratch.fresh(spark, "volume"), fx.vox(spark, d).where("z < 6")
    raw.write_slices(v.withColumn("v", F.when(F.col("z") >= 2, 7).otherwise(F.col("v"))), path, 2)
    raw.write_slices(v.where("z >= 2"), path, 2)
    return raw.load_slices(spark, path, (0, 6), 2).select(*ZYX, "v")


@query("vox", "SELECT z, y, x, v FROM vox")
def s21_replace_partition_all(spark, d):
    """The same over the whole volume: every slab but the first is written twice, and all slices are read back."""
    path, v, slab = scratch.fresh(spark, "volume"), fx.vox(spark, d), 8
    raw.write_slices(v.withColumn("v", F.when(F.col("z") >= slab, 7).otherwise(F.col("v"))), path, slab)
    raw.write_slices(v.where(F.col("z") >= slab), path, slab)
    return raw.load_slices(spark, path, (0, fx.extent(spark, d)[0]), slab).select(*ZYX, "v")


@query("vox", "SELECT z, y, x FROM vox")
def u16_coordinates(spark, d):
    return fx.vox(spark, d).select(*ZYX)


@query("lab", "SELECT z, y, x, l.label, CAST(p.n * 2 AS BIGINT) AS attribute FROM lab l JOIN (SELECT label, count(*) n FROM lab GROUP BY 1) p USING (label)")
def j4_label_attributes(spark, d):
    lab = fx.labels(spark, d)
    return lab.join(lab.groupBy("label").agg((F.count("*") * 2).alias("attribute")), "label").select(*ZYX, "label", "attribute")


@query("svox", "SELECT z, y, x, v, CAST(CASE WHEN z < 40 THEN 0 WHEN z < 90 THEN 40 ELSE 90 END AS BIGINT) AS start FROM svox")
def j9_z_range_join(spark, d):
    parts = align.starts(spark.createDataFrame([(0, 40), (1, 50), (2, 38)], "i int, nz int"), "i", "nz")
    hit = (F.col("z") >= F.col("start")) & (F.col("z") < F.col("start") + F.col("nz"))
    return fx.svox(spark, d).join(F.broadcast(parts), hit).select(*ZYX, "v", "start")  # one row a subvolume


@query("svox", """SELECT CAST(CASE WHEN z < 40 THEN z WHEN z < 90 THEN z - 4 ELSE z - 10 END AS INT) AS z, y, x, v
FROM svox WHERE NOT (z >= 40 AND z < 44) AND NOT (z >= 90 AND z < 96)""")
def a10_trim_lower_scan(spark, d):
    return align.join_subvolumes(fx.svox(spark, d), [40, 50, 38], [4, 6], keep="upper").select(*ZYX, "v")


@query("lab", "SELECT label, count(*) AS n, CAST(min(z * 1280 + y * 64 + x) AS BIGINT) AS first, CAST(max(z * 1280 + y * 64 + x) AS BIGINT) AS last FROM lab GROUP BY 1")
def a18_label_segments(spark, d):
    at = (F.col("z") * 1280 + F.col("y") * 64 + F.col("x")).cast("long")
    return fx.labels(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


@query("vox", f"""SELECT CAST(floor(sqrt(CAST(x * x + y * y AS DOUBLE))) AS INT) AS "row", {BIN} AS bin, count(*) AS n FROM vox GROUP BY 1, 2""")
def a19_radial_histogram(spark, d):
    return histogram.axis_histograms(fx.vox(spark, d), 1, 65535, 64, (0, 1, 1), ("r",)).drop("axis")


@query("svox", "SELECT CAST(z // 8 AS INT) AS theta_i, CAST(x // 16 AS INT) AS u_i, CAST(sum(v) AS BIGINT) AS total, 1 AS counted FROM svox GROUP BY 1, 2")
def a16_shell_bins(spark, d):
    keys = [F.expr("cast(z div 8 as int)").alias("theta_i"), F.expr("cast(x div 16 as int)").alias("u_i")]
    return fx.svox(spark, d).groupBy(*keys).agg(F.sum("v").alias("total"), F.lit(1).alias("counted"))


@query()
def k6_scatter_peaks(spark, d):
    """Peaks of smoothed rows above one per cent of a share of the row's maximum."""
    h = histogram.axis_histograms(fx.vox(spark, d), 1, 65535, 64, (0, 20, 64), ("z",)).drop("axis")
    smooth = histogram.smooth_rows(h, 64, 3).withColumn("top", F.max("s").over(Window.partitionBy("row")))
    found = histogram.peaks(smooth, "s").join(smooth.select("row", "top").distinct(), "row")
    return found.where(F.col("s") >= 0.01 * 50 * F.col("top")).select("row", "bin", F.round("s", 6).alias("s"))


@query("lab", "SELECT label, CAST(row_number() OVER (ORDER BY first, label) AS INT) AS number FROM (SELECT label, min(x * 100000 + z * 100 + y) AS first FROM lab GROUP BY 1)")
def k10_order_by_x(spark, d):
    first = fx.labels(spark, d).groupBy("label").agg(F.min(F.col("x") * 100000 + F.col("z") * 100 + F.col("y")).alias("first"))
    return first.select("label", F.row_number().over(Window.orderBy("first", "label")).alias("number"))  # one row a contour


@query()
def c1_slab_labels(spark, d):
    return components.label_slabs(fx.vox(spark, d).where("v > 40000"), 5).groupBy("label").agg(F.count("*").alias("n"))


@query("lab", """SELECT label, n, CASE WHEN n < 200 THEN 0 WHEN n < 2000 AND span < 10 THEN 1 WHEN n < 2000 THEN 2 WHEN span < 20 THEN 3 ELSE 4 END AS kind
FROM (SELECT label, count(*) n, max(z) - min(z) + 1 span FROM lab GROUP BY 1)""")
def c12_vessel_or_cell(spark, d):
    s = fx.labels(spark, d).groupBy("label").agg(F.count("*").alias("n"), (F.max("z") - F.min("z") + 1).alias("span"))
    kind = F.when(F.col("n") < 200, 0).when((F.col("n") < 2000) & (F.col("span") < 10), 1).when(F.col("n") < 2000, 2).when(F.col("span") < 20, 3).otherwise(4)
    return s.select("label", "n", kind.alias("kind"))


@query()
def d12_probabilities_by_axis(spark, d):
    """Otsu probabilities of every axis histogram of the volume."""
    hists = histogram.axis_histograms(fx.vox(spark, d), 1, 65535, 32, (0, 20, 64), ("x", "y", "z"))
    out = None
    for axis in ("x", "y", "z"):
        p = models.otsu_probabilities(hists.where(F.col("axis") == axis).drop("axis"), 32, least=10).withColumn("axis", F.lit(axis))
        out = p if out is None else out.unionByName(p)
    return out


@query()
def g22_ellipsoids(spark, d):
    """Centre, axes and voxels outside its ellipsoid of each label."""
    lab = fx.labels(spark, d)
    axes = geometry.eigenvalues(geometry.inertias(lab), ["label"])
    half = lambda a, b, c: F.sqrt(F.greatest(F.lit(0.25), 2.5 * (F.col(a) + F.col(b) - F.col(c)) / F.col("n")))
    par = geometry.centres_of_mass(lab).join(axes, "label").select("label", "cz", "cy", "cx", half("e2", "e3", "e1").alias("a"), half("e1", "e3", "e2").alias("b"), half("e1", "e2", "e3").alias("c"))
    return par.join(geometry.outside_ellipsoid(lab, par), "label")


@query()
def m17_grey_dilation(spark, d):
    """Greatest value within a cube of side five: one window along each axis."""
    v = fx.vox(spark, d)
    for axis in ZYX:
        w = Window.partitionBy(*[c for c in ZYX if c != axis]).orderBy(axis).rangeBetween(-2, 2)
        v = v.withColumn("v", F.max("v").over(w))
    return v


@query("vox", """SELECT z, y, x, CAST(max(w) AS INT) AS v FROM (SELECT a.z, a.y, a.x, b.v w FROM vox a JOIN vox b ON a.y = b.y AND a.x = b.x AND b.z BETWEEN a.z - 2 AND a.z + 2) GROUP BY 1, 2, 3""")
def m16_grey_dilation_z(spark, d):
    w = Window.partitionBy("y", "x").orderBy("z").rangeBetween(-2, 2)
    return fx.vox(spark, d).select(*ZYX, F.max("v").over(w).alias("v"))


@query()
def q4_implant_data(spark, d):
    """Solid implant and its front, from segment radii of the mask."""
    v = fx.vox(spark, d)
    p = v.select(*ZYX, F.col("z").cast("double").alias("u"), (F.col("y") - 10).cast("double").alias("v_"), (F.col("x") - 32).cast("double").alias("w"), (F.col("v") > 45000).cast("int").alias("m"))
    radii = geometry.segment_radii(p.where("m > 0"), 0, 24, 16)
    solid = geometry.fill_solid(p, radii, 0, 24, 16, -5, 0.5).select(*ZYX, F.lit(1).alias("solid"))
    marked = p.join(solid, ZYX, "left").withColumn("solid", F.coalesce("solid", F.lit(0)))
    return geometry.front_mask(marked, 4).select(*ZYX, "solid", "front")


@query()
def q10_blood(spark, d):
    """The largest bright component at scale 2."""
    n = fx.extent(spark, d)
    half = resample.downsample(fx.vox(spark, d), 2, n)
    return components.largest_mask(voxels.threshold(half, 34000), 4)


@query("vox field2 dim", """WITH f AS (SELECT v.*, f.f FROM vox v, dim, field2 f WHERE f.z = least(CAST(v.z * (nz // 2) // nz AS INT), nz // 2 - 1) AND f.y = v.y // 2 AND f.x = v.x // 2),
n AS (SELECT z, count(*) t, sum(CASE WHEN v BETWEEN 20000 AND 32000 THEN 1 ELSE 0 END) s FROM f WHERE f > 0 AND f < 33000 GROUP BY 1)
SELECT 'all' AS "range", round(avg(1 - CAST(s AS DOUBLE) / CAST(t AS DOUBLE)), 9) AS mean, round(stddev_pop(1 - CAST(s AS DOUBLE) / CAST(t AS DOUBLE)), 9) AS sd FROM n""")
def q12_contact_report(spark, d):
    nz = fx.shape(spark, d)[0]
    bic = histogram.bone_contact(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32), 33000, F.col("v").between(20000, 32000))
    s = histogram.range_stats(bic, {"all": (0, nz)})
    return s.select("range", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query()
def a8_healthy_bone_grown(spark, d):
    v = fx.vox(spark, d)
    return composite.healthy_bone_share(v.where("v between 24000 and 40000").select(*ZYX), v.where("v > 30000").select(*ZYX), fx.extent(spark, d), 1, 2)


@query()
def m19_implant_blur(spark, d):
    return stencil.diffuse(fx.vox(spark, d).where("v > 60000").select(*ZYX), 1.5, 1, fx.extent(spark, d))
