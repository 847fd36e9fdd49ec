"""Queries of operators that others do not reach: packed morphology, blocks, matching, planes, power fits, shells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from voxelith.functions import scalar
from voxelith.operators import align, geometry, histogram, models, planes, resample, stencil, voxels
from voxelith.plans import composite, oracles
from voxelith.plans import fixtures as fx
from voxelith.plans.queries_geometry import rounded
from voxelith.plans.queries_histogram import BIN, DENSE, ZHIST, zdense
from voxelith.plans.queries_stencil import mask
from voxelith.plans.registry import Registry

REGISTRY = query = Registry()
ZYX = ["z", "y", "x"]
WORDS = "CAST(x // 32 AS INT) AS xw, CAST(sum(CAST(1 AS BIGINT) << (31 - x % 32)) AS BIGINT) AS w"


@query("vox ext", f"WITH m AS (SELECT z, y, x FROM vox WHERE v > 55000), {oracles.ball(3)}, {oracles.grow('m', 'r', 3)} SELECT z, y, {WORDS} FROM r GROUP BY z, y, x // 32")
def m3_packed_dilate(spark, d):
    return voxels.packed_dilate(voxels.pack_bits(mask(spark, d, 55000)), 3, fx.extent(spark, d))


@query("vox ext", f"WITH {oracles.BOX}, m AS (SELECT z, y, x FROM vox WHERE v > 25000), {oracles.ball(1)}, {oracles.shrink('m', 'r', 1)} SELECT z, y, {WORDS} FROM r GROUP BY z, y, x // 32")
def m3_packed_erode(spark, d):
    return voxels.packed_erode(voxels.pack_bits(mask(spark, d, 25000)), 1, fx.extent(spark, d))


@query("vox ext", oracles.diffusion(58000, 1.0, 2, 3))
def m11_diffusion_blocks(spark, d):
    """Diffusion in blocks of 16 voxels a side with halos: as in memory."""
    return stencil.diffuse_blocks(mask(spark, d, 58000), 1.0, 3, fx.extent(spark, d), 2, 16)


@query("vox", """WITH t AS (SELECT z - 10 z, y, x, CAST(v AS DOUBLE) v FROM vox WHERE z >= 10 AND z < 12), b AS (SELECT z - 4 z, y, x, CAST(v AS DOUBLE) v FROM vox WHERE z >= 4 AND z < 16),
s AS (SELECT i.id AS start, sqrt(sum((t.v - b.v) * (t.v - b.v)) / 1280) AS score FROM range(10) i(id), t, b WHERE b.z = t.z + i.id AND b.y = t.y AND b.x = t.x GROUP BY 1)
SELECT CAST(start + 2 AS INT) AS shift FROM s ORDER BY score, start LIMIT 1""")
def d21_match_volume(spark, d):
    """Where the last two slices above a crossing lie in the scan below it."""
    v = fx.vox(spark, d)
    top = v.where("z >= 10 and z < 12").withColumn("z", F.col("z") - 10)
    return align.match_volume(top, v.where("z >= 4 and z < 16").withColumn("z", F.col("z") - 4), 2, 10, 1280)


CROP = "SELECT '{n}' AS scan, z, CAST(y - {y} AS INT) AS y, CAST(x - {x} AS INT) AS x, v FROM {t} WHERE y BETWEEN {y} AND {y} + 15 AND x BETWEEN {x} AND {x} + 63"


@query("vox svox", f"""WITH c AS ({CROP.format(n='a', y=2, x=0, t='vox')} UNION ALL {CROP.format(n='b', y=56, x=32, t='svox')}),
k AS (SELECT scan, z, y, x, CASE WHEN v = 0 THEN 0 ELSE least(65535, CAST(floor((CAST(v AS DOUBLE) - 1) / 65534 * 65535) AS BIGINT) + 1) END n FROM c
 WHERE (CAST(y AS DOUBLE) * 2 / 15 - 1) * (CAST(y AS DOUBLE) * 2 / 15 - 1) + (CAST(x AS DOUBLE) * 2 / 63 - 1) * (CAST(x AS DOUBLE) * 2 / 63 - 1) < 1)
SELECT scan, z, y, x, CAST(n // 256 AS INT) AS high, CAST(n % 256 AS INT) AS low FROM k""")
def s14_import_scans(spark, d):
    """Two scans of different sizes: their common middle, within the cylinder, as 16 bits in two bytes."""
    scans = {"a": (fx.vox(spark, d), (0, 20, 64)), "b": (fx.svox(spark, d), (128, 128, 128))}
    size, out = align.common_size([s for _, s in scans.values()], 16), None
    for name, (vol, shape) in scans.items():
        cut = align.crop_centre(vol, shape, size).where(scalar.cylinder(F.col("y"), F.col("x"), *size))
        high, low = scalar.split_bytes(scalar.normalize(F.col("v"), 1, 65535))
        one = cut.select(F.lit(name).alias("scan"), *ZYX, high.cast("int").alias("high"), low.cast("int").alias("low"))
        out = one if out is None else out.unionByName(one)
    return out


@query("vox", f"""WITH {ZHIST}, {DENSE} SELECT "row", bin, CAST(sum(t) OVER (PARTITION BY bin ORDER BY "row" ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS BIGINT) AS total
FROM (SELECT "row", bin, sum(n) OVER (PARTITION BY "row" ORDER BY bin ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) t FROM d QUALIFY bin <= 60) QUALIFY count(*) OVER (PARTITION BY bin ORDER BY "row" ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4""")
def k9_sliding_sum_2d(spark, d):
    return histogram.sliding_sum_2d(zdense(spark, d), 4).select("row", "bin", "total")


@query("vox", f"""WITH {ZHIST}, m AS (SELECT n, CAST(20 AS DOUBLE) + bin % 5 m FROM h), r AS (SELECT sum((n - m) * (n - m)) / count(*) e1, sum(CASE WHEN n - m < 0 THEN (n - m) * (n - m) ELSE 0 END) / count(*) e2 FROM m),
c AS (SELECT 1 / (CAST(18 AS DOUBLE) + 0.001) + 1 / (CAST(12 AS DOUBLE) + 0.001) c) SELECT round(e1, 6) AS e1, round(e2, 6) AS e2, round(c, 9) AS closeness, round(e1 + 100 * c + e2, 6) AS total FROM r, c""")
def a15_energy(spark, d):
    rows = histogram.axis_histograms(fx.vox(spark, d), 1, 65535, 64, (0, 20, 64), ("z",)).withColumn("m", 20.0 + F.col("bin") % 5)
    e = histogram.energy(rows, [10, 28, 40])
    return e.select(*[F.round(c, 9 if c == "closeness" else 6).alias(c) for c in ("e1", "e2", "closeness", "total")])


@query("lab", "SELECT label, n, CAST(sum(n) OVER (ORDER BY label) - n AS BIGINT) AS start FROM (SELECT label, count(*) n FROM lab WHERE label <> 0 GROUP BY 1)")
def a18_segment_starts(spark, d):
    return histogram.segment_starts(fx.labels(spark, d))


@query("lab", "SELECT z, y, x, label FROM lab WHERE label IN (2, 5, 7)")
def a18_select_segments(spark, d):
    return histogram.select_segments(fx.labels(spark, d), spark.createDataFrame([(2,), (5,), (7,), (7,)], "label long")).select(*ZYX, "label")


PI = "pi()"
PROFILE = f"""p AS (SELECT CAST(z AS DOUBLE) u, CAST(y - 10 AS DOUBLE) v_, CAST(x - 32 AS DOUBLE) w, atan2(CAST(y - 10 AS DOUBLE), CAST(x - 32 AS DOUBLE)) theta FROM vox WHERE v > 45000),
c AS (SELECT axis, CAST(floor((k - lo) * (200 / (hi - lo))) AS INT) bin, count(*) n FROM (SELECT 'theta' axis, theta k, -{PI} lo, {PI} hi FROM p UNION ALL SELECT 'u', u, CAST(0 AS DOUBLE), CAST(nz AS DOUBLE) FROM p, ext UNION ALL SELECT 'v_', v_, CAST(-10 AS DOUBLE), CAST(10 AS DOUBLE) FROM p UNION ALL SELECT 'w', w, CAST(-32 AS DOUBLE), CAST(32 AS DOUBLE) FROM p) GROUP BY 1, 2),
d AS (SELECT a.axis, CAST(b.id AS INT) bin, CAST(coalesce(n, 0) AS BIGINT) n FROM (VALUES ('theta'), ('u'), ('v_'), ('w')) a(axis) CROSS JOIN range(200) b(id) LEFT JOIN c ON c.axis = a.axis AND c.bin = b.id)"""


def _profiles(spark, d):
    p = mask(spark, d).select(F.col("z").cast("double").alias("u"), (F.col("y") - 10).cast("double").alias("v_"), (F.col("x") - 32).cast("double").alias("w"))
    ranges = {"theta": (-math.pi, math.pi), "u": (0.0, float(fx.extent(spark, d)[0])), "v_": (-10.0, 10.0), "w": (-32.0, 32.0)}
    return histogram.profiles(p.withColumn("theta", F.atan2("v_", "w")), ranges)


@query("vox ext", f"WITH {PROFILE} SELECT * FROM d")
def g19_profiles(spark, d):
    """Histograms of the angle and of the three coordinates in the implant's frame."""
    return _profiles(spark, d)


@query("vox ext", f"""WITH {PROFILE}, s AS (SELECT axis, bin, CASE WHEN bin = 0 THEN CAST(lead(n) OVER w - n AS DOUBLE) WHEN bin = 199 THEN CAST(n - lag(n) OVER w AS DOUBLE) ELSE CAST(lead(n) OVER w - lag(n) OVER w AS DOUBLE) / 2 END g FROM d WINDOW w AS (PARTITION BY axis ORDER BY bin))
SELECT axis, (SELECT bin FROM s e WHERE e.axis = a.axis ORDER BY g DESC, bin LIMIT 1) AS rise, (SELECT bin FROM s e WHERE e.axis = a.axis ORDER BY g, bin LIMIT 1) AS fall FROM (SELECT DISTINCT axis FROM s) a""")
def g19_profile_ranges(spark, d):
    return histogram.profile_ranges(_profiles(spark, d))


SHELL = f"""WITH {oracles.ON_FIELD}, k AS (SELECT z, y, x, v // 256 p, value f FROM q JOIN t USING (id)),
g AS (SELECT CAST(z AS DOUBLE) u, CAST(y - 10 AS DOUBLE) v_, CAST(x - 32 AS DOUBLE) w, p, f FROM k), s AS (SELECT *, atan2(v_, w) t FROM g WHERE f > 20000 AND f <= 40000 AND p > 0)
SELECT CAST(floor((t + {PI}) / ({PI} + {PI}) * 15) AS INT) AS theta_i, CAST(floor((u - 0) / (nz - 1) * 9) AS INT) AS u_i, round(sum(CAST(p AS DOUBLE) / 255), 6) AS image, count(*) AS n FROM s, ext GROUP BY 1, 2"""


@query("vox field2 dim ext", SHELL)
def g15_cylinder_projection_sampled(spark, d):
    """Voxels at a distance, sampled trilinearly from the coarser field, on the cylinder of angle and axis."""
    nz, high = fx.shape(spark, d)[0], fx.extent(spark, d)[0]
    at = resample.field_at_centres(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32))
    p = at.select(F.col("z").cast("double").alias("u"), (F.col("y") - 10).cast("double").alias("v_"), (F.col("x") - 32).cast("double").alias("w"), F.col("f").alias("dist"), F.expr("v div 256").alias("p"))
    return rounded(geometry.cylinder_image(p.where("p > 0"), (20000, 40000), (-math.pi, math.pi), (0, high - 1), (16, 10)), 6)


@query("svox", f"""WITH s AS (SELECT atan2(CAST(y - 64 AS DOUBLE), CAST(x - 64 AS DOUBLE)) t, z, v FROM svox)
SELECT CAST(floor((t + {PI}) / ({PI} + {PI}) * 31) AS INT) AS theta_i, CAST(z // 8 AS INT) AS u_i, CAST(sum(v) AS BIGINT) AS total, 1 AS counted FROM s GROUP BY 1, 2""")
def a16_shell_bins_theta(spark, d):
    """Sums over angle and axis about the middle of the volume; a bin that is met counts once."""
    t = F.atan2((F.col("y") - 64).cast("double"), (F.col("x") - 64).cast("double"))
    keys = [F.floor((t + math.pi) / (2 * math.pi) * 31).cast("int").alias("theta_i"), F.expr("cast(z div 8 as int)").alias("u_i")]
    return fx.svox(spark, d).groupBy(*keys).agg(F.sum("v").alias("total"), F.lit(1).alias("counted"))


def _taps(swap: bool) -> str:
    low, high = ("0.125", "0.375") if swap else ("0.375", "0.125")
    return f"""WITH p AS (SELECT z, y iy, x ix FROM vox) SELECT p.z, iy, ix, round(sum(CASE WHEN i.x = ix THEN CASE WHEN i.y = iy THEN CAST(0.375 AS DOUBLE) ELSE CAST(0.125 AS DOUBLE) END WHEN i.y = iy THEN CAST({low} AS DOUBLE) ELSE CAST({high} AS DOUBLE) END * v), 6) AS value
FROM p JOIN vox i ON i.z = p.z AND i.y IN (iy, iy + 1) AND i.x IN (ix, ix + 1) GROUP BY 1, 2, 3"""


def _bilinear(spark, d, swap: bool):
    image = fx.vox(spark, d)
    pts = image.select("z", F.col("y").alias("iy"), F.col("x").alias("ix"), (F.col("y") + 0.75).alias("py"), (F.col("x") + 1.0).alias("px"))
    return rounded(resample.bilinear(pts, image, ["z", "iy", "ix"], swap, True, ("z",)), 6)


@query("vox", _taps(False))
def r6_bilinear_all(spark, d):
    """Every slice, with voxel centres half a voxel on."""
    return _bilinear(spark, d, False)


@query("vox", _taps(True))
def r6_bilinear_swapped(spark, d):
    """The same with the right-hand taps swapped, as the reading they must equal has them."""
    return _bilinear(spark, d, True)


@query("vox", f"""WITH g AS (SELECT z, CAST(i.id AS INT) r, CAST(j.id AS INT) theta, 10 + (2 + i.id * CAST(0.25 AS DOUBLE)) * sin(j.id * (2 * {PI} / 64)) - CAST(0.5 AS DOUBLE) py, 32 + (2 + i.id * CAST(0.25 AS DOUBLE)) * cos(j.id * (2 * {PI} / 64)) - CAST(0.5 AS DOUBLE) px FROM (SELECT DISTINCT z FROM vox) s, range(28) i(id), range(64) j(id)),
k AS (SELECT g.z, r, theta, CAST(floor(py) AS INT) + dy y, CAST(floor(px) AS INT) + dx x, (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) w FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx))
SELECT k.z, r, theta, round(sum(w * coalesce(v, 0)), 4) AS value FROM k LEFT JOIN vox ON vox.z = k.z AND vox.y = k.y AND vox.x = k.x GROUP BY 1, 2, 3""")
def r7_polar_all(spark, d):
    """Every slice on a polar grid between two radii, with voxel centres half a voxel on."""
    polar = resample.cart_to_polar(fx.vox(spark, d), (10.0, 32.0), 28, 64, inner=2.0, outer=9.0, half=True, by=("z",))
    return rounded(polar, 4)


# without SQL: fits and walks round outlines; see tests --------------------------------------------------------


def _plane(spark, d):
    return fx.vox(spark, d).where("v > 34000").select("z", "y", "x")


@query()
def m14_contours(spark, d):
    """Parts of every slice with an outline longer than twelve, filled and numbered from the left."""
    return planes.contours(_plane(spark, d), "z", (20, 64), 12.0)


@query()
def m15_skeletons(spark, d):
    return planes.skeletons(_plane(spark, d), "z", (20, 64))


@query()
def m15_joints(spark, d):
    return planes.joints(mask(spark, d, 45000), "z", (20, 64), 7)


def _ridged(spark, d):
    """Rows of the z histogram with two materials, the lower and the upper half of the bins."""
    return zdense(spark, d).withColumn("material", F.when(F.col("bin") < 32, 1).otherwise(2))


@query()
def d9_power_rows(spark, d):
    """Four parameters a material and row."""
    return models.fit_power_rows(_ridged(spark, d))


@query()
def d10_power_probabilities(spark, d):
    rows = fx.extent(spark, d)[0]
    curves = models.smooth_parameters(models.fit_power_rows(_ridged(spark, d)), rows, 8)
    return models.power_probabilities(zdense(spark, d), curves, rows, 64, 2)


@query()
def d19_global_fit(spark, d):
    """Two peaks over all rows of a field histogram, fitted at once: values at four borders."""
    nz = fx.shape(spark, d)[0]
    hist = histogram.field_histogram(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (16, 32)).toPandas()  # 16 x 32 bins
    image = np.zeros((16, 32))
    image[hist["row"], hist["bin"]] = hist["n"]
    borders = np.linspace(0, 15, 4)
    start = np.stack([np.stack([np.full(4, np.sqrt(image.max() / 2)), np.full(4, 0.2), np.full(4, c)]) for c in (10.0, 20.0)])
    g, energy = models.fit_globally(image, start, borders)
    rows = [(m, k, float(b), float(g[m, i, j]), energy) for m in range(2) for i, k in enumerate("abc") for j, b in enumerate(borders)]
    return spark.createDataFrame(rows, "material int, parameter string, border double, value double, energy double")


@query()
def q1_segment_implant_level(spark, d):
    """The largest component above the level nearest to a value of the scan."""
    return composite.segment_implant_at(fx.vox(spark, d), -2.0, 6.0, 3.0, 5)
