"""Queries of moments, frames and projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelith.operators import geometry as g
from voxelith.plans import fixtures as fx
from voxelith.plans.registry import Registry

REGISTRY = query = Registry()


def rounded(df, digits: int = 4, but: tuple[str, ...] = ()):
    """Doubles rounded, for results whose last digits depend on the order of sums."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in but else F.col(c) for c in df.columns])


@query("vox", "SELECT round(sum(CAST(v AS DOUBLE) * z) / sum(CAST(v AS DOUBLE)), 6) AS cz, round(sum(CAST(v AS DOUBLE) * y) / sum(CAST(v AS DOUBLE)), 6) AS cy, round(sum(CAST(v AS DOUBLE) * x) / sum(CAST(v AS DOUBLE)), 6) AS cx FROM vox")
def g1_centre_of_mass(spark, d):
    return rounded(g.centre_of_mass(fx.vox(spark, d)), 6)


@query("lab", "SELECT label, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, count(*) AS n FROM lab WHERE label <> 0 GROUP BY 1")
def g2_centres_of_mass(spark, d):
    return rounded(g.centres_of_mass(fx.labels(spark, d)), 6)


TENSOR = """sum(m * ((y - cy) * (y - cy) + (x - cx) * (x - cx))) AS izz, sum(m * ((z - cz) * (z - cz) + (x - cx) * (x - cx))) AS iyy,
 sum(m * ((z - cz) * (z - cz) + (y - cy) * (y - cy))) AS ixx, -sum(m * (z - cz) * (y - cy)) AS izy, -sum(m * (z - cz) * (x - cx)) AS izx, -sum(m * (y - cy) * (x - cx)) AS iyx"""
ROUND6 = ", ".join(f"round({c}, 1) AS {c}" for c in ("izz", "iyy", "ixx", "izy", "izx", "iyx"))
#: Centred tensors need no large numbers, so that both engines agree to the digits compared.
BITS = "b AS (SELECT z, y, x, CAST(v > 40000 AS INT) m FROM vox WHERE v > 40000), c AS (SELECT avg(z) cz, avg(y) cy, avg(x) cx FROM b)"


@query("vox", f"WITH {BITS}, t AS (SELECT {TENSOR} FROM b, c) SELECT {ROUND6} FROM t")
def g3_inertia(spark, d):
    return rounded(g.inertia(fx.vox(spark, d).where("v > 40000").withColumn("m", F.lit(1)), "m"), 1)


@query("lab", f"""WITH b AS (SELECT *, CAST(1 AS INT) m FROM lab WHERE z < 10), c AS (SELECT label, avg(z) cz, avg(y) cy, avg(x) cx FROM b GROUP BY 1),
t AS (SELECT label, {TENSOR} FROM b JOIN c USING (label) GROUP BY 1) SELECT label, {ROUND6} FROM t""")
def g4_inertias(spark, d):
    return rounded(g.inertias(fx.labels(spark, d).where("z < 10")), 1)


@query("lab", f"""WITH b AS (SELECT *, CAST(1 AS INT) m FROM lab), c AS (SELECT label, avg(z) cz, avg(y) cy, avg(x) cx FROM b GROUP BY 1),
t AS (SELECT label, {TENSOR} FROM b JOIN c USING (label) GROUP BY 1) SELECT label, {ROUND6} FROM t""")
def g4_inertias_all(spark, d):
    """All slices."""
    return rounded(g.inertias(fx.labels(spark, d)), 1)


@query("vox", """WITH p AS (SELECT round(CAST(0.6 AS DOUBLE) * (x - 32) + CAST(0.8 AS DOUBLE) * (y - 10) + 30) i, round(CAST(z - 12 AS DOUBLE) + 12) j, v FROM vox)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(sum(v) AS BIGINT) AS total FROM p WHERE i BETWEEN 0 AND 59 AND j BETWEEN 0 AND 24 GROUP BY 1, 2""")
def g5_integrate_axes(spark, d):
    return g.integrate_axes(fx.vox(spark, d), (32, 10, 12), (0.6, 0.8, 0), (0, 0, 1), -30, -12, (60, 25))


@query("lab", """WITH p AS (SELECT label, floor(avg(z)) cz, floor(avg(y)) cy, floor(avg(x)) cx FROM lab GROUP BY 1)
SELECT label, count(*) FILTER ((z - cz) * (z - cz) / CAST(64 AS DOUBLE) + (y - cy) * (y - cy) / CAST(64 AS DOUBLE) + (x - cx) * (x - cx) / CAST(256 AS DOUBLE) >= 1) AS outside, count(*) AS n
FROM lab JOIN p USING (label) GROUP BY 1""")
def g6_outside_ellipsoid(spark, d):
    lab = fx.labels(spark, d)
    params = lab.groupBy("label").agg(*[F.floor(F.avg(c)).cast("double").alias(f"c{c}") for c in "zyx"]).withColumns({"a": F.lit(8.0), "b": F.lit(8.0), "c": F.lit(16.0)})
    return g.outside_ellipsoid(lab, params)


@query("svox", """SELECT z, y, x, CAST(0.5 AS DOUBLE) * z + CAST(0.25 AS DOUBLE) * y + 10 AS u, CAST(2 AS DOUBLE) * y - x AS v_, CAST(z AS DOUBLE) - CAST(0.5 AS DOUBLE) * x - 3 AS w FROM svox""")
def g7_transform(spark, d):
    m = [[0.5, 0.25, 0, 10], [0, 2, -1, 0], [1, 0, -0.5, -3], [0, 0, 0, 1]]
    return g.transform(fx.svox(spark, d).drop("v"), m)


def _frame(spark, rows, names):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in rows], ", ".join(f"{n} double" for n in names))


@query("", """SELECT * FROM (VALUES (CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(-4 AS DOUBLE)), (0, 1, 0, -2), (1, 0, 0, -3)) t(a, b, c, d)""")
def g8_implant_frame(spark, d):
    m = g.to_implant_frame((2, 1, 3), [[0, 0, 1], [0, 1, 0], [1, 0, 0]], 1, (1, 1, 0), np.eye(3))
    return _frame(spark, m[:3], "abcd")


@query("", "SELECT * FROM (VALUES (CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0 AS DOUBLE)), (-0.8, 0.6, 0), (0, 0, 1)) t(a, b, c)")
def g9_gram_schmidt(spark, d):
    return _frame(spark, np.round(g.gram_schmidt((3, 4, 0), (-1, 7, 0), (2, 2, 5)), 9) + 0.0, "abc")


CIRCLE = """d AS (SELECT *, nullif(2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2)), 0) d, x1 * x1 + y1 * y1 s1, x2 * x2 + y2 * y2 s2, x3 * x3 + y3 * y3 s3 FROM pts),
c AS (SELECT *, (s1 * (y2 - y3) + s2 * (y3 - y1) + s3 * (y1 - y2)) / d cx, (s1 * (x3 - x2) + s2 * (x1 - x3) + s3 * (x2 - x1)) / d cy FROM d)"""


@query("", f"""WITH pts AS (SELECT s_suppkey id, CAST(s_suppkey % 7 AS DOUBLE) x1, CAST(s_suppkey % 5 AS DOUBLE) y1, CAST(s_suppkey % 11 + 9 AS DOUBLE) x2, CAST(s_suppkey % 3 AS DOUBLE) y2, CAST(s_suppkey % 13 AS DOUBLE) x3, CAST(s_suppkey % 4 + 8 AS DOUBLE) y3 FROM supplier), {CIRCLE}
SELECT id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt((x1 - cx) * (x1 - cx) + (y1 - cy) * (y1 - cy)), 6) AS radius FROM c""")
def g10_circle_centre(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    pts = s.select(k.alias("id"), *[e.cast("double").alias(n) for n, e in (("x1", k % 7), ("y1", k % 5), ("x2", k % 11 + 9), ("y2", k % 3), ("x3", k % 13), ("y3", k % 4 + 8))])
    return rounded(g.circle_centre(pts).select("id", "cx", "cy", "radius"), 6)


def _points(spark, d):
    """Mask points in a frame along z: u = z, v_ = y - 10, w = x - 32."""
    v = fx.vox(spark, d)
    return v.select("z", "y", "x", "v", F.col("z").cast("double").alias("u"), (F.col("y") - 10).cast("double").alias("v_"), (F.col("x") - 32).cast("double").alias("w"), (F.col("v") > 45000).cast("int").alias("m"))


POINTS = "p AS (SELECT z, y, x, v, CAST(z AS DOUBLE) u, CAST(y - 10 AS DOUBLE) v_, CAST(x - 32 AS DOUBLE) w, CAST(v > 45000 AS INT) m FROM vox)"


@query("vox", f"WITH {POINTS} SELECT z, y, x, CASE WHEN m > 0 THEN 0 ELSE CAST(w > 4 AS INT) END AS front FROM p")
def g11_front_mask(spark, d):
    return g.front_mask(_points(spark, d).withColumnRenamed("m", "solid"), 4).select("z", "y", "x", "front")


@query("vox", f"""WITH {POINTS}, r AS (SELECT *, sqrt(v_ * v_ + w * w) r FROM p), q AS (SELECT z, y, x, m, r, w - (SELECT coalesce(min(w), 0) FROM r WHERE m > 0) w,
 coalesce(max(CASE WHEN m > 0 THEN r END) OVER (PARTITION BY z), 0) rmax FROM r), s AS (SELECT *, (m > 0) OR (r < CAST(0.7 AS DOUBLE) * rmax AND w >= 0) solid FROM q)
SELECT z, y, x, solid, w < 0 AS back, w > 50 AND NOT solid AS front FROM s""")
def g12_front_back_masks(spark, d):
    p = _points(spark, d)
    r = F.sqrt(F.col("v_") * F.col("v_") + F.col("w") * F.col("w"))
    return g.front_back_masks(p.select("z", "y", "x", "w", r.alias("r"), "m")).select("z", "y", "x", "solid", "back", "front")


@query("vox", f"""WITH {POINTS} SELECT CAST(floor((u - 0) / (20 - 0) * 15) AS INT) AS segment, max(v_ * v_ + w * w) AS r2, round(min(atan2(v_, w)), 9) AS theta_min, round(max(atan2(v_, w)), 9) AS theta_max
FROM p WHERE m > 0 AND u BETWEEN 0 AND 20 GROUP BY 1""")
def g13_segment_radii(spark, d):
    return rounded(g.segment_radii(_points(spark, d).where("m > 0"), 0, 20, 16), 9)


SOLID = f"""{POINTS}, r AS (SELECT CAST(floor((u - 0) / (20 - 0) * 15) AS INT) segment, max(v_ * v_ + w * w) r2 FROM p WHERE m > 0 AND u BETWEEN 0 AND 20 GROUP BY 1),
s AS (SELECT p.*, r.segment, r.r2 FROM p JOIN r ON r.segment = CAST(floor((u - 0) / (20 - 0) * 15) AS INT) WHERE u BETWEEN 0 AND 20 AND w >= -5 AND (m > 0 OR v_ * v_ + w * w <= CAST(0.5 AS DOUBLE) * r2))"""


def _solid(spark, d):
    p = _points(spark, d)
    return g.fill_solid(p, g.segment_radii(p.where("m > 0"), 0, 20, 16), 0, 20, 16, -5, 0.5)


@query("vox", f"WITH {SOLID} SELECT z, y, x, segment FROM s")
def g14_fill_implant_mask(spark, d):
    return _solid(spark, d).select("z", "y", "x", "segment")


@query("vox", f"WITH {SOLID} SELECT segment, count(*) AS n FROM s WHERE atan2(v_, w) BETWEEN -1 AND 1 AND v_ * v_ + w * w <= r2 GROUP BY 1")
def g14_implant_profile(spark, d):
    return g.solid_profile(_solid(spark, d), (-1, 1))


@query("vox", f"""WITH {POINTS}, q AS (SELECT *, abs(sqrt(v_ * v_ + w * w) - 9) dist, atan2(v_, w) t, v % 256 c FROM p)
SELECT CAST(floor((t - (-1)) / (1 - (-1)) * 31) AS INT) AS theta_i, CAST(floor((u - 0) / (24 - 0) * 11) AS INT) AS u_i, round(sum(CAST(c AS DOUBLE) / 255), 6) AS image, count(*) FILTER (c > 0) AS n
FROM q WHERE dist > 0 AND dist <= 3 AND u BETWEEN 0 AND 24 AND t BETWEEN -1 AND 1 GROUP BY 1, 2""")
def g15_cylinder_projection(spark, d):
    p = _points(spark, d).withColumn("dist", F.abs(F.sqrt(F.col("v_") * F.col("v_") + F.col("w") * F.col("w")) - 9)).withColumn("p", F.col("v") % 256)
    return rounded(g.cylinder_image(p, (0, 3), (-1, 1), (0, 24), (32, 12)), 6)


@query("lab", f"""WITH b AS (SELECT *, CAST(1 AS INT) m FROM lab WHERE z < 10), c AS (SELECT label, avg(z) cz, avg(y) cy, avg(x) cx FROM b GROUP BY 1),
t AS (SELECT label, {TENSOR} FROM b JOIN c USING (label) GROUP BY 1), q AS (SELECT *, (izz + iyy + ixx) / 3 q, izy * izy + izx * izx + iyx * iyx o FROM t),
p AS (SELECT *, sqrt(((izz - q) * (izz - q) + (iyy - q) * (iyy - q) + (ixx - q) * (ixx - q) + 2 * o) / 6) p FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, ((izz - q) * ((iyy - q) * (ixx - q) - iyx * iyx) - izy * (izy * (ixx - q) - iyx * izx) + izx * (izy * iyx - (iyy - q) * izx)) / (2 * p * p * p)))) / 3 phi FROM p)
SELECT label, round(q + 2 * p * cos(phi + 2 * pi() / 3), 1) AS e1, round(3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)), 1) AS e2, round(q + 2 * p * cos(phi), 1) AS e3 FROM r""")
def g16_eigenvalues(spark, d):
    return rounded(g.eigenvalues(g.inertias(fx.labels(spark, d).where("z < 10")), ["label"]), 1)


@query("lab", f"""WITH b AS (SELECT *, CAST(1 AS INT) m FROM lab), c AS (SELECT label, avg(z) cz, avg(y) cy, avg(x) cx FROM b GROUP BY 1),
t AS (SELECT label, {TENSOR} FROM b JOIN c USING (label) GROUP BY 1), q AS (SELECT *, (izz + iyy + ixx) / 3 q, izy * izy + izx * izx + iyx * iyx o FROM t),
p AS (SELECT *, sqrt(((izz - q) * (izz - q) + (iyy - q) * (iyy - q) + (ixx - q) * (ixx - q) + 2 * o) / 6) p FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, ((izz - q) * ((iyy - q) * (ixx - q) - iyx * iyx) - izy * (izy * (ixx - q) - iyx * izx) + izx * (izy * iyx - (iyy - q) * izx)) / (2 * p * p * p)))) / 3 phi FROM p)
SELECT label, round(q + 2 * p * cos(phi + 2 * pi() / 3), 1) AS e1, round(3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)), 1) AS e2, round(q + 2 * p * cos(phi), 1) AS e3 FROM r""")
def g16_eigenvalues_all(spark, d):
    """All slices."""
    return rounded(g.eigenvalues(g.inertias(fx.labels(spark, d)), ["label"]), 1)


SLABS = """s AS (SELECT CAST(least(floor((u - 0) / (25 - 0) * 5), 4) AS INT) slab, min(v_) lo, max(v_) hi, max(w) top, avg(u) u FROM p WHERE m > 0 AND u BETWEEN 0 AND 25 GROUP BY 1),
pts AS (SELECT slab, u, CAST(0 AS DOUBLE) x1, top y1, lo x2, CAST(0 AS DOUBLE) y2, hi x3, CAST(0 AS DOUBLE) y3 FROM s)"""


@query("vox", f"WITH {POINTS}, {SLABS}, {CIRCLE} SELECT slab, round(u, 6) AS u, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt((x1 - cx) * (x1 - cx) + (y1 - cy) * (y1 - cy)), 6) AS radius FROM c")
def g18_slab_circles(spark, d):
    return rounded(g.slab_circles(_points(spark, d).where("m > 0"), (0, 25), 5), 6)


@query("vox", f"""WITH {POINTS}, {SLABS}, {CIRCLE}, f AS (SELECT u u0, cx cx0, cy cy0 FROM c WHERE cx IS NOT NULL ORDER BY slab LIMIT 1)
SELECT round(sum((u - u0) * (cx - cx0)) / sum((u - u0) * (u - u0)), 6) AS slope_v, round(sum((u - u0) * (cy - cy0)) / sum((u - u0) * (u - u0)), 6) AS slope_w FROM c, f""")
def g18_axis_slope(spark, d):
    return rounded(g.axis_slope(g.slab_circles(_points(spark, d).where("m > 0"), (0, 25), 5)), 6)


@query("vox", f"""WITH {POINTS}, h AS (SELECT CAST(floor((atan2(v_, w) + 3.2) / CAST(6.4 AS DOUBLE) * 31) AS INT) bin, count(*) n FROM p WHERE m > 0 GROUP BY 1),
d AS (SELECT CAST(0 AS INT) "row", CAST(r.id AS INT) bin, CAST(coalesce(n, 0) AS BIGINT) n FROM range(32) r(id) LEFT JOIN h ON h.bin = r.id)
SELECT bin, n, CASE WHEN bin = 0 THEN CAST(lead(n) OVER (ORDER BY bin) - n AS DOUBLE) WHEN bin = 31 THEN CAST(n - lag(n) OVER (ORDER BY bin) AS DOUBLE)
 ELSE CAST(lead(n) OVER (ORDER BY bin) - lag(n) OVER (ORDER BY bin) AS DOUBLE) / 2 END AS slope FROM d""")
def g19_theta_profile(spark, d):
    from voxelith.operators.histogram import dense, gradient

    p = _points(spark, d).where("m > 0")
    h = p.groupBy(F.lit(0).alias("row"), F.floor((F.atan2("v_", "w") + 3.2) / 6.4 * 31).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return gradient(dense(h, 32)).select("bin", "n", "slope")


@query("", "SELECT CAST(-20 AS DOUBLE) AS lo, CAST(44 AS DOUBLE) AS hi")
def g20_axis_bounds(spark, d):
    return _frame(spark, [g.axis_bounds((1, 0, 0), (20, 10, 12), (25, 20, 64))], ("lo", "hi"))


@query("vox", """SELECT round(min(CAST(0.6 AS DOUBLE) * (x - 32) + CAST(0.8 AS DOUBLE) * (y - 10)), 6) AS lo0, round(max(CAST(0.6 AS DOUBLE) * (x - 32) + CAST(0.8 AS DOUBLE) * (y - 10)), 6) AS hi0,
 CAST(min(z - 12) AS DOUBLE) AS lo1, CAST(max(z - 12) AS DOUBLE) AS hi1 FROM vox WHERE v > 50000""")
def g21_bounding_projections(spark, d):
    return rounded(g.bounding_projections(fx.vox(spark, d).where("v > 50000"), (32, 10, 12), [(0.6, 0.8, 0), (0, 0, 1)]), 6)


@query("vox", """SELECT CAST(min(z - 12) AS DOUBLE) AS lo, CAST(max(z - 12) AS DOUBLE) AS hi, round(sqrt(max(CAST((x - 32) * (x - 32) + (y - 10) * (y - 10) AS DOUBLE))), 6) AS radius FROM vox WHERE v > 50000""")
def g21_bounding_cylinder(spark, d):
    return rounded(g.bounding_cylinder(fx.vox(spark, d).where("v > 50000"), (32, 10, 12), [(0, 0, 1), (1, 0, 0), (0, 1, 0)]), 6)


@query("vox", f"WITH {POINTS} SELECT z, y, x, round(atan2(v_, w), 9) AS theta, round(sqrt(v_ * v_ + w * w), 9) AS r FROM p")
def g23_polar(spark, d):
    from voxelith.functions.scalar import polar

    t, r = polar(F.col("v_"), F.col("w"))
    return _points(spark, d).select("z", "y", "x", F.round(t, 9).alias("theta"), F.round(r, 9).alias("r"))


@query()
def g17_axis_frame(spark, d):
    """Axes u, v, w of the inertia tensor of the mask: one row an axis."""
    t = g.inertia(fx.vox(spark, d).where("v > 45000").withColumn("m", F.lit(1)), "m").first()
    tensor = [[t.izz, t.izy, t.izx], [t.izy, t.iyy, t.iyx], [t.izx, t.iyx, t.ixx]]
    return _frame(spark, g.axis_frame(g.eigen_frame(tensor)[1]), ("z", "y", "x"))
