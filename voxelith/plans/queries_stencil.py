"""Queries of stencils, resampling, distances and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.operators import components, distance, resample, stencil, voxels
from voxelith.plans import fixtures as fx
from voxelith.plans.queries_geometry import rounded
from voxelith.plans.registry import Registry

REGISTRY = query = Registry()
ZYX = ["z", "y", "x"]

OFF2 = "o AS (SELECT a.i dz, b.i dy, c.i dx FROM (SELECT CAST(id AS INT) i FROM range(-2, 3) t(id)) a, (SELECT CAST(id AS INT) i FROM range(-2, 3) t(id)) b, (SELECT CAST(id AS INT) i FROM range(-2, 3) t(id)) c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4)"
MASK = "m AS (SELECT z, y, x FROM vox WHERE v > 45000)"
ALL = "e AS (SELECT z, y, x FROM vox)"


def dil(src: str, dst: str) -> str:
    return f"{dst} AS (SELECT DISTINCT CAST({src}.z + dz AS INT) z, CAST({src}.y + dy AS INT) y, CAST({src}.x + dx AS INT) x FROM {src}, o, dim WHERE {src}.z + dz BETWEEN 0 AND nz - 1 AND {src}.y + dy BETWEEN 0 AND 19 AND {src}.x + dx BETWEEN 0 AND 63)"


def minus(a: str, b: str, dst: str) -> str:
    return f"{dst} AS (SELECT z, y, x FROM {a} EXCEPT SELECT z, y, x FROM {b})"


def mask(spark, d, t: int = 45000):
    return fx.vox(spark, d).where(F.col("v") > t).select(*ZYX)


@query("vox dim", f"WITH {MASK}, {OFF2}, {dil('m', 'r')} SELECT * FROM r")
def m1_dilate(spark, d):
    return stencil.dilate(mask(spark, d), 2, fx.shape(spark, d))


LOW = "m AS (SELECT z, y, x FROM vox WHERE v > 25000)"
ERODE = f"{OFF2}, {minus('e', 'm', 'c')}, {dil('c', 'cd')}, {minus('m', 'cd', 'r')}"


@query("vox dim", f"WITH {LOW}, {ALL}, {ERODE} SELECT * FROM r")
def m1_erode(spark, d):
    return stencil.erode(mask(spark, d, 25000), 2, fx.shape(spark, d), fx.lines(spark, d))


@query("vox dim", f"WITH {LOW}, {ALL}, {ERODE}, {dil('r', 'q')} SELECT * FROM q")
def m5_open(spark, d):
    return stencil.opened(mask(spark, d, 25000), 2, fx.shape(spark, d), fx.lines(spark, d))


@query("vox dim", f"WITH {MASK}, {ALL}, {OFF2}, {dil('m', 'd')}, {minus('e', 'd', 'c')}, {dil('c', 'cd')}, {minus('d', 'cd', 'q')} SELECT * FROM q")
def m5_close(spark, d):
    return stencil.closed(mask(spark, d), 2, fx.shape(spark, d), fx.lines(spark, d))


@query("vox dim", f"WITH {MASK}, {OFF2}, {dil('m', 'r')}, {dil('r', 'q')} SELECT * FROM q")
def m4_dilate_in_passes(spark, d):
    return stencil.morph(mask(spark, d), 4, fx.shape(spark, d), split=2)


@query()
def m2_dilate_16(spark, d):
    """A sphere of radius 16, exact: 797 runs an interval, not 17077 offsets a voxel."""
    return stencil.dilate(mask(spark, d, 60000), 16, fx.extent(spark, d))


@query("vox dim", f"WITH {MASK} SELECT DISTINCT CAST(z + a.id AS INT) AS z, CAST(y + b.id AS INT) AS y, CAST(x + c.id AS INT) AS x FROM m, dim, range(-2, 3) a(id), range(-2, 3) b(id), range(-2, 3) c(id) WHERE z + a.id BETWEEN 0 AND nz - 1 AND y + b.id BETWEEN 0 AND 19 AND x + c.id BETWEEN 0 AND 63")
def m16_dilate_box(spark, d):
    return stencil.dilate_box(mask(spark, d), 2, fx.shape(spark, d))


@query("vox dim", f"WITH {MASK} SELECT DISTINCT CAST(z + a.id AS INT) AS z, CAST(y + b.id AS INT) AS y, CAST(x + c.id AS INT) AS x FROM m, dim, range(-2, 3) a(id), range(-2, 3) b(id), range(-2, 3) c(id) WHERE abs(a.id) + abs(b.id) + abs(c.id) <= 2 AND z + a.id BETWEEN 0 AND nz - 1 AND y + b.id BETWEEN 0 AND 19 AND x + c.id BETWEEN 0 AND 63")
def m16_dilate_cross(spark, d):
    return stencil.dilate_cross(mask(spark, d), 2, fx.shape(spark, d))


@query()
def m16_fill_holes(spark, d):
    return stencil.fill_holes(mask(spark, d, 30000), fx.extent(spark, d))


@query("vox dim", f"WITH {MASK} SELECT DISTINCT z, CAST(y + b.id AS INT) AS y, CAST(x + c.id AS INT) AS x FROM m, range(-3, 4) b(id), range(-3, 4) c(id) WHERE abs(b.id) + abs(c.id) <= 3 AND y + b.id BETWEEN 0 AND 19 AND x + c.id BETWEEN 0 AND 63")
def m13_ridge_dilation(spark, d):
    return stencil.dilate_cross(mask(spark, d), 3, fx.shape(spark, d), ("y", "x"))


def weights(sigma: float, radius: int) -> str:
    from voxelith.operators.histogram import kernel

    return "w(o, w) AS (VALUES " + ", ".join(f"({i - radius}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(kernel(sigma, radius))) + ")"


@query("vox", f"WITH {weights(1.0, 3)} SELECT z, y, CAST(x + o AS INT) AS x, round(sum(w * v), 6) AS f FROM vox, w WHERE x + o BETWEEN 0 AND 63 GROUP BY 1, 2, 3")
def m7_convolve_x(spark, d):
    from voxelith.operators.histogram import kernel

    f = fx.vox(spark, d).select(*ZYX, F.col("v").cast("double").alias("f"))
    return rounded(stencil.convolve(f, kernel(1.0, 3), "x", fx.shape(spark, d)), 6)


STEP = f"{weights(1.0, 2)}, z1 AS (SELECT CAST(z + o AS INT) z, y, x, sum(w) f FROM m, w, dim WHERE z + o BETWEEN 0 AND nz - 1 GROUP BY 1, 2, 3), y1 AS (SELECT z, CAST(y + o AS INT) y, x, sum(w * f) f FROM z1, w WHERE y + o BETWEEN 0 AND 19 GROUP BY 1, 2, 3), x1 AS (SELECT z, y, CAST(x + o AS INT) x, sum(w * f) f FROM y1, w WHERE x + o BETWEEN 0 AND 63 GROUP BY 1, 2, 3)"


@query("vox dim", f"WITH m AS (SELECT z, y, x FROM vox WHERE v > 55000), {STEP} SELECT z, y, x, round(CASE WHEN m.z IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE f END, 9) AS f FROM x1 LEFT JOIN m USING (z, y, x)".replace("CASE WHEN m.z IS NOT NULL", "CASE WHEN EXISTS (SELECT 1 FROM m q WHERE q.z = x1.z AND q.y = x1.y AND q.x = x1.x)").replace(" LEFT JOIN m USING (z, y, x)", ""))
def m8_diffusion_step(spark, d):
    from voxelith.operators.histogram import kernel

    m = mask(spark, d, 55000)
    return rounded(stencil.diffusion_step(m.withColumn("f", F.lit(1.0)), m, kernel(1.0, 2), fx.shape(spark, d)), 9)


@query()
def m9_diffusion(spark, d):
    return stencil.diffuse(mask(spark, d, 58000), 1.0, 3, fx.extent(spark, d), 2)


@query("box", """WITH m AS (SELECT z, y, x FROM box WHERE v > 45000)
SELECT b.z, b.y, b.x, CAST(min((b.z - m.z) * (b.z - m.z) + (b.y - m.y) * (b.y - m.y) + (b.x - m.x) * (b.x - m.x)) AS DOUBLE) AS d2 FROM box b, m GROUP BY 1, 2, 3""")
def m12_distance_box(spark, d):
    return distance.squared_distances(fx.box(fx.vox(spark, d)).where("v > 45000"), fx.SHAPE_BOX)


@query()
def m12_distance(spark, d):
    return distance.distances(mask(spark, d, 55000), fx.extent(spark, d))


@query("vox", """WITH s AS (SELECT a.z, a.y, a.x, a.v, avg(CAST(b.v AS DOUBLE)) m, sqrt(greatest(0, avg(CAST(b.v AS DOUBLE) * b.v) - avg(CAST(b.v AS DOUBLE)) * avg(CAST(b.v AS DOUBLE)))) sd
 FROM vox a JOIN vox b ON a.z = b.z AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE a.z < 5 GROUP BY 1, 2, 3, 4) SELECT z, y, x, v, round(m * (1 + CAST(0.2 AS DOUBLE) * (sd / 32768 - 1)), 4) AS t FROM s""")
def d20_local_threshold(spark, d):
    return rounded(stencil.local_threshold(fx.vox(spark, d).where("z < 5"), 2), 4)


@query("vox", """WITH a AS (SELECT z, y, x, v, sum(CAST(v AS DOUBLE)) OVER w s, sum(CAST(v AS DOUBLE) * v) OVER w q, count(*) OVER w n FROM vox WINDOW w AS (PARTITION BY z, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT z, y, x, v, sum(s) OVER w s, sum(q) OVER w q, CAST(sum(n) OVER w AS DOUBLE) n FROM a WINDOW w AS (PARTITION BY z, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT z, y, x, v, round(s / n * (1 + CAST(0.2 AS DOUBLE) * (sqrt(greatest(0, q / n - s / n * (s / n))) / 32768 - 1)), 4) AS t FROM b""")
def d20_local_threshold_all(spark, d):
    """The adaptive threshold of every slice."""
    return rounded(stencil.local_threshold(fx.vox(spark, d), 2), 4)


CYL = "(CAST({c} AS DOUBLE) * 2 / {n} - 1) * (CAST({c} AS DOUBLE) * 2 / {n} - 1)"


def down(factor: int, ny: int, nx: int, src: str = "vox", dims: str = "nz") -> str:
    inside = f"{CYL.format(c='y', n=ny - 1)} + {CYL.format(c='x', n=nx - 1)} <= 1"
    return f"SELECT z, y, x, v FROM (SELECT CAST(z // {factor} AS INT) z, CAST(y // {factor} AS INT) y, CAST(x // {factor} AS INT) x, CAST(sum(CAST(v AS BIGINT)) // {factor**3} AS INT) v FROM {src} GROUP BY 1, 2, 3), dim WHERE z < {dims} // {factor} AND y < {ny} AND x < {nx} AND v > 0 AND {inside}"


@query("vox dim", down(2, 10, 32))
def r3_downsample_2(spark, d):
    return resample.downsample(fx.vox(spark, d), 2, fx.shape(spark, d))


@query("vox dim", down(3, 6, 21))
def r4_downsample_3(spark, d):
    return resample.downsample(fx.vox(spark, d), 3, fx.shape(spark, d))


@query("vox dim", f"WITH a AS ({down(2, 10, 32)}) {down(2, 5, 16, 'a', '(nz // 2)')}")
def r5_pyramid_4(spark, d):
    return resample.pyramid(fx.vox(spark, d), 2, fx.shape(spark, d))[4]


@query("vox field2 dim", "SELECT v.z, v.y, v.x, f.f FROM vox v, dim, field2 f WHERE f.z = least(v.z // 2, nz // 2 - 1) AND f.y = v.y // 2 AND f.x = v.x // 2")
def r8_upsample(spark, d):
    """The field at every voxel; of an incomplete last slice only the lines that are there."""
    up = resample.upsample(fx.field2(spark, d), 2, fx.extent(spark, d), last=fx.shape(spark, d)[0] // 2 - 1)
    return up.where(F.col("z") * 20 + F.col("y") < fx.lines(spark, d)).select(*ZYX, "f")


PTS = "pt AS (SELECT DISTINCT ((l_orderkey % 23) * 10 + l_linenumber) * 10000 + l_partkey % 19 * 100 + l_suppkey % 63 id, CAST(l_orderkey % 23 AS DOUBLE) + l_linenumber * CAST(0.125 AS DOUBLE) pz, CAST(l_partkey % 19 AS DOUBLE) + CAST(0.25 AS DOUBLE) py, CAST(l_suppkey % 63 AS DOUBLE) + CAST(0.75 AS DOUBLE) px FROM lineitem WHERE l_orderkey < 2000)"


def tri(c: str, n: str) -> str:
    return f"c{c} AS (SELECT id, CAST(floor(p{c} - CAST(0.5 AS DOUBLE)) + k AS INT) i, CASE WHEN k = 0 THEN 1 - (p{c} - CAST(0.5 AS DOUBLE) - floor(p{c} - CAST(0.5 AS DOUBLE))) ELSE p{c} - CAST(0.5 AS DOUBLE) - floor(p{c} - CAST(0.5 AS DOUBLE)) END w FROM pt, dim, (VALUES (0), (1)) t(k) WHERE p{c} >= CAST(0.5 AS DOUBLE) AND p{c} <= {n} - CAST(0.5 AS DOUBLE) UNION ALL SELECT id, CAST(least({n} - 1, greatest(0, floor(p{c}))) AS INT), CAST(1 AS DOUBLE) FROM pt, dim WHERE NOT (p{c} >= CAST(0.5 AS DOUBLE) AND p{c} <= {n} - CAST(0.5 AS DOUBLE)))"


@query("vox dim", f"WITH {PTS}, {tri('z', 'nz')}, {tri('y', '20')}, {tri('x', '64')} SELECT cz.id AS id, round(sum(cz.w * cy.w * cx.w * coalesce(v, 0)), 4) AS value FROM cz JOIN cy USING (id) JOIN cx USING (id) LEFT JOIN vox ON vox.z = least(cz.i, (SELECT nz - 1 FROM dim)) AND vox.y = least(cy.i, 19) AND vox.x = least(cx.i, 63) WHERE cz.w * cy.w * cx.w > 0 GROUP BY 1")
def r1_trilinear(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey < 2000")  # the points of this query, all in the volume
    pts = li.selectExpr("((l_orderkey % 23) * 10 + l_linenumber) * 10000 + l_partkey % 19 * 100 + l_suppkey % 63 id", "double(l_orderkey % 23) + l_linenumber * 0.125D pz", "double(l_partkey % 19) + 0.25D py", "double(l_suppkey % 63) + 0.75D px").distinct()
    return rounded(resample.trilinear(pts, fx.vox(spark, d), fx.shape(spark, d), ["id"]), 4)


#: The points of all rows.
PTS_ALL = PTS.replace(" WHERE l_orderkey < 2000", "")


@query("vox dim", f"WITH {PTS_ALL}, {tri('z', 'nz')}, {tri('y', '20')}, {tri('x', '64')} SELECT cz.id AS id, round(sum(cz.w * cy.w * cx.w * coalesce(v, 0)), 4) AS value FROM cz JOIN cy USING (id) JOIN cx USING (id) LEFT JOIN vox ON vox.z = least(cz.i, (SELECT nz - 1 FROM dim)) AND vox.y = least(cy.i, 19) AND vox.x = least(cx.i, 63) WHERE cz.w * cy.w * cx.w > 0 GROUP BY 1")
def r1_trilinear_all(spark, d):
    """The points of all rows; those outside the volume take its nearest voxel."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    pts = li.selectExpr("((l_orderkey % 23) * 10 + l_linenumber) * 10000 + l_partkey % 19 * 100 + l_suppkey % 63 id", "double(l_orderkey % 23) + l_linenumber * 0.125D pz", "double(l_partkey % 19) + 0.25D py", "double(l_suppkey % 63) + 0.75D px").distinct()
    return rounded(resample.trilinear(pts, fx.vox(spark, d), fx.shape(spark, d), ["id"]), 4)


@query()
def r2_sample_plane(spark, d):
    n = fx.extent(spark, d)
    return resample.sample_plane(fx.vox(spark, d), n, (32, 10, n[0] / 2), (1, 0, 0), (0, 0.6, 0.8), (-30, 30, -8, 8), (60, 32))


@query()
def a3_sampled_field_histogram(spark, d):
    nz = fx.shape(spark, d)[0]
    return resample.sampled_field_histogram(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (32, 64))


@query("vox", """WITH i AS (SELECT y, x, v FROM vox WHERE z = 0), p AS (SELECT y iy, x ix, y + CAST(0.25 AS DOUBLE) py, x + CAST(0.5 AS DOUBLE) px FROM i)
SELECT iy, ix, round(sum(CASE WHEN i.y = iy THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END * CAST(0.5 AS DOUBLE) * v), 6) AS value FROM p JOIN i ON i.y IN (iy, iy + 1) AND i.x IN (ix, ix + 1) GROUP BY 1, 2""")
def r6_bilinear(spark, d):
    image = fx.vox(spark, d).where("z = 0").select("y", "x", "v")
    pts = image.select(F.col("y").alias("iy"), F.col("x").alias("ix"), (F.col("y") + 0.25).alias("py"), (F.col("x") + 0.5).alias("px"))
    return rounded(resample.bilinear(pts, image, ["iy", "ix"]), 6)


@query()
def r7_polar_round_trip(spark, d):
    image = fx.vox(spark, d).where("z = 0").select("y", "x", "v")
    return resample.polar_to_cart(resample.cart_to_polar(image, (9.5, 31.5), 32, 128), (20, 64), (9.5, 31.5), 32, 128)


FACES = "(a.z = b.z AND a.y = b.y AND a.x = b.x + 1 OR a.z = b.z AND a.y = b.y AND a.x = b.x - 1 OR a.z = b.z AND a.x = b.x AND a.y = b.y + 1 OR a.z = b.z AND a.x = b.x AND a.y = b.y - 1 OR a.y = b.y AND a.x = b.x AND a.z = b.z + 1 OR a.y = b.y AND a.x = b.x AND a.z = b.z - 1)"
REACH = f"m AS (SELECT z, y, x, z * 128 + y * 16 + x id FROM box WHERE v > 34000), e AS (SELECT a.id a, b.id b FROM m a JOIN m b ON {FACES}), r(id, root) AS (SELECT id, id FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(root) root FROM r GROUP BY 1)"


@query("box", f"WITH {REACH} SELECT min(m.z * 128 + m.y * 16 + m.x) AS first, count(*) AS n FROM c JOIN m USING (id) GROUP BY root", recursive=True)
def c4_components_box(spark, d):
    lab = components.label_volume(fx.box(fx.vox(spark, d)).where("v > 34000"), slab=3)
    c = components.canonical(lab)
    return c.select((F.col("z") * 128 + F.col("y") * 16 + F.col("x")).alias("first"), "n")


@query("box", f"WITH {REACH}, s AS (SELECT root, count(*) n FROM c GROUP BY 1 ORDER BY n DESC, root LIMIT 1) SELECT z, y, x FROM m JOIN c USING (id) JOIN s USING (root)", recursive=True)
def c7_largest_component_box(spark, d):
    return components.largest_mask(fx.box(fx.vox(spark, d)).where("v > 34000"), slab=3)


@query()
def c7_largest_component(spark, d):
    """The largest component of the whole volume."""
    return components.largest_mask(mask(spark, d, 34000), slab=5)


@query("lab", "SELECT label, count(*) AS n FROM lab WHERE label <> 0 GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def c6_largest_label(spark, d):
    return components.largest_component(fx.labels(spark, d))


@query("lab", "SELECT min(z * 1280 + y * 64 + x) AS first, count(*) AS n FROM lab GROUP BY label")
def a12_canonical(spark, d):
    return components.canonical(fx.labels(spark, d)).select((F.col("z") * 1280 + F.col("y") * 64 + F.col("x")).alias("first"), "n")


@query("lab", "SELECT z, y, x, CAST(CASE WHEN label IN (2, 3) THEN 1 ELSE label END AS BIGINT) AS label FROM lab")
def c5_apply_renaming(spark, d):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    return components.merge_labels(fx.labels(spark, d), edges).select(*ZYX, "label")


@query()
def c4_components(spark, d):
    return components.canonical(components.label_volume(mask(spark, d, 32000), slab=5))


@query("lab", """WITH s AS (SELECT label, count(*) n, CAST(label * 3 AS DOUBLE) a, CAST(2 AS DOUBLE) b, CAST(label % 4 AS DOUBLE) c, CAST(label * 100 AS BIGINT) outside FROM lab GROUP BY 1)
SELECT *, n BETWEEN 100 AND 100000 AND a / nullif(c, 0) >= 3 AND CAST(outside AS DOUBLE) / n <= CAST(0.3 AS DOUBLE) AS cell FROM s""")
def c11_classify_cells(spark, d):
    s = fx.labels(spark, d).groupBy("label").agg(F.count("*").alias("n"), (F.first("label") * 3).cast("double").alias("a"), F.lit(2.0).alias("b"), (F.first("label") % 4).cast("double").alias("c"), (F.first("label") * 100).alias("outside"))
    return components.classify_cells(s, (100, 100000), 3, 0.3)


@query("vox", "SELECT z, y, x FROM vox WHERE v > 32000 UNION SELECT z, y, x FROM vox WHERE v % 2 = 0")
def mask_union(spark, d):
    v = fx.vox(spark, d)
    return voxels.mask_or(v.where("v > 32000"), v.where("v % 2 = 0"))
