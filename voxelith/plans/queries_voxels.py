"""Queries of scans, scalar maps, filters, packing and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.functions import scalar
from voxelith.operators import align, voxels
from voxelith.plans import fixtures as fx
from voxelith.plans.registry import Registry

REGISTRY = query = Registry()
ZYX = ["z", "y", "x"]


@query("vox", "SELECT z, y, x, v FROM vox WHERE z >= 5 AND z < 12 AND y >= 2 AND y < 18 AND x >= 8 AND x < 40")
def s1_load_slice(spark, d):
    return fx.vox(spark, d).where("z >= 5 and z < 12 and y >= 2 and y < 18 and x >= 8 and x < 40")


@query("svox", "SELECT z, y, x, v // 256 AS msb, v % 256 AS lsb, (v // 256) * 256 + v % 256 AS v FROM svox")
def s14_byte_split(spark, d):
    v = fx.svox(spark, d)
    high, low = scalar.split_bytes(F.col("v"))
    return v.select(*ZYX, high.cast("int").alias("msb"), low.cast("int").alias("lsb"), scalar.merge_bytes(high, low).cast("int").alias("v"))


@query("vox", """WITH b AS (SELECT min(v) lo, max(v) hi FROM vox)
SELECT z, y, x, CAST(floor((CAST(v AS DOUBLE) - lo) / (hi - lo) * 65535) AS INT) AS v16 FROM vox, b""")
def s15_raw_to_16_bit(spark, d):
    v = fx.vox(spark, d)
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    return v.select(*ZYX, scalar.to_full_range(F.col("v"), lo, hi).alias("v16"))


@query("svox", "SELECT z, y, x, v, CASE WHEN z < 40 THEN 0 WHEN z < 90 THEN 1 ELSE 2 END AS subvolume FROM svox")
def s16_subvolumes(spark, d):
    return fx.svox(spark, d).withColumn("subvolume", voxels.subvolume_of(F.col("z"), [40, 50, 38]))


@query("svox", """SELECT CAST(CASE WHEN z < 36 THEN z WHEN z < 40 THEN NULL WHEN z < 84 THEN z - 4 WHEN z < 90 THEN NULL ELSE z - 10 END AS INT) AS z, y, x, v
FROM svox WHERE NOT (z >= 36 AND z < 40) AND NOT (z >= 84 AND z < 90)""")
def s17_join_subvolumes(spark, d):
    return align.join_subvolumes(fx.svox(spark, d), [40, 50, 38], [4, 6], keep="lower").select(*ZYX, "v")


@query("vox field2 dim", """SELECT v.z, v.y, v.x, v.v, f.f FROM vox v, dim, field2 f
WHERE f.z = least(CAST(v.z * (nz // 2) // nz AS INT), nz // 2 - 1) AND f.y = v.y // 2 AND f.x = v.x // 2 AND v.z < 10""")
def s18_load_chunk(spark, d):
    nz = fx.shape(spark, d)[0]
    return align.with_field(fx.vox(spark, d).where("z < 10"), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32)).select(*ZYX, "v", "f")


@query("", """WITH s(i, nz) AS (VALUES (0, 40), (1, 50), (2, 38))
SELECT i, nz, CAST(coalesce(sum(nz) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s""")
def s19_chunk_table(spark, d):
    return align.starts(spark.createDataFrame([(0, 40), (1, 50), (2, 38)], "i int, nz int"), "i", "nz")


@query("vox dim", """SELECT axis, z, y, x, v FROM (SELECT 'z' AS axis, * FROM vox, dim WHERE z = nz // 2 UNION ALL SELECT 'y', * FROM vox, dim WHERE y = 10
UNION ALL SELECT 'x', * FROM vox, dim WHERE x = 32)""")
def s24_middle_planes(spark, d):
    return voxels.middle_planes(fx.vox(spark, d), fx.shape(spark, d)).select("axis", *ZYX, "v")


@query("vox", "SELECT z, y, x, v FROM vox WHERE v > 45000")
def u1_threshold(spark, d):
    return voxels.threshold(fx.vox(spark, d), 45000)


@query("svox", "SELECT z, y, x, v FROM svox WHERE v BETWEEN 20000 AND 32000 AND v <> 0")
def u2_value_range(spark, d):
    return voxels.value_range(fx.svox(spark, d), 20000, 32000)


@query("vox", """WITH b AS (SELECT max(v) hi FROM vox)
SELECT z, y, x, CAST(least(CAST(floor((CAST(v AS DOUBLE) - 1) / (hi - 1) * 65535) AS BIGINT) + 1, 65535) AS INT) AS clamped,
 CAST((CAST(floor((CAST(v AS DOUBLE) - 1) / (hi - 1) * 65535) AS BIGINT) + 1) % 65536 AS INT) AS wrapped FROM vox, b""")
def u3_normalize(spark, d):
    v = fx.vox(spark, d)
    hi = v.agg(F.max("v")).first()[0]
    return v.select(*ZYX, scalar.normalize(F.col("v"), 1, hi).alias("clamped"), scalar.normalize(F.col("v"), 1, hi, ref_compat=True).alias("wrapped"))


@query("vox", """SELECT z, y, x, v FROM vox WHERE (CAST(y AS DOUBLE) * CAST(2 AS DOUBLE) / 19 - 1) * (CAST(y AS DOUBLE) * CAST(2 AS DOUBLE) / 19 - 1)
 + (CAST(x AS DOUBLE) * CAST(2 AS DOUBLE) / 63 - 1) * (CAST(x AS DOUBLE) * CAST(2 AS DOUBLE) / 63 - 1) < 1""")
def u4_cylinder_mask(spark, d):
    return fx.vox(spark, d).where(scalar.cylinder(F.col("y"), F.col("x"), 20, 64))


@query("", """WITH c AS (SELECT CAST(id AS INT) i, CAST(2 AS DOUBLE) * id / 8 - 1 p FROM range(9) t(id))
SELECT a.i AS z, b.i AS y, c.i AS x FROM c a, c b, c WHERE a.p * a.p + b.p * b.p + c.p * c.p <= CAST(1.000000000001 AS DOUBLE)""")
def u5_sphere(spark, d):
    from voxelith.operators.stencil import ball

    return spark.createDataFrame(ball(9), "z int, y int, x int")


@query("vox", """WITH b AS (SELECT min(v) lo, max(v) hi FROM vox)
SELECT z, y, x, CAST(floor((CAST(v AS DOUBLE) - lo) / (hi - lo) * 255) AS INT) AS full_range,
 CAST(floor((CAST(v AS DOUBLE) - lo) / (hi - lo) * 65534) + 1 AS INT) AS positive FROM vox, b""")
def u6_u7_to_int(spark, d):
    v = fx.vox(spark, d)
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    return v.select(*ZYX, scalar.to_full_range(F.col("v"), lo, hi, 255).alias("full_range"), scalar.to_positive_range(F.col("v"), lo, hi).alias("positive"))


@query("vox", """SELECT z, y, x, CAST(floor(CAST(v AS DOUBLE) / 65535 * 255) AS INT) AS u8, CAST(floor(CAST(v AS DOUBLE) / 65535 * 65535) AS INT) AS u16,
 CASE WHEN v > 45000 THEN CAST(1 AS DOUBLE) ELSE CAST(v AS DOUBLE) / 65535 END AS lit, CAST(v > 45000 AS INT) AS mask FROM vox""")
def u8_u9_conversions(spark, d):
    f = F.col("v").cast("double") / 65535.0
    lit = scalar.illuminate((F.col("v") > 45000).cast("int"), f)
    return fx.vox(spark, d).select(*ZYX, scalar.unit_to_int(f, 8).alias("u8"), scalar.unit_to_int(f, 16).alias("u16"), lit.alias("lit"), scalar.lit_mask(lit).alias("mask"))


@query("lab", "SELECT z, y, x, label, CASE WHEN label IN (2, 3, 7) THEN 1 ELSE 0 END AS member FROM lab")
def u10_where_in(spark, d):
    ids = spark.createDataFrame([(2,), (3,), (7,)], "label long")
    return voxels.membership(fx.labels(spark, d), ids).select(*ZYX, "label", "member")


@query("vox", "SELECT z, y, CAST(x // 32 AS INT) AS xw, CAST(sum(CAST(1 AS BIGINT) << (31 - x % 32)) AS BIGINT) AS w FROM vox WHERE v > 32000 GROUP BY 1, 2, 3")
def u11_pack(spark, d):
    return voxels.pack_bits(fx.vox(spark, d).where("v > 32000"))


@query("vox", "SELECT z, y, x FROM vox WHERE v > 32000")
def u11_unpack(spark, d):
    return voxels.unpack_bits(voxels.pack_bits(fx.vox(spark, d).where("v > 32000")))


@query("vox", """SELECT CAST(z - 3 AS INT) AS z, CAST(y - 2 AS INT) AS y, CAST(x // 32 - 1 AS INT) AS xw, CAST(sum(CAST(1 AS BIGINT) << (31 - x % 32)) AS BIGINT) AS w
FROM vox WHERE v > 32000 AND z BETWEEN 3 AND 15 AND y BETWEEN 2 AND 17 AND x BETWEEN 32 AND 63 GROUP BY 1, 2, 3""")
def u12_packed_slice(spark, d):
    return voxels.packed_slice(voxels.pack_bits(fx.vox(spark, d).where("v > 32000")), (3, 15, 2, 17, 32, 63))


@query("vox", """WITH a AS (SELECT z, y, x // 32 xw, sum(CASE WHEN v > 30000 AND v % 2 = 0 THEN CAST(1 AS BIGINT) << (31 - x % 32) ELSE 0 END) w1,
 sum(CASE WHEN v > 30000 AND v % 2 = 1 THEN CAST(1 AS BIGINT) << (31 - x % 32) ELSE 0 END) w2 FROM vox GROUP BY 1, 2, 3)
SELECT 'and' AS op, z, y, CAST(xw AS INT) AS xw, CAST(w1 AS BIGINT) AS w FROM a WHERE w1 <> 0
UNION ALL SELECT 'not', z, y, CAST(xw AS INT), CAST(w2 AS BIGINT) FROM a WHERE w2 <> 0
UNION ALL SELECT 'or', z, y, CAST(xw AS INT), CAST(w1 + w2 AS BIGINT) FROM a WHERE w1 + w2 <> 0""")
def u13_packed_algebra(spark, d):
    v = fx.vox(spark, d)
    a, b = voxels.pack_bits(v.where("v > 30000")), voxels.pack_bits(v.where("v % 2 = 0"))
    both, rest = voxels.packed_and(a, b), voxels.packed_and_not(a, b)
    parts = {"and": both, "not": rest, "or": voxels.packed_or(both, rest)}
    out = None
    for k, t in parts.items():
        t = t.select(F.lit(k).alias("op"), "z", "y", "xw", "w")
        out = t if out is None else out.unionByName(t)
    return out


@query("vox dim", """SELECT z, y, x, v FROM vox, dim WHERE CAST(0.6 AS DOUBLE) * (x - 32) + CAST(0.8 AS DOUBLE) * (y - 10) BETWEEN -12 AND 12
 AND CAST(0.8 AS DOUBLE) * (x - 32) - CAST(0.6 AS DOUBLE) * (y - 10) BETWEEN -20 AND 20 AND z - nz // 2 BETWEEN -8 AND 8""")
def u14_zero_outside(spark, d):
    nz = fx.shape(spark, d)[0]
    return voxels.zero_outside(fx.vox(spark, d), (32, 10, nz // 2), [(0.6, 0.8, 0), (0.8, -0.6, 0), (0, 0, 1)], (-12, -20, -8), (12, 20, 8))


@query("svox", "SELECT z, y, x, v FROM svox WHERE z BETWEEN 10 AND 60 AND y BETWEEN 20 AND 90 AND x BETWEEN 5 AND 100")
def u15_in_bbox(spark, d):
    return voxels.bounding_box(fx.svox(spark, d), (10, 60, 20, 90, 5, 100))


HIST = "h AS (SELECT z AS \"row\", CAST(floor(CAST(v - 1 AS DOUBLE) * 63 / 65534) AS INT) bin, count(*) n FROM vox GROUP BY 1, 2)"


def _hist(spark, d):
    from voxelith.operators.histogram import axis_histograms

    return axis_histograms(fx.vox(spark, d), 1, 65535, 64, fx.shape(spark, d), ("z",)).drop("axis")


@query("vox", f"""WITH {HIST} SELECT "row", bin, CAST(n AS DOUBLE) / (1 + max(n) OVER (PARTITION BY "row")) AS share FROM h""")
def u17_row_normalize(spark, d):
    return voxels.row_normalize(_hist(spark, d)).select("row", "bin", "share")


@query("vox", f"""WITH {HIST} SELECT CAST("row" // 2 AS INT) AS "row", CAST(bin // 2 AS INT) AS bin, n FROM h WHERE "row" % 2 = 0 AND bin % 2 = 0""")
def u20_subsample(spark, d):
    return voxels.subsample(_hist(spark, d), 2)


@query("field2", """WITH j AS (SELECT z, y, x, CAST(f AS DOUBLE) g, CAST(f * 7 % 1000 + 1 AS DOUBLE) e FROM field2),
m AS (SELECT max(g) gm, max(e) em FROM j), r AS (SELECT z, y, x, g / gm - e / em c FROM j, m), b AS (SELECT min(c) lo, max(c) hi FROM r)
SELECT z, y, x, CAST(floor(((c + abs(lo)) / (hi + abs(lo)) - 0) / (1 - 0) * 65535) AS INT) AS f FROM r, b
WHERE (CAST(y AS DOUBLE) * 2 / 9 - 1) * (CAST(y AS DOUBLE) * 2 / 9 - 1) + (CAST(x AS DOUBLE) * 2 / 31 - 1) * (CAST(x AS DOUBLE) * 2 / 31 - 1) < 1""")
def u19_combine_fields(spark, d):
    f = fx.field2(spark, d)
    return voxels.combine_fields(f, f.withColumn("f", F.col("f") * 7 % 1000 + 1), 10, 32)


@query("svox", "SELECT z, y, x, CAST(v >> 8 AS INT) AS high, CAST(v AS DOUBLE) * (200 - 100 + 1) / 65535 + 100 AS value FROM svox")
def u21_u22_shift_and_dequantise(spark, d):
    return fx.svox(spark, d).select(*ZYX, F.shiftright("v", 8).alias("high"), scalar.dequantise(F.col("v"), 100, 200).alias("value"))


@query("vox svox", "SELECT a.z, a.y, a.x, a.v, b.v AS w FROM vox a JOIN svox b USING (z, y, x)")
def j1_equi_join(spark, d):
    return fx.vox(spark, d).join(fx.svox(spark, d).withColumnRenamed("v", "w"), ZYX)


@query("vox field2 dim", """SELECT v.z, v.y, v.x, v.v, f.f FROM vox v, dim, field2 f
WHERE f.z = least(CAST(v.z * (nz // 2) // nz AS INT), nz // 2 - 1) AND f.y = v.y // 2 AND f.x = v.x // 2""")
def j2_scale_aligned_join(spark, d):
    nz = fx.shape(spark, d)[0]
    return align.with_field(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32)).select(*ZYX, "v", "f")


@query("vox prob", """SELECT v.z, v.y, v.x, p.material, p.p FROM vox v JOIN prob p
ON p.field_bin = v.y % 16 AND p.voxel_bin = CAST(floor(CAST(v.v - 1 AS DOUBLE) * 31 / 65534) AS INT)""")
def j3_table_lookup(spark, d):
    binned = fx.vox(spark, d).withColumn("field_bin", (F.col("y") % 16).cast("int")).withColumn("voxel_bin", scalar.value_bin(F.col("v"), 1, 65535, 32))
    return align.with_table(binned, fx.prob(spark)).select(*ZYX, "material", "p")


@query("vox svox", "SELECT z, y, x, v FROM vox a WHERE EXISTS (SELECT 1 FROM svox b WHERE a.z = b.z AND a.y = b.y AND a.x = b.x)")
def j5_semi_join(spark, d):
    return voxels.mask_and(fx.vox(spark, d), fx.svox(spark, d))


@query("vox svox", "SELECT z, y, x, v FROM vox a WHERE NOT EXISTS (SELECT 1 FROM svox b WHERE a.z = b.z AND a.y = b.y AND a.x = b.x)")
def j6_anti_join(spark, d):
    return voxels.mask_and_not(fx.vox(spark, d), fx.svox(spark, d))


@query("vox", """SELECT DISTINCT a.label AS label_a, b.label AS label_b FROM (SELECT z, y, x, v % 50 label FROM vox WHERE v > 40000) a
JOIN (SELECT z, y, x, v % 50 label FROM vox WHERE v > 40000) b ON b.z = a.z + 1 AND a.y = b.y AND a.x = b.x WHERE a.z % 5 = 4""")
def j8_slab_boundary(spark, d):
    lab = fx.vox(spark, d).where("v > 40000").withColumn("label", F.col("v") % 50)
    return align.slab_pairs(lab, 5)


@query("vox", """WITH t AS (SELECT z, y, x, CAST(v AS DOUBLE) v FROM vox WHERE z < 12), b AS (SELECT CAST(z - 8 AS INT) z, y, x, CAST(v AS DOUBLE) v FROM vox WHERE z >= 8 AND z < 20),
s AS (SELECT CAST(id AS INT) s, least(CAST(id AS INT), 6) n FROM range(2, 9) r(id))
SELECT s AS shift, round(sum(power((t.v - b.v) / (n * CAST(1280 AS DOUBLE)), 2)), 6) AS score FROM s, t, b
WHERE t.z >= 12 - n AND b.z = t.z - (12 - n) + greatest(0, s - 6) AND b.y = t.y AND b.x = t.x GROUP BY 1""")
def a9_match_scores(spark, d):
    v = fx.vox(spark, d)
    s = align.match_scores(v.where("z < 12"), v.where("z >= 8 and z < 20").withColumn("z", F.col("z") - 8), 12, 6, 1280, (2, 8))
    return s.select("shift", F.round("score", 6).alias("score"))


@query("vox", """WITH t AS (SELECT z, y, x, CAST(v AS DOUBLE) v FROM vox WHERE z < 12), b AS (SELECT CAST(z - 8 AS INT) z, y, x, CAST(v AS DOUBLE) v FROM vox WHERE z >= 8 AND z < 20),
s AS (SELECT CAST(id AS INT) s, least(CAST(id AS INT), 6) n FROM range(2, 9) r(id)),
c AS (SELECT s AS shift, sum(power((t.v - b.v) / (n * CAST(1280 AS DOUBLE)), 2)) AS score FROM s, t, b
WHERE t.z >= 12 - n AND b.z = t.z - (12 - n) + greatest(0, s - 6) AND b.y = t.y AND b.x = t.x GROUP BY 1)
SELECT shift, CAST(shift - 2 AS INT) AS ref_index FROM c ORDER BY score, shift LIMIT 1""")
def a10_best_shift(spark, d):
    v = fx.vox(spark, d)
    return align.best_shift(align.match_scores(v.where("z < 12"), v.where("z >= 8 and z < 20").withColumn("z", F.col("z") - 8), 12, 6, 1280, (2, 8)))


@query("svox", "SELECT segment, CAST(sum(v) AS BIGINT) AS value FROM (SELECT z % 10 AS segment, v FROM svox) GROUP BY 1")
def a17_segment_reduce(spark, d):
    from voxelith.operators.histogram import segment_reduce

    return segment_reduce(fx.svox(spark, d).withColumn("segment", F.col("z") % 10), "segment", "v")


@query("vox dim", """WITH f AS (SELECT z, y, x, v f FROM vox WHERE z < 4 AND y < 5 AND x < 16)
SELECT v.z, v.y, v.x, v.v FROM vox v JOIN f ON f.z = least(v.z // 4, 3) AND f.y = v.y // 4 AND f.x = v.x // 4 WHERE f.f > 30000""")
def r8_block_mask(spark, d):
    v = fx.vox(spark, d)
    return align.block_mask(v, v.where("z < 4 and y < 5 and x < 16 and v > 30000"), 4, 3).select(*ZYX, "v")
