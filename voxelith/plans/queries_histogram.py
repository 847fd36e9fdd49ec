"""Queries of histograms, thresholds, ordered operators and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelith.functions import scalar
from voxelith.operators import histogram as h
from voxelith.operators import models
from voxelith.plans import fixtures as fx
from voxelith.plans.queries_geometry import rounded
from voxelith.plans.registry import Registry

REGISTRY = query = Registry()

BIN = "CAST(floor(CAST(v - 1 AS DOUBLE) * 63 / 65534) AS INT)"
RBIN = "CAST(round(CAST(v - 1 AS DOUBLE) * 63 / 65534) AS INT)"
RADIUS = "CAST(floor(sqrt(CAST((x - 32) * (x - 32) + (y - 10) * (y - 10) AS DOUBLE))) AS INT)"
ZHIST = f"h AS (SELECT z AS \"row\", {BIN} bin, count(*) n FROM vox GROUP BY 1, 2)"
DENSE = "d AS (SELECT r.\"row\", CAST(b.id AS INT) bin, CAST(coalesce(n, 0) AS BIGINT) n FROM (SELECT DISTINCT \"row\" FROM h) r CROSS JOIN range(64) b(id) LEFT JOIN h ON h.\"row\" = r.\"row\" AND h.bin = b.id)"
W = 'OVER (PARTITION BY "row" ORDER BY bin'


def axes_sql(b: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS axis, {RADIUS if a == 'r' else a} AS \"row\", {b} AS bin, count(*) AS n FROM vox GROUP BY 2, 3" for a in "xyzr")


def zhist(spark, d, bins: int = 64):
    return h.axis_histograms(fx.vox(spark, d), 1, 65535, bins, fx.shape(spark, d), ("z",)).drop("axis")


def zdense(spark, d):
    return h.dense(zhist(spark, d), 64)


@query("vox", f"SELECT 'z' AS axis, z AS \"row\", {BIN} AS bin, count(*) AS n FROM vox GROUP BY 2, 3")
def a1_axis_histogram_z(spark, d):
    return h.axis_histograms(fx.vox(spark, d), 1, 65535, 64, (0, 20, 64), ("z",))


@query("vox", axes_sql(BIN))
def a1_axis_histograms(spark, d):
    return h.axis_histograms(fx.vox(spark, d), 1, 65535, 64, (0, 20, 64))


@query("vox", axes_sql(RBIN))
def a1_axis_histograms_rounded(spark, d):
    return h.axis_histograms(fx.vox(spark, d), 1, 65535, 64, (0, 20, 64), rounding="round")


@query("svox", """SELECT axis, "row", bin, n FROM (SELECT 'z' AS axis, z AS "row", CAST(floor(CAST(v - 1 AS DOUBLE) * 4095 / 31999) AS INT) AS bin, count(*) AS n FROM svox WHERE v <= 32000 GROUP BY 2, 3
UNION ALL SELECT 'r', CAST(floor(sqrt(CAST((x - 64) * (x - 64) + (y - 64) * (y - 64) AS DOUBLE))) AS INT), CAST(floor(CAST(v - 1 AS DOUBLE) * 4095 / 31999) AS INT), count(*) FROM svox WHERE v <= 32000 GROUP BY 2, 3)""")
def a1_axis_histograms_sparse(spark, d):
    return h.axis_histograms(fx.svox(spark, d), 1, 32000, 4096, (128, 128, 128), ("z", "r"))


FIELD = "f AS (SELECT v.*, f.f FROM vox v, dim, field2 f WHERE f.z = least(CAST(v.z * (nz // 2) // nz AS INT), nz // 2 - 1) AND f.y = v.y // 2 AND f.x = v.x // 2)"


@query("vox field2 dim", f"""WITH {FIELD} SELECT CAST(floor(CAST(f - 1 AS DOUBLE) * 31 / 65534) AS INT) AS "row", {BIN} AS bin, count(*) AS n FROM f GROUP BY 1, 2""")
def a2_field_histogram(spark, d):
    nz = fx.shape(spark, d)[0]
    return h.field_histogram(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (32, 64))


@query("lab", "SELECT r.id AS id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(16) r(id) LEFT JOIN (SELECT label, count(*) n FROM lab GROUP BY 1) ON label = r.id")
def a4_bin_count(spark, d):
    return h.bin_count(fx.labels(spark, d), "label", 16)


@query("svox", "SELECT min(v) AS lo, max(v) AS hi, greatest(min(v), 1) AS masked_lo FROM svox")
def a5_min_max(spark, d):
    from voxelith.operators.voxels import value_bounds

    return value_bounds(fx.svox(spark, d))


BIC = f"""{FIELD}, n AS (SELECT z, count(*) t, sum(CASE WHEN v BETWEEN 20000 AND 32000 THEN 1 ELSE 0 END) s FROM f WHERE f > 0 AND f < 33000 GROUP BY 1),
b AS (SELECT a.z, coalesce(1 - CAST(s AS DOUBLE) / CAST(t AS DOUBLE), CAST(0 AS DOUBLE)) bic FROM (SELECT DISTINCT z FROM vox) a LEFT JOIN n USING (z))"""


def _bic(spark, d):
    nz = fx.shape(spark, d)[0]
    return h.bone_contact(fx.vox(spark, d), fx.field2(spark, d), (nz, 20, 64), (nz // 2, 10, 32), 33000, F.col("v").between(20000, 32000))


@query("vox field2 dim", f"WITH {BIC} SELECT z, bic FROM b")
def a6_bone_contact(spark, d):
    return _bic(spark, d)


@query("vox field2 dim", f"WITH {BIC} SELECT CASE WHEN z <= 8 THEN 'low' ELSE 'high' END AS \"range\", round(avg(bic), 9) AS mean, round(stddev_pop(bic), 9) AS sd FROM b WHERE z <= 8 OR z BETWEEN 10 AND 20 GROUP BY 1")
def a7_contact_statistics(spark, d):
    return rounded(h.range_stats(_bic(spark, d), {"low": (0, 8), "high": (10, 20)}), 9)


@query("lab", "SELECT label, count(*) AS n FROM lab WHERE label > 0 GROUP BY 1")
def a11_label_sizes(spark, d):
    return h.bin_count(fx.labels(spark, d), "label").select(F.col("id").alias("label"), "n")


OTSU = f"""{ZHIST}, {DENSE}, s AS (SELECT *, CAST(coalesce(sum(n) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) c0, CAST(coalesce(sum(n * bin) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) s0,
 CAST(coalesce(sum(n * bin * bin) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) q0, CAST(sum(n) OVER (PARTITION BY "row") AS DOUBLE) ct, CAST(sum(n * bin) OVER (PARTITION BY "row") AS DOUBLE) st, CAST(sum(n * bin * bin) OVER (PARTITION BY "row") AS DOUBLE) qt FROM d),
c AS (SELECT "row", bin, CASE WHEN c0 = 0 OR ct = c0 THEN 9223372036854775807 ELSE CAST(floor(q0 - s0 * s0 / c0 + (qt - q0 - (st - s0) * (st - s0) / (ct - c0))) AS BIGINT) END crit FROM s),
o AS (SELECT "row", bin AS threshold, crit FROM (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY crit, bin) k FROM c) WHERE k = 1)"""


@query("vox", f"WITH {OTSU} SELECT * FROM o")
def a13_otsu(spark, d):
    return h.otsu(zhist(spark, d), 64)


@query("vox", f"""WITH {ZHIST}, t AS (SELECT "row", sum(n) total FROM h GROUP BY 1) SELECT avg(total) AS mean, stddev_pop(total) AS sd FROM t""")
def a14_row_sums(spark, d):
    return zhist(spark, d).groupBy("row").agg(F.sum("n").alias("total")).agg(*scalar.mean_sd("total"))


@query("vox", f"WITH {ZHIST}, m AS (SELECT n, CAST(20 AS DOUBLE) + bin % 5 m FROM h) SELECT round(sum((n - m) * (n - m)) / count(*), 6) AS e1, round(sum(CASE WHEN n - m < 0 THEN (n - m) * (n - m) ELSE 0 END) / count(*), 6) AS e2 FROM m")
def a15_residuals(spark, d):
    return rounded(h.residuals(zhist(spark, d).withColumn("m", (F.col("bin") % 5 + 20).cast("double"))), 6)


@query("svox", "SELECT axis, CAST(sum(b) AS BIGINT) AS bits FROM (SELECT 'v' AS axis, bit_count(v) b FROM svox) GROUP BY 1")
def a22_popcount(spark, d):
    return fx.svox(spark, d).agg(F.lit("v").alias("axis"), F.sum(F.bit_count("v")).cast("long").alias("bits")).select("axis", "bits")


def taps(sigma: float, border: str, table: str = "d", bins: int = 64) -> str:
    """Oracle of a smoothed row: mirrored rows joined with a weight table."""
    w = h.kernel(sigma)
    r = len(w) // 2
    values = ", ".join(f"({i - r}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w))
    mirror = f" UNION ALL SELECT \"row\", -1 - bin, n FROM {table} UNION ALL SELECT \"row\", {2 * bins - 1} - bin, n FROM {table}" if border == "reflect" else ""
    return f"w(o, w) AS (VALUES {values}), m AS (SELECT \"row\", bin, n FROM {table}{mirror}), s AS (SELECT m.\"row\", CAST(m.bin + o AS INT) bin, sum(w * n) s FROM m, w WHERE m.bin + o BETWEEN 0 AND {bins - 1} AND n <> 0 GROUP BY 1, 2)"


@query("vox", f"WITH {ZHIST}, {DENSE}, {taps(3, 'reflect')} SELECT \"row\", bin, round(s, 6) AS s FROM s")
def k1_smooth_rows(spark, d):
    return rounded(h.smooth_rows(zhist(spark, d), 64, 3), 6)


@query("vox dim", f"WITH {ZHIST}, {DENSE}, {taps(2, 'zero')}, t AS (SELECT s.bin AS \"row\", CAST(s.\"row\" + o AS INT) bin, sum(w.w * s.s) s FROM s, w GROUP BY 1, 2) SELECT bin AS \"row\", \"row\" AS bin, round(s, 6) AS s FROM t, dim WHERE bin BETWEEN 0 AND nz - 1")
def k2_smooth_plane(spark, d):
    return rounded(h.smooth_plane(zhist(spark, d), fx.shape(spark, d)[0], 64, 2), 6)


RUNS = f"""r0 AS (SELECT *, CASE WHEN lag(n) {W}) = n THEN 0 ELSE 1 END c FROM d), r1 AS (SELECT *, sum(c) {W}) g FROM r0),
r2 AS (SELECT "row", g, min(bin) a, max(bin) b, any_value(n) n FROM r1 GROUP BY 1, 2), r3 AS (SELECT *, lag(n) OVER (PARTITION BY "row" ORDER BY g) l, lead(n) OVER (PARTITION BY "row" ORDER BY g) r FROM r2),
p AS (SELECT "row", CAST(floor((a + b) / CAST(2 AS DOUBLE)) AS INT) AS bin, n FROM r3 WHERE l < n AND r < n AND n >= 30)"""


@query("vox", f"WITH {ZHIST}, {DENSE}, {RUNS} SELECT * FROM p")
def k3_find_peaks(spark, d):
    return h.peaks(zdense(spark, d), "n", 30)


@query("vox", f"""WITH {ZHIST}, {DENSE}, {RUNS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "row" ORDER BY n, bin) AS INT) AS rank FROM p) WHERE rank <= 3""")
def k4_lowest_peaks(spark, d):
    return h.ranked_peaks(h.peaks(zdense(spark, d), "n", 30), 3, lowest=True)


@query("vox", f"""WITH {ZHIST}, {DENSE}, {RUNS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "row" ORDER BY n DESC, bin) AS INT) AS rank FROM p) WHERE rank <= 2""")
def k5_highest_peaks(spark, d):
    return h.ranked_peaks(h.peaks(zdense(spark, d), "n", 30), 2)


@query("vox", f"WITH {ZHIST}, {DENSE} SELECT \"row\", bin, CAST(sum(n) {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d")
def k7_running_sum(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return zdense(spark, d).select("row", "bin", F.sum("n").over(w).alias("upto"))


@query("vox", f"""WITH {ZHIST}, {DENSE} SELECT "row", bin, n, CASE WHEN bin = 0 THEN CAST(lead(n) {W}) - n AS DOUBLE) WHEN bin = 63 THEN CAST(n - lag(n) {W}) AS DOUBLE) ELSE CAST(lead(n) {W}) - lag(n) {W}) AS DOUBLE) / 2 END AS slope FROM d""")
def k8_gradient(spark, d):
    return h.gradient(zdense(spark, d))


@query("vox", f"""WITH {ZHIST}, {DENSE} SELECT "row", bin, n, CAST(sum(n) {W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS total FROM d QUALIFY bin <= 59""")
def k9_sliding_sum(spark, d):
    return h.sliding_sum(zdense(spark, d), 5)


@query("vox", f"""WITH {ZHIST} SELECT "row", min(bin) AS first, max(bin) AS last FROM h WHERE n > 0 GROUP BY 1""")
def k11_support(spark, d):
    return h.support(zhist(spark, d))


@query("vox", f"""WITH {ZHIST}, {DENSE} SELECT "row", (SELECT bin FROM d e WHERE e."row" = r."row" ORDER BY n DESC, bin LIMIT 1) AS argmax, (SELECT bin FROM d e WHERE e."row" = r."row" ORDER BY n, bin LIMIT 1) AS argmin FROM (SELECT DISTINCT "row" FROM d) r""")
def k12_row_extremes(spark, d):
    return h.row_extremes(zdense(spark, d))


@query()
def a20_a21_valley(spark, d):
    """Threshold between the two highest peaks of the whole volume's smoothed histogram."""
    one = h.axis_histograms(fx.vox(spark, d).withColumn("z", F.lit(0)), 1, 65535, 256, (0, 20, 64), ("z",)).drop("axis")
    return h.valley(h.dense(one, 256), 256, 3)


@query("", """WITH x AS (SELECT CAST(id AS DOUBLE) / 4 x FROM range(80) t(id)) SELECT x, round(4 * exp(-CAST(0.25 AS DOUBLE) * (x - 8) * (x - 8)), 9) AS gauss, round(4 * exp(-CAST(0.25 AS DOUBLE) * abs(x - 8)), 9) AS exponential,
 round(4 * CAST(0.25 AS DOUBLE) / ((x - 8) * (x - 8) + CAST(0.25 AS DOUBLE)), 9) AS lorentz, round(4 * exp(-CAST(0.25 AS DOUBLE) * power(abs(x - 8), CAST(1.44 AS DOUBLE))), 9) AS power FROM x""")
def d1_d4_distributions(spark, d):
    x = spark.range(80).select((F.col("id") / 4.0).cast("double").alias("x"))
    one = lambda v: F.lit(float(v))
    peak = F.array(F.struct(one(2).alias("a"), one(0.5).alias("b"), one(8).alias("c"), one(1.2).alias("d")))
    cols = [models.mixture(F.col("x"), peak, k).alias(n) for k, n in (("gauss", "gauss"), ("exp", "exponential"), ("lorentz", "lorentz"), ("power", "power"))]
    return rounded(x.select("x", *cols), 9, ("x",))


@query("", """SELECT kind, width, round(CASE kind WHEN 'gauss' THEN 6 / width WHEN 'lorentz' THEN width / 4 ELSE sqrt(2 / width) END, 9) AS b
FROM (VALUES ('gauss'), ('exp'), ('power'), ('lorentz')) k(kind), (SELECT CAST(id AS DOUBLE) width FROM range(1, 9) t(id))""")
def d5_rate_from_width(spark, d):
    rows = spark.createDataFrame([(k, float(w)) for k in ("gauss", "exp", "power", "lorentz") for w in range(1, 9)], "kind string, width double")
    return rows.withColumn("b", F.round(scalar.rate_from_width(F.col("kind"), F.col("width")), 9))


@query()
def d6_d8_smooth_rows(spark, d):
    """Each row of the z histogram as a C1 piecewise cubic of twelve borders."""
    return models.smooth_groups(zdense(spark, d), "row", "bin", "n", 12)


@query()
def d9_fit_rows(spark, d):
    return models.fit_rows(zdense(spark, d), 2)


@query()
def d10_fitted_probabilities(spark, d):
    z = zdense(spark, d)
    return models.fitted_probabilities(z, models.fit_rows(z, 2), fx.shape(spark, d)[0], 64, 2)


@query()
def d11_otsu_probabilities(spark, d):
    return models.otsu_probabilities(zhist(spark, d), 64)


@query("vox field2 dim prob", f"""WITH {FIELD}, b AS (SELECT z, y, x, CAST(floor((least(65535, greatest(1, CAST(f AS DOUBLE))) - 1) * 15 / 65534) AS INT) fb, CAST(floor(CAST(v - 1 AS DOUBLE) * 31 / 65534) AS INT) vb FROM f)
SELECT z, y, x, material, CAST(round(p * 65535) AS INT) AS p16 FROM b JOIN prob ON field_bin = fb AND voxel_bin = vb""")
def d13_material_probability(spark, d):
    nz = fx.shape(spark, d)[0]
    return models.material_probability(fx.vox(spark, d), fx.field2(spark, d), fx.prob(spark), (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (16, 32))


@query()
def d13_material_probability_trilinear(spark, d):
    nz = fx.shape(spark, d)[0]
    return models.material_probability(fx.vox(spark, d), fx.field2(spark, d), fx.prob(spark), (nz, 20, 64), (nz // 2, 10, 32), (1, 65535), (1, 65535), (16, 32), "trilinear")


@query("vox prob", """WITH b AS (SELECT z, y, x, v, CAST(floor(CAST(v - 1 AS DOUBLE) * 31 / 65534) AS INT) vb FROM vox)
SELECT b.z, b.y, b.x, b.v, round(CAST(0.25 AS DOUBLE) * p.p + CAST(0.75 AS DOUBLE) * q.p, 9) AS total FROM b JOIN prob p ON p.material = 0 AND p.field_bin = b.y % 16 AND p.voxel_bin = vb JOIN prob q ON q.material = 1 AND q.field_bin = b.x % 16 AND q.voxel_bin = vb""")
def d14_weighted_probability(spark, d):
    p = fx.prob(spark)
    t = {k: p.where(F.col("material") == m).select(F.col("field_bin").alias("row"), F.col("voxel_bin").alias("bin"), "p") for k, m in (("y", 0), ("x", 1))}
    out = models.weighted_probability(fx.vox(spark, d), {"y": (t["y"], 0.25), "x": (t["x"], 0.75)}, {"y": F.col("y") % 16, "x": F.col("x") % 16}, (1, 65535), 32)
    return rounded(out, 9)


@query("vox", f"""WITH {ZHIST}, m AS (SELECT "row" AS label, CAST(sum(bin * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) mean FROM h GROUP BY 1)
SELECT label, round(mean, 9) AS mean, CASE WHEN abs(mean - 10) <= abs(mean - 28) AND abs(mean - 10) <= abs(mean - 40) THEN 1 WHEN abs(mean - 28) <= abs(mean - 40) THEN 2 ELSE 3 END AS material FROM m""")
def d15_nearest_peak(spark, d):
    return rounded(models.nearest_peak(zhist(spark, d).withColumnRenamed("row", "label"), [10, 28, 40]), 9)


def _whole(spark, d):
    return zhist(spark, d).groupBy("bin").agg(F.sum("n").alias("n"))


@query()
def d16_clusters(spark, d):
    return spark.createDataFrame(list(enumerate(models.cluster_1d(_whole(spark, d), [10.0, 30.0, 50.0]))), "cluster int, centre double")


@query()
def d17_absorption_classes(spark, d):
    return models.absorption_classes(_whole(spark, d), [10.0, 50.0])


@query()
def d18_piecewise_quadratic(spark, d):
    """The volume's histogram as a C1 piecewise quadratic of eight segments."""
    rows = _whole(spark, d).orderBy("bin").toPandas()  # one row a bin
    fit = models.fit_piecewise(rows["bin"], rows["n"], np.linspace(0, 64, 9), degree=2)
    return spark.createDataFrame(pd.DataFrame({"bin": rows["bin"], "smooth": models.eval_piecewise(rows["bin"], fit, degree=2)}))


@query()
def m18_fft_rows(spark, d):
    f = models.fft_rows(zhist(spark, d), 64)
    return f.select("row", "k", *[(F.round(c, 4) + 0.0).alias(c) for c in ("re", "im")])
