"""SQL of queries whose oracles chain several operators."""

from __future__ import annotations

from voxelith.operators.histogram import kernel
from voxelith.operators.stencil import sphere_runs
from voxelith.plans.queries_histogram import BIN, FIELD, ZHIST, taps
from voxelith.plans.queries_stencil import CYL
from voxelith.plans.registry import with_ctes

ORACLES: dict[str, str] = {}
BOX = "e AS (SELECT CAST(a.id AS INT) z, CAST(b.id AS INT) y, CAST(c.id AS INT) x FROM ext, range(nz) a(id), range(20) b(id), range(64) c(id))"


def add(name: str, ctes: str, body: str, recursive: bool = False) -> None:
    ORACLES[name] = with_ctes(ctes, body.strip(), recursive)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows) + ")"


def ball(radius: int) -> str:
    return values(f"o{radius}", "dz, dy, w", sphere_runs(radius))


def grow(src: str, dst: str, radius: int) -> str:
    """All voxels within a radius, by the sphere's runs along x."""
    return f"{dst} AS (SELECT DISTINCT z, y, CAST(x AS INT) x FROM (SELECT CAST(z + dz AS INT) z, CAST(y + dy AS INT) y, unnest(range(greatest(0, x - w), least(63, x + w) + 1)) x FROM {src}, o{radius}, ext WHERE z + dz BETWEEN 0 AND nz - 1 AND y + dy BETWEEN 0 AND 19))"


def less(a: str, b: str, dst: str) -> str:
    return f"{dst} AS (SELECT z, y, x FROM {a} EXCEPT SELECT z, y, x FROM {b})"


def shrink(src: str, dst: str, radius: int) -> str:
    return f"{less('e', src, dst + '_c')}, {grow(dst + '_c', dst + '_g', radius)}, {less(src, dst + '_g', dst)}"


def opened(src: str, dst: str, radius: int) -> str:
    return f"{shrink(src, dst + '_e', radius)}, {grow(dst + '_e', dst, radius)}"


def closed(src: str, dst: str, radius: int) -> str:
    return f"{grow(src, dst + '_d', radius)}, {shrink(dst + '_d', dst, radius)}"


def share(soft: str, bone: str, radius: int, grown: int) -> str:
    """Of opened bone the share near closed, opened and grown soft tissue."""
    balls = ", ".join(ball(r) for r in {radius, grown})
    return f"""WITH {BOX}, {balls}, s AS (SELECT z, y, x FROM vox WHERE {soft}), b AS (SELECT z, y, x FROM vox WHERE {bone}),
{closed('s', 's1', radius)}, {opened('s1', 's2', radius)}, {grow('s2', 'near', grown)}, {opened('b', 'base', radius)},
hit AS (SELECT z, y, x FROM base INTERSECT SELECT z, y, x FROM near)
SELECT CAST((SELECT count(*) FROM hit) AS DOUBLE) / nullif(count(*), 0) AS share, count(*) AS n FROM base"""


add("m2_dilate_16", "vox ext", f"WITH m AS (SELECT z, y, x FROM vox WHERE v > 60000), {ball(16)}, {grow('m', 'r', 16)} SELECT * FROM r")
add("a8_healthy_bone_grown", "vox ext", share("v BETWEEN 24000 AND 40000", "v > 30000", 1, 2))
add("q13_healthy_bone", "vox ext", share("v BETWEEN 20000 AND 32000", "v > 22000", 1, 1))

add("m16_fill_holes", "vox ext", f"""WITH {BOX}, m AS (SELECT z, y, x FROM vox WHERE v > 30000), bg AS (SELECT z, y, x FROM e EXCEPT SELECT z, y, x FROM m),
six(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
outer_(z, y, x) AS (SELECT z, y, x FROM bg, ext WHERE z IN (0, nz - 1) OR y IN (0, 19) OR x IN (0, 63)
 UNION SELECT bg.z, bg.y, bg.x FROM outer_ o, six s, bg WHERE bg.z = o.z + s.dz AND bg.y = o.y + s.dy AND bg.x = o.x + s.dx)
SELECT z, y, x FROM e EXCEPT SELECT z, y, x FROM outer_""", recursive=True)

add("m17_grey_dilation", "vox", """WITH a AS (SELECT z, y, x, max(v) OVER (PARTITION BY y, x ORDER BY z RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) v FROM vox),
b AS (SELECT z, y, x, max(v) OVER (PARTITION BY z, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) v FROM a)
SELECT z, y, x, max(v) OVER (PARTITION BY z, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM b""")


def diffusion(limit: int, sigma: float, radius: int | None, steps: int) -> str:
    w = kernel(sigma, radius)
    parts = [f"m AS (SELECT z, y, x FROM vox WHERE v > {limit})", values("w", "o, w", [(i - len(w) // 2, x) for i, x in enumerate(w)]), "f0 AS (SELECT z, y, x, CAST(1 AS DOUBLE) f FROM m)"]
    for k in range(steps):
        parts.append(f"a{k} AS (SELECT CAST(z + o AS INT) z, y, x, sum(w * f) f FROM f{k}, w, ext WHERE z + o BETWEEN 0 AND nz - 1 GROUP BY 1, 2, 3)")
        parts.append(f"b{k} AS (SELECT z, CAST(y + o AS INT) y, x, sum(w * f) f FROM a{k}, w WHERE y + o BETWEEN 0 AND 19 GROUP BY 1, 2, 3)")
        parts.append(f"c{k} AS (SELECT z, y, CAST(x + o AS INT) x, sum(w * f) f FROM b{k}, w WHERE x + o BETWEEN 0 AND 63 GROUP BY 1, 2, 3)")
        parts.append(f"f{k + 1} AS (SELECT c.z, c.y, c.x, CASE WHEN m.z IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE f END f FROM c{k} c LEFT JOIN m ON m.z = c.z AND m.y = c.y AND m.x = c.x)")
    return f"WITH {', '.join(parts)} SELECT z, y, x, CAST(floor(f * 65535 + CAST(1e-7 AS DOUBLE)) AS INT) AS f FROM f{steps}"


add("m9_diffusion", "vox ext", diffusion(58000, 1.0, 2, 3))
add("m19_implant_blur", "vox ext", diffusion(60000, 1.5, None, 1))

# the last pass reaches only as far as the greatest distance that slices alone would give
DISTANCE = """m AS (SELECT z, y, x FROM vox WHERE v > {limit}),
d1 AS (SELECT m.z, m.y, CAST(r.id AS INT) x, min((r.id - m.x) * (r.id - m.x)) d FROM m, range(64) r(id) GROUP BY 1, 2, 3),
d2 AS (SELECT z, CAST(r.id AS INT) y, x, min(d + (r.id - y) * (r.id - y)) d FROM d1, range(20) r(id) GROUP BY 1, 2, 3),
s AS (SELECT z, max(d) d FROM d2 GROUP BY 1), far AS (SELECT CAST(ceil(sqrt(max(d))) AS BIGINT) reach FROM (SELECT r.id, min(s.d + (r.id - s.z) * (r.id - s.z)) d FROM s, ext, range(nz) r(id) GROUP BY 1)),
d3 AS (SELECT CAST(t AS INT) z, y, x, min(d + (t - z) * (t - z)) d FROM (SELECT z, y, x, d, unnest(range(greatest(0, z - reach), least(nz, z + reach + 1))) t FROM d2, far, ext) GROUP BY 1, 2, 3)"""
add("m12_distance", "vox ext", f"WITH {DISTANCE.format(limit=55000)} SELECT z, y, x, CAST(floor(sqrt(CAST(d AS DOUBLE))) AS INT) AS f FROM d3")


def corners(points: str, axes: dict[str, str]) -> str:
    """Of each point the two voxels about it on each axis and their weights; the nearest alone at the border."""
    half = "CAST(0.5 AS DOUBLE)"
    parts = []
    for c, n in axes.items():
        p = f"p{c}"
        parts.append(f"""c{c} AS (SELECT id, CAST(floor({p} - {half}) + k AS INT) i, CASE WHEN k = 0 THEN 1 - ({p} - {half} - floor({p} - {half})) ELSE {p} - {half} - floor({p} - {half}) END w FROM {points}, (VALUES (0), (1)) t(k) WHERE {p} >= {half} AND {p} <= {n} - {half}
 UNION ALL SELECT id, CAST(least({n} - 1, greatest(0, floor({p}))) AS INT), CAST(1 AS DOUBLE) FROM {points} WHERE NOT ({p} >= {half} AND {p} <= {n} - {half}))""")
    return ", ".join(parts)


def sampled(table: str, value: str, axes: dict[str, str]) -> str:
    at = " AND ".join(f"g.{c} = least(c{c}.i, {n} - 1)" for c, n in axes.items())
    return f"t AS (SELECT cz.id, sum(cz.w * cy.w * cx.w * coalesce(CAST(g.{value} AS DOUBLE), 0)) AS value FROM cz JOIN cy USING (id) JOIN cx USING (id) LEFT JOIN {table} g ON {at} WHERE cz.w * cy.w * cx.w > 0 GROUP BY 1)"


NZ = "(SELECT nz FROM ext)"
add("r2_sample_plane", "vox ext", f"""WITH g AS (SELECT CAST(i.id AS INT) i, CAST(j.id AS INT) j, CAST(i.id * 32 + j.id AS BIGINT) id, 32 + (-30 + i.id * CAST(1 AS DOUBLE)) * 1 px, 10 + (-8 + j.id * CAST(0.5 AS DOUBLE)) * CAST(0.6 AS DOUBLE) py,
 CAST(nz AS DOUBLE) / 2 + (-8 + j.id * CAST(0.5 AS DOUBLE)) * CAST(0.8 AS DOUBLE) pz FROM ext, range(60) i(id), range(32) j(id)),
q AS (SELECT * FROM g WHERE px BETWEEN CAST(0.5 AS DOUBLE) AND CAST(63.5 AS DOUBLE) AND py BETWEEN CAST(0.5 AS DOUBLE) AND CAST(19.5 AS DOUBLE) AND pz BETWEEN CAST(0.5 AS DOUBLE) AND {NZ} - CAST(0.5 AS DOUBLE)),
{corners('q', {'z': NZ, 'y': '20', 'x': '64'})}, {sampled('vox', 'v', {'z': NZ, 'y': '20', 'x': '64'})}
SELECT i, j, round(round(coalesce(value, 0), 6)) AS value FROM g LEFT JOIN t USING (id)""")

HALF = {"z": "(SELECT nz // 2 FROM dim)", "y": "10", "x": "32"}
ON_FIELD = f"""q AS (SELECT CAST(z AS BIGINT) * 1280 + y * 64 + x id, z, y, x, v, (z + CAST(0.5 AS DOUBLE)) * (CAST(nz // 2 AS DOUBLE) / nz) pz, (y + CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) py, (x + CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) px FROM vox, dim),
{corners('q', HALF)}, {sampled('field2', 'f', HALF)}"""
add("a3_sampled_field_histogram", "vox field2 dim", f"""WITH {ON_FIELD}, k AS (SELECT v, round(value, 6) f FROM q JOIN t USING (id))
SELECT CAST(floor((f - 1) * 31 / 65534) AS INT) AS "row", {BIN} AS bin, count(*) AS n FROM k WHERE f BETWEEN 1 AND 65535 GROUP BY 1, 2""")
add("d13_material_probability_trilinear", "vox field2 dim prob", f"""WITH {ON_FIELD}, k AS (SELECT z, y, x, CAST(floor((least(65535, greatest(1, value)) - 1) * 15 / 65534) AS INT) fb, CAST(floor(CAST(v - 1 AS DOUBLE) * 31 / 65534) AS INT) vb FROM q JOIN t USING (id))
SELECT z, y, x, material, CAST(round(p * 65535) AS INT) AS p16 FROM k JOIN prob ON field_bin = fb AND voxel_bin = vb""")


def dense(hist: str, bins: int) -> str:
    return f'd AS (SELECT r."row", CAST(b.id AS INT) bin, CAST(coalesce(n, 0) AS BIGINT) n FROM (SELECT DISTINCT "row" FROM {hist}) r CROSS JOIN range({bins}) b(id) LEFT JOIN {hist} h ON h."row" = r."row" AND h.bin = b.id)'


def tops(table: str) -> str:
    """Peaks of the rows (row, bin, s): the middle of a run of equal values above both its neighbours."""
    over = 'OVER (PARTITION BY "row" ORDER BY bin)'
    return f"""r0 AS (SELECT *, CASE WHEN lag(s) {over} = s THEN 0 ELSE 1 END c FROM {table}), r1 AS (SELECT *, sum(c) {over} g FROM r0),
r2 AS (SELECT "row", g, min(bin) a, max(bin) b, any_value(s) s FROM r1 GROUP BY 1, 2), r3 AS (SELECT *, lag(s) OVER (PARTITION BY "row" ORDER BY g) l, lead(s) OVER (PARTITION BY "row" ORDER BY g) r FROM r2),
p AS (SELECT "row", CAST(floor((a + b) / CAST(2 AS DOUBLE)) AS INT) bin, s FROM r3 WHERE l < s AND r < s)"""


add("a20_a21_valley", "vox", f"""WITH h AS (SELECT CAST(0 AS INT) "row", CAST(floor(CAST(v - 1 AS DOUBLE) * 255 / 65534) AS INT) bin, count(*) n FROM vox GROUP BY 1, 2), {dense('h', 256)}, {taps(3, 'reflect', bins=256)},
q AS (SELECT "row", bin, round(s, 6) s FROM s), {tops('q')}, two AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY s DESC, bin) k FROM p),
ab AS (SELECT "row", min(bin) a, max(bin) b FROM two WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2)
SELECT "row", bin FROM (SELECT q."row", q.bin, row_number() OVER (PARTITION BY q."row" ORDER BY q.s, q.bin) k FROM q JOIN ab USING ("row") WHERE q.bin >= a AND q.bin < b) WHERE k = 1""")
add("k6_scatter_peaks", "vox", f"""WITH {ZHIST}, {dense('h', 64)}, {taps(3, 'reflect')}, {tops('s')}, top AS (SELECT "row", max(s) top FROM s GROUP BY 1)
SELECT "row", bin, round(s, 6) AS s FROM p JOIN top USING ("row") WHERE s >= CAST(0.5 AS DOUBLE) * top""")
add("q6_histograms", "vox field2 dim", f"""WITH {FIELD}, h AS (SELECT CAST(floor(CAST(f - 1 AS DOUBLE) * 31 / 65534) AS INT) AS "row", {BIN} AS bin, count(*) AS n FROM f GROUP BY 1, 2),
d AS (SELECT * FROM h WHERE "row" > 0 AND "row" < 31), {taps(3, 'zero')}, t AS (SELECT s.bin AS "row", CAST(s."row" + o AS INT) bin, sum(w.w * s.s) s FROM s, w GROUP BY 1, 2)
SELECT bin AS "row", "row" AS bin, round(s, 6) AS s FROM t WHERE bin BETWEEN 0 AND 31""")
add("m18_fft_rows", "vox", f"""WITH {ZHIST}, k AS (SELECT CAST(id AS INT) k FROM range(33) r(id))
SELECT "row", k, round(sum(n * cos(2 * pi() * k * bin / 64)), 4) + 0.0 AS re, round(-sum(n * sin(2 * pi() * k * bin / 64)), 4) + 0.0 AS im FROM h, k GROUP BY 1, 2""")

SIX = "(abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1)"


def reach(table: str, extra: str = "") -> str:
    """(id, root): each voxel's least voxel that faces lead to, by growing from all voxels at once."""
    near = " UNION ALL ".join(f"SELECT a.id a, b.id b FROM {table} a JOIN {table} b ON b.z = a.z + {dz} AND b.y = a.y + {dy} AND b.x = a.x + {dx}{extra}" for dz, dy, dx in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
    return f"e AS ({near}), r(id, root) AS (SELECT id, id FROM {table} UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), c AS (SELECT id, min(root) root FROM r GROUP BY 1)"


def halved(ny: int, nx: int) -> str:
    inside = f"{CYL.format(c='y', n=ny - 1)} + {CYL.format(c='x', n=nx - 1)} <= 1"
    return f"half AS (SELECT z, y, x, v FROM (SELECT CAST(z // 2 AS INT) z, CAST(y // 2 AS INT) y, CAST(x // 2 AS INT) x, CAST(sum(CAST(v AS BIGINT)) // 8 AS INT) v FROM vox GROUP BY 1, 2, 3), ext WHERE z < nz // 2 AND y < {ny} AND x < {nx} AND v > 0 AND {inside})"


add("q10_blood", "vox ext", f"""WITH {halved(10, 32)}, m AS (SELECT z, y, x, CAST(z AS BIGINT) * 320 + y * 32 + x id FROM half WHERE v > 34000), {reach('m')},
s AS (SELECT root, count(*) n FROM c GROUP BY 1 ORDER BY n DESC, root LIMIT 1) SELECT z, y, x FROM m JOIN c USING (id) JOIN s USING (root)""", recursive=True)
add("c1_slab_labels", "vox", f"""WITH m AS (SELECT z, y, x, CAST(z AS BIGINT) * 1280 + y * 64 + x id FROM vox WHERE v > 40000), {reach('m', ' AND a.z // 5 = b.z // 5')},
s AS (SELECT root // 6400 slab, root, count(*) n FROM c GROUP BY 1, 2) SELECT CAST(slab * 1099511627776 + dense_rank() OVER (PARTITION BY slab ORDER BY root) AS BIGINT) AS label, n FROM s""", recursive=True)
