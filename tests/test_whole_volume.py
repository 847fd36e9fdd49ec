"""Queries over whole tables: against their oracles where a prefix differs from the whole, and by brute force."""

import os

import numpy as np
import pytest

from voxelith import queries as own
from voxelith.plans import fixtures as fx

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "lineitem embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
WHOLE = ["r1_trilinear_all", "g4_inertias_all", "g16_eigenvalues_all", "d20_local_threshold_all", "s21_replace_partition_all"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = own.QUERIES[name](spark, SF).toPandas()
    want = c.execute(own.ORACLES[name]).df()[list(got.columns)]
    keys = list(got.columns[:3] if "z" in got.columns else got.columns[:1])
    got, want = (f.sort_values(keys).to_numpy(float) for f in (got, want))
    assert got.shape == want.shape and (got == want).all()


def volume(spark):
    v = np.zeros(fx.shape(spark, SMALL), np.int64)
    p = fx.vox(spark, SMALL).toPandas()
    v[p["z"], p["y"], p["x"]] = p["v"]
    return v


def parts(solid):
    """Components by flood fill: arrays of voxels."""
    left, out = {tuple(p) for p in np.argwhere(solid).tolist()}, []
    while left:
        part = [left.pop()]
        for z, y, x in part:
            near = {(z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)} & left
            left -= near
            part += near
        out.append(sorted(part))
    return out


def test_components_of_the_whole_volume(spark):
    got = sorted(tuple(r)[-4:] for r in own.QUERIES["c4_components"](spark, SMALL).select("z", "y", "x", "n").collect())
    assert got == sorted((*p[0], len(p)) for p in parts(volume(spark) > 32000))


def test_components_across_tiles(spark):
    """Tiles far smaller than the components, so that labels meet on all six faces."""
    from voxelith.operators import components

    mask = fx.vox(spark, SMALL).where("v > 32000").select("z", "y", "x")
    got = sorted(tuple(r) for r in components.canonical(components.label_volume(mask, 4, 7)).select("z", "y", "x", "n").collect())
    assert got == sorted((*p[0], len(p)) for p in parts(volume(spark) > 32000))
    with pytest.raises(ValueError):
        components.label_volume(mask, 300, 256)


def test_inertia_far_from_the_origin(spark):
    """Moved by a million voxels the tensor stays, to the last digits."""
    from pyspark.sql import functions as F

    from voxelith.operators import geometry

    m = fx.vox(spark, SMALL).where("v > 50000")
    far = m.select(*[(F.col(c) + 1_000_000).alias(c) for c in "zyx"], "v", F.lit(1).cast("long").alias("label"))
    here, there = geometry.inertia(m).first(), geometry.inertia(far).first()
    assert all(abs(a - b) <= 1e-9 * abs(a) + 1e-3 for a, b in zip(here, there, strict=True))
    one, two = geometry.inertias(m.withColumn("label", F.lit(1))).first(), geometry.inertias(far).first()
    assert all(abs(a - b) <= 1e-6 * abs(a) + 1e-3 for a, b in zip(one[1:], two[1:], strict=True))


def test_smoothing_with_a_kernel_wider_than_the_row(spark):
    from voxelith.operators import histogram

    rows = [(0, 0, 5), (0, 1, 0), (0, 2, 7), (0, 3, 1)]
    got = {r.bin: r.s for r in histogram.smooth_rows(spark.createDataFrame(rows, "row int, bin int, n long"), 4, 3).collect()}
    w, n = histogram.kernel(3), [5, 0, 7, 1]
    mirror = [n[k % 8] if k % 8 < 4 else n[7 - k % 8] for k in range(-12, 16)]
    for b in range(4):
        assert abs(got[b] - sum(w[j] * mirror[12 + b + j - 12] for j in range(25))) < 1e-9


def test_largest_component_of_the_whole_volume(spark):
    got = sorted(tuple(r) for r in own.QUERIES["c7_largest_component"](spark, SMALL).select("z", "y", "x").collect())
    found = parts(volume(spark) > 34000)
    most = max(map(len, found))
    assert got in [p for p in found if len(p) == most]


def test_distances_in_the_whole_volume(spark):
    v = volume(spark)
    solid = np.argwhere(v > 55000)
    got = own.QUERIES["m12_distance"](spark, SMALL).toPandas()
    at = got[["z", "y", "x"]].to_numpy()
    d2 = np.concatenate([((a[:, None] - solid) ** 2).sum(-1).min(1) for a in np.array_split(at, 64)])
    assert len(got) == v.size and (got["f"] == np.floor(np.sqrt(d2))).all()


def test_ellipsoids_take_all_slices(spark):
    got = {r.label: r.n for r in own.QUERIES["g22_ellipsoids"](spark, SF).collect()}
    assert got == {r.label: r["count"] for r in fx.labels(spark, SF).where("label <> 0").groupBy("label").count().collect()}
