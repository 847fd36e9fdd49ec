"""Planes, power fits, blocks and packed words, against plain computations."""

import numpy as np
import pytest

from voxelith.operators import models, planes, stencil, voxels


def image(text):
    return np.array([[c == "#" for c in line] for line in text.split()])


def test_outline_and_fill():
    square = image("..... .###. .#.#. .###. .....")
    assert planes.outline(square) == 8 and planes.filled(square).sum() == 9
    assert planes.outline(image("#")) == 0 and planes.outline(image("##")) == 2
    assert planes.outline(image("#.. .#. ..#")) == pytest.approx(4 * 2**0.5)
    assert planes.outline(image("###")) == 4


def test_contours(spark):
    img = image("####...... #..#...##. #..#..#..# ####...##. .......... ..#.......")
    rows = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(img), strict=True)] + [(3, 1, 1)], "z int, y int, x int")
    out = np.zeros(img.shape, int)
    for r in planes.contours(rows, "z", img.shape, 5.0).collect():
        assert r.z == 0
        out[r.y, r.x] = r.contour
    assert (out == 1).sum() == 16 and (out == 2).sum() == 8 and out[2, 7] == 2 and out[5, 2] == 0
    assert planes.contours(rows.where("z < 0"), "z", img.shape, 5.0).count() == 0


def test_skeletons_keep_the_parts_and_are_thin(spark):
    rng = np.random.default_rng(3)
    img = np.zeros((40, 60), bool)
    for _ in range(12):
        y, x = rng.integers(0, 30), rng.integers(0, 50)
        img[y : y + rng.integers(2, 9), x : x + rng.integers(2, 9)] = True
    thin = planes.thin(img)
    assert not (thin & ~img).any() and (planes.thin(thin) == thin).all()
    assert not (thin[:-1, :-1] & thin[1:, :-1] & thin[:-1, 1:] & thin[1:, 1:]).all(axis=None)
    before, after = planes.components_2d(img, True), planes.components_2d(thin, True)
    assert all(len(np.unique(after[(before == k) & thin])) <= 1 for k in range(1, before.max() + 1))
    rows = spark.createDataFrame([(7, int(y), int(x)) for y, x in zip(*np.nonzero(img), strict=True)], "z int, y int, x int")
    assert sorted((r.y, r.x) for r in planes.skeletons(rows, "z", img.shape).collect()) == sorted(zip(*map(list, np.nonzero(thin)), strict=True))
    cross = np.zeros((41, 41), bool)
    cross[18:23], cross[:, 18:23] = True, True
    joints = planes.joints_of(cross, 5, 1)
    assert joints[20, 20] and not joints[20, 2] and not joints[2, 20]


def test_power_fit_finds_two_peaks():
    x = np.arange(80.0)
    true = np.array([[12.0, 0.12, 25.0, np.sqrt(1.9)], [9.0, 0.16, 55.0, np.sqrt(1.7)]])
    labels = np.where(x < 40, 1, 2)
    y = models.powers(x, true).sum(0)
    p = models.fit_powers(x, y, labels)
    assert p[:, 0].tolist() == [1, 2] and np.abs(p[:, 3] - true[:, 2]).max() <= 1
    assert models.fit_energy(x, y, p[:, 1:]) <= 1.02 * models.fit_energy(x, y, true) + 1
    assert len(models.fit_powers(x, 0 * y, labels)) == 0 and len(models.fit_powers(x, y, 0 * labels)) == 0


def test_global_fit_lessens_the_residual():
    at, v = np.arange(10), np.arange(30)
    image_ = 40 * np.exp(-0.04 * np.abs(v - (8 + 0.5 * at)[:, None]) ** 1.6)
    start = np.stack([np.stack([np.full(3, 5.0), np.full(3, 0.3), np.full(3, 12.0)])])
    g, energy = models.fit_globally(image_, start, np.linspace(0, 9, 3), rounds=60)
    assert energy < 1 < image_.var() and np.abs(g[0, 2] - (8 + 0.5 * np.linspace(0, 9, 3))).max() < 0.5


def test_packed_words_reach_neighbours(spark):
    rng = np.random.default_rng(4)
    solid = rng.random((5, 6, 70)) < 0.01
    solid[2, 3, 31] = solid[2, 3, 64] = solid[0, 0, 69] = True
    table = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(solid)], "z int, y int, x int")
    for r in (1, 4, 31):
        got = voxels.unpack_bits(voxels.packed_dilate(voxels.pack_bits(table), r, solid.shape))
        want = stencil.dilate(table, r, solid.shape)
        assert sorted(got.collect()) == sorted(want.collect())
    most = stencil.complement(table, solid.shape)
    got = voxels.unpack_bits(voxels.packed_erode(voxels.pack_bits(most), 2, solid.shape))
    assert sorted(got.collect()) == sorted(stencil.erode(most, 2, solid.shape).collect())
    with pytest.raises(ValueError):
        voxels.packed_dilate(voxels.pack_bits(table), 32, solid.shape)


@pytest.mark.parametrize("block", [4, 64])
def test_diffusion_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    solid = rng.random((7, 9, 11)) < 0.05
    table = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(solid)] + [(0, 0, 99)], "z int, y int, x int")
    whole = {(r.z, r.y, r.x): r.f for r in stencil.diffuse(table.where("x < 11"), 1.0, 2, solid.shape, 2).collect()}
    got = {(r.z, r.y, r.x): r.f for r in stencil.diffuse_blocks(table, 1.0, 2, solid.shape, 2, block).collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) <= 1 for k in whole)
