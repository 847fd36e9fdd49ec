"""Kernels and operators against brute force and invariants on small volumes."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelith.operators import align, components, distance, geometry, histogram, models, resample, stencil, voxels
from voxelith.sources import raw

SHAPE = (6, 7, 9)


def table(spark, mask, extra=None):
    rows = [tuple(int(i) for i in p) for p in np.argwhere(mask)]
    if extra is None:
        return spark.createDataFrame(rows, "z int, y int, x int")
    return spark.createDataFrame([(*p, int(extra[p])) for p in rows], "z int, y int, x int, v int")


def dense(df, shape, column=None):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] += 1 if column is None else r[column]
    return out


@pytest.fixture(scope="module")
def mask():
    return np.random.default_rng(1).random(SHAPE) < 0.3


def plain_dilate(m, r):
    out = np.zeros_like(m)
    for p in np.argwhere(m):
        for q in np.ndindex(m.shape):
            out[q] |= sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= r * r
    return out


@pytest.mark.parametrize("r", [1, 2, 3])
def test_morphology(spark, mask, r):
    m = table(spark, mask)
    big = plain_dilate(mask, r)
    assert (dense(stencil.dilate(m, r, SHAPE), SHAPE) == big).all()
    small = ~plain_dilate(~mask, r)
    assert (dense(stencil.erode(m, r, SHAPE), SHAPE) == (small & mask)).all()
    opened, closed = dense(stencil.opened(m, r, SHAPE), SHAPE), dense(stencil.closed(m, r, SHAPE), SHAPE)
    assert (opened <= mask).all() and (mask <= closed).all()


def plain_labels(m):
    lab, n = np.zeros(m.shape, int), 0
    for p in np.argwhere(m):
        if lab[tuple(p)]:
            continue
        n += 1
        todo = [tuple(p)]
        while todo:
            q = todo.pop()
            if all(0 <= a < b for a, b in zip(q, m.shape, strict=True)) and m[q] and not lab[q]:
                lab[q] = n
                todo += [tuple(a + s * (i == k) for k, a in enumerate(q)) for i in range(3) for s in (1, -1)]
    return lab


@pytest.mark.parametrize("slab", [1, 2, 4, 100])
def test_components(spark, mask, slab):
    want = plain_labels(mask)
    sizes = sorted(np.bincount(want.ravel())[1:].tolist())
    assert sorted(r.n for r in components.canonical(components.label_volume(table(spark, mask), slab)).collect()) == sizes
    big = dense(components.largest_mask(table(spark, mask), slab), SHAPE)
    assert (big == (want == 1 + np.argmax(np.bincount(want.ravel())[1:]))).all()


def test_chunk_merge(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for layout in range(4):
        m = rng.random((12, 1, 12)) < 0.55
        want[layout] = int(plain_labels(m).max())
        for chunk in range(4):
            part = plain_labels(m[3 * chunk : 3 * chunk + 3])
            rows += [(layout, chunk, z, 0, x, int(part[z, 0, x])) for z in range(3) for x in range(12)]
    df = spark.createDataFrame(rows, "layout int, chunk int, z int, y int, x int, local_label int")
    assert {r.layout: r.components for r in components.chunk_components(df).collect()} == want


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 60)), min_size=1, max_size=30))
def test_lower_envelope(costs):
    c = np.array([[np.inf if x is None else x for x in costs], [0.0 if i % 3 else np.inf for i in range(len(costs))]], float)
    n = np.arange(c.shape[1])
    assert (distance.lower_envelope(c) == ((n[:, None] - n) ** 2 + c[:, None]).min(2)).all()


def test_distances(spark, mask):
    sparse = mask & (np.random.default_rng(5).random(SHAPE) < 0.1)
    points = np.argwhere(sparse)
    want = np.array([min(((p - np.array(q)) ** 2).sum() for p in points) for q in np.ndindex(SHAPE)]).reshape(SHAPE)
    assert (dense(distance.squared_distances(table(spark, sparse), SHAPE, lines=4), SHAPE, "d2") == want).all()
    assert distance.squared_distances(table(spark, sparse).where("z < 0"), SHAPE).count() == 0


def test_packing_and_sets(spark, mask):
    wide = np.random.default_rng(7).random((3, 4, 64)) < 0.4
    m = table(spark, wide)
    assert (dense(voxels.unpack_bits(voxels.pack_bits(m)), wide.shape) == wide).all()
    with pytest.raises(ValueError):
        voxels.packed_slice(voxels.pack_bits(m), (0, 1, 0, 1, 3, 40))


def test_diffusion(spark, mask):
    sparse = mask & (np.random.default_rng(8).random(SHAPE) < 0.2)
    w = np.array(histogram.kernel(1.0, 2))
    f = sparse.astype(float)
    for _ in range(3):
        for axis in range(3):
            f = np.apply_along_axis(lambda line: np.convolve(line, w, "same"), axis, f)
        f[sparse] = 1
    got = dense(stencil.diffuse(table(spark, sparse), 1.0, 3, SHAPE, 2), SHAPE, "f")
    assert np.abs(got - np.floor(f * 65535)).max() <= 1


def test_convolve_keeps_direction(spark):
    one = spark.createDataFrame([(0, 0, 4, 1.0)], "z int, y int, x int, f double")
    got = {r.x: r.f for r in stencil.convolve(one, [1.0, 2.0, 3.0], "x", (1, 1, 9)).collect()}
    assert got == {3: 3.0, 4: 2.0, 5: 1.0}  # out[p] = sum over q of w[r + q - p] in[q]


def test_downsample_keeps_the_mean(spark):
    v = np.random.default_rng(9).integers(1, 1000, (4, 6, 8))
    got = dense(resample.downsample(table(spark, v > 0, v), 2, v.shape, masked=False), (2, 3, 4), "v")
    assert (got == v.reshape(2, 2, 3, 2, 4, 2).sum((1, 3, 5)) // 8).all()


def test_otsu_by_brute_force(spark):
    rng = np.random.default_rng(10)
    n = rng.integers(0, 20, (3, 12))
    rows = [(r, b, int(n[r, b])) for r in range(3) for b in range(12) if n[r, b]]
    got = {r.row: r.threshold for r in histogram.otsu(spark.createDataFrame(rows, "row int, bin int, n long"), 12).collect()}
    for r in range(3):
        best = None
        for t in range(12):
            e = 0.0
            for part in (range(t), range(t, 12)):
                c = sum(n[r, b] for b in part)
                if not c:
                    e = float("inf")
                    break
                mean = sum(n[r, b] * b for b in part) / c
                e += sum(n[r, b] * (b - mean) ** 2 for b in part)
            e = e if e == float("inf") else np.floor(e + 1e-9)
            if best is None or e < best[0]:
                best = (e, t)
        assert got[r] == best[1]


def test_peaks(spark):
    line = [0, 1, 3, 3, 3, 1, 2, 5, 0, 4, 4]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(line)], "row int, bin int, n int")
    assert sorted((r.bin, r.n) for r in histogram.peaks(df).collect()) == [(3, 3), (7, 5)]
    assert [r.bin for r in histogram.ranked_peaks(histogram.peaks(df), 1).collect()] == [7]


def test_piecewise_cubic():
    x = np.linspace(0, 10, 60)
    y = 2 + x - 0.3 * x**2 + 0.01 * x**3
    for order in (x, x[::-1]):
        fit = models.fit_piecewise(x, y, [0, 3, 7, 10.5])
        assert np.allclose(models.eval_piecewise(order, fit), 2 + order - 0.3 * order**2 + 0.01 * order**3)
    line = models.eval_piecewise([-5, 20], models.fit_piecewise(x, 3 * x + 1, [0, 5, 10]), "linear")
    assert np.allclose(line, [-14, 61], atol=1e-4)
    assert np.allclose(models.eval_piecewise([-5, 20], models.fit_piecewise(x, 3 * x + 1, [0, 5, 10]), "constant"), [1, 31])
    assert np.allclose(models.eval_piecewise(x, models.fit_piecewise(x, x**2, [0, 4, 10], degree=2), degree=2), x**2)


def test_fit_peaks():
    x = np.arange(100)
    true = np.array([[10, 0.15, 30], [6, 0.2, 70]])
    y = sum(a * a * np.exp(-(b * (x - c)) ** 2) for a, b, c in true)
    assert np.allclose(models.fit_peaks(x, y, 2), true, atol=0.05)


def test_geometry(spark, mask):
    m = geometry.gram_schmidt((1, 2, 3), (0, 1, 5), (2, 0, 1))
    assert np.allclose(m @ m.T, np.eye(3))
    p = np.argwhere(mask).astype(float)
    c = p - p.mean(0)
    want = np.sum([np.dot(v, v) * np.eye(3) - np.outer(v, v) for v in c], axis=0)
    df = table(spark, mask, mask.astype(int))
    t = geometry.inertia(df).first()
    got = np.array([[t.izz, t.izy, t.izx], [t.izy, t.iyy, t.iyx], [t.izx, t.iyx, t.ixx]])
    assert np.allclose(got, want)
    e = geometry.eigenvalues(geometry.inertia(df), []).first()
    assert np.allclose([e.e1, e.e2, e.e3], np.linalg.eigvalsh(want))
    frame = geometry.axis_frame(geometry.eigen_frame(want)[1])
    assert np.allclose(frame @ frame.T, np.eye(3)) and (np.diag(frame) >= 0).all()


def test_match_finds_the_overlap(spark):
    v = np.random.default_rng(12).integers(1, 100, (20, 3, 3))
    top, bottom = table(spark, v[:12] > 0, v[:12]), table(spark, v[8:] > 0, v[8:])
    best = align.best_shift(align.match_scores(top, bottom, 12, 6, 9, (2, 6))).first()
    assert (best.shift, best.ref_index) == (4, 2)


def test_store(spark, tmp_path, mask):
    v = np.where(mask, np.random.default_rng(13).integers(1, 60000, SHAPE), 0)
    path = str(tmp_path / "vol")
    low, high = v.copy(), v.copy()
    low[4:], high[:4] = 0, 0
    raw.write_slices(table(spark, low > 0, low), path, 2)
    raw.append_slices(table(spark, high > 0, high), path, 2)
    assert (dense(raw.load_slices(spark, path, (0, 6), 2), SHAPE, "v") == v).all()
    raw.write_slices(table(spark, high > 0, high), path, 2)  # only its own slabs are replaced
    assert (dense(raw.load_slices(spark, path, (0, 6), 2), SHAPE, "v") == v).all()
    box = dense(raw.load_slices(spark, path, (1, 5), 2, (2, 5), (0, 4)), SHAPE, "v")
    assert (box[1:5, 2:5, :4] == v[1:5, 2:5, :4]).all() and box.sum() == v[1:5, 2:5, :4].sum()
    halo = raw.with_halo(table(spark, mask), 2, 1).where("slab = 1")
    assert {r.z for r in halo.collect()} <= {1, 2, 3, 4}


def test_readers(spark, tmp_path):
    v = np.random.default_rng(14).integers(0, 50, SHAPE).astype("<u2")
    (tmp_path / "vol_0.uint16").write_bytes(v[:3].tobytes())
    (tmp_path / "vol_3.uint16").write_bytes(v[3:].tobytes())
    assert (dense(raw.raw_slabs(spark, f"{tmp_path}/*.uint16", SHAPE), SHAPE, "v") == v).all()
    assert (dense(raw.raw_volume(spark, f"{tmp_path}/vol_3.uint16", SHAPE, offset=3), SHAPE, "v")[3:] == v[3:]).all()
    for z in range(6):
        head = f"{{\nByteOrder = LowByteFirst ;\nDataType = UnsignedShort ;\nDim_1 = {SHAPE[2]} ;\nDim_2 = {SHAPE[1]} ;\n}}\n"
        (tmp_path / f"scan_{z:04d}.edf").write_bytes(head.encode().ljust(1024) + v[z].tobytes())
    assert (dense(raw.edf_frames(spark, f"{tmp_path}/*.edf"), SHAPE, "v") == v).all()
    assert raw.edf_metadata(spark, f"{tmp_path}/scan_0001.edf").first().meta["Dim_1"] == str(SHAPE[2])
    assert (dense(raw.edf_region(spark, f"{tmp_path}/*.edf", (1, 2, 3), (5, 6, 6)), SHAPE, "v")[3:6, 2:6, 1:5] == v[3:6, 2:6, 1:5]).all()
    assert (dense(raw.edf_slice(spark, f"{tmp_path}/scan_{{:04d}}.edf", 4), SHAPE, "v")[4] == v[4]).all()
    assert raw.edf_region(spark, f"{tmp_path}/*.edf", (0, 0, 90), (5, 6, 99)).count() == 0
    (tmp_path / "high_0001.edf").write_bytes(b"{ ByteOrder = HighByteFirst ; }".ljust(1024))
    with pytest.raises(Exception, match="LowByteFirst"):
        raw.edf_metadata(spark, f"{tmp_path}/high_0001.edf").collect()
    (tmp_path / "scan.xml").write_text("<r><SIZEX> 12 </SIZEX><voxelSize>5.0</voxelSize>\n<subvolume_name>bone_a_%04d.edf</subvolume_name></r>")
    meta = raw.scan_description(spark, f"{tmp_path}/scan.xml").first().meta
    assert {k: meta[k] for k in meta if "name" not in k or k == "subvolume_name"} == {"sizex": "12", "voxelsize": "5.0", "experiment": "bone_a", "subvolume_name": "bone_a_{:04d}.edf"}
    assert meta["filename"].endswith("/scan.xml") and meta["dirname"] == meta["filename"].removesuffix("/scan.xml")
    raw.save_config(spark, {"close kernel x": 3, "names": ["a"]}, str(tmp_path / "config"))
    assert raw.load_config(spark, str(tmp_path / "config")) == {"close kernel x": 3, "names": ["a"]}
    (tmp_path / "list.txt").write_text("one\n\ntwo three\n")
    assert [r.line for r in raw.text_list(spark, f"{tmp_path}/list.txt").collect()] == ["one", "", "two three"]
    raw.save_table(spark.createDataFrame([(1, 0.5)], "bin int, p double"), str(tmp_path / "prob"), method="otsu", material=0)
    raw.save_table(spark.createDataFrame([(2, 0.7)], "bin int, p double"), str(tmp_path / "prob"), method="otsu", material=1)
    assert raw.load_table(spark, str(tmp_path / "prob"), method="otsu", material=1).collect() == [(2, 0.7)]


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_sinks(spark, tmp_path, monkeypatch, limit):
    """Flat, npy, npz and EDF files; flat ones also in ranges."""
    monkeypatch.setattr(raw, "RANGE", limit)
    v = np.random.default_rng(15).integers(0, 4, SHAPE)
    v[2] = 0  # a slice without voxels is written all the same
    vol = table(spark, v > 0, v)
    for name, write, read in (
        ("raw", raw.write_raw_slabs, lambda p: raw.raw_slabs(spark, f"{p}/*.raw", SHAPE)),
        ("npy", raw.write_npy_slabs, lambda p: raw.npy_slabs(spark, f"{p}/*.npy")),
        ("npz", lambda *a: raw.write_npy_slabs(*a, packed=True), lambda p: raw.npy_slabs(spark, f"{p}/*.npz")),
    ):
        path = f"file://{tmp_path}/{name}"
        assert write(vol, path, SHAPE, 4) == SHAPE[0] and (dense(read(path), SHAPE, "v") == v).all()
    assert raw.write_edf_frames(vol, f"{tmp_path}/edf", SHAPE) == SHAPE[0]
    assert (dense(raw.edf_frames(spark, f"{tmp_path}/edf/*.edf"), SHAPE, "v") == v).all()


def test_fill_holes(spark):
    m = np.zeros((5, 5, 5), bool)
    m[1:4, 1:4, 1:4] = True
    m[2, 2, 2] = False
    want = m.copy()
    want[2, 2, 2] = True
    assert (dense(stencil.fill_holes(table(spark, m), m.shape), m.shape) == want).all()


def test_sphere_runs():
    for r in (1, 2, 4.5):
        cells = {(dz, dy, dx) for dz, dy, w in stencil.sphere_runs(r) for dx in range(-w, w + 1)}
        n = range(-5, 6)
        assert cells == {p for p in itertools.product(n, n, n) if sum(c * c for c in p) <= r * r}
