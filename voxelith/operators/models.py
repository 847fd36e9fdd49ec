"""Curves and probabilities fitted to histograms, and their use on voxels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.scalar import dbl, exponential, gaussian, lorentzian, power, value_bin
from voxelith.operators.align import small, with_field, with_table
from voxelith.operators.histogram import dense, otsu, smooth_plane
from voxelith.operators.voxels import ZYX, value_range

KINDS = {"gauss": gaussian, "exp": exponential, "lorentz": lorentzian}


def mixture(x: Column, peaks: Column, kind: str = "gauss") -> Column:
    """Sum of the peaks (an array of structs a, b, c[, d]) of one kind at x."""
    one = (lambda p: power(x, p["a"], p["b"], p["c"], p["d"])) if kind == "power" else (lambda p: KINDS[kind](x, p["a"], p["b"], p["c"]))
    return F.aggregate(F.transform(peaks, one), F.lit(0.0), lambda s, v: s + v)


# piecewise cubics ---------------------------------------------------------------------------------------------


def hermite_rows(x: np.ndarray, borders: np.ndarray, degree: int = 3) -> np.ndarray:
    """Design matrix of a C1 spline: values and slopes at the borders (degree 3), or a quadratic one by its slopes."""
    borders = np.asarray(borders, float)
    n = len(borders)
    k = np.clip(np.searchsorted(borders, x, side="right") - 1, 0, n - 2)
    h = borders[k + 1] - borders[k]
    t = (x - borders[k]) / h
    out = np.zeros((len(x), 2 * n if degree == 3 else n + 1))
    rows = np.arange(len(x))
    if degree == 3:
        out[rows, k], out[rows, k + 1] = 2 * t**3 - 3 * t**2 + 1, -2 * t**3 + 3 * t**2
        out[rows, n + k], out[rows, n + k + 1] = h * (t**3 - 2 * t**2 + t), h * (t**3 - t**2)
        return out
    # quadratic: a value at the first border, slopes at all; earlier segments add their mean slopes
    out[:, 0] = 1
    for j in range(n - 1):
        w = borders[j + 1] - borders[j]
        s = np.clip((x - borders[j]) / w, 0, 1)
        out[:, 1 + j] += w * (s - s * s / 2)
        out[:, 2 + j] += w * s * s / 2
    return out


def fit_piecewise(x, y, borders, degree: int = 3, beta: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, borders) of the least-squares C1 spline; ``beta`` pulls coefficients towards zero."""
    x, y, borders = (np.asarray(v, float) for v in (x, y, borders))
    a = hermite_rows(x, borders, degree)
    if beta:
        a, y = np.vstack([a, np.sqrt(beta) * np.eye(a.shape[1])]), np.concatenate([y, np.zeros(a.shape[1])])
    return np.linalg.lstsq(a, y, rcond=None)[0], borders


def eval_piecewise(x, fit: tuple[np.ndarray, np.ndarray], outside: str = "cubic", degree: int = 3) -> np.ndarray:
    """Values in the order of x; beyond the borders the end pieces go on, or their tangents, or their end values."""
    coefs, borders = fit
    x = np.asarray(x, float)
    inner = np.clip(x, borders[0], borders[-1])
    if outside == "cubic":
        return hermite_rows(x, borders, degree) @ coefs
    y = hermite_rows(inner, borders, degree) @ coefs
    if outside == "linear":
        eps = (borders[-1] - borders[0]) * 1e-6
        lo, hi = ((hermite_rows(np.array([b + e]), borders, degree) - hermite_rows(np.array([b]), borders, degree)) @ coefs / e for b, e in ((borders[0], eps), (borders[-1], -eps)))
        y = y + np.where(x < borders[0], (x - borders[0]) * lo, 0) + np.where(x > borders[-1], (x - borders[-1]) * hi, 0)
    return y


def smooth_curve(x, y, borders: int, outside: str = "cubic") -> np.ndarray:
    """y smoothed by a piecewise cubic with ``borders`` evenly spaced borders."""
    x = np.asarray(x, float)
    return eval_piecewise(x, fit_piecewise(x, y, np.linspace(x.min(), x.max() + 1, borders)), outside)


def smooth_groups(rows: DataFrame, key: str, x: str, y: str, borders: int) -> DataFrame:
    """The same for each group of a table: one group is one curve of a histogram's size."""
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        return pdf.assign(smooth=smooth_curve(pdf[x], pdf[y], borders))[[key, x, "smooth"]]

    return rows.select(key, x, dbl(F.col(y)).alias(y)).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {x} {kinds[x]}, smooth double")


# fits of peaks ------------------------------------------------------------------------------------------------


def fit_peaks(x: np.ndarray, y: np.ndarray, count: int, rounds: int = 60) -> np.ndarray:
    """(count, 3) parameters a, b, c of Gaussians a^2 exp(-b^2 (x - c)^2), by damped least squares within bounds."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    span = max(1.0, x.max() - x.min())
    left, start = y.astype(float).copy(), []
    for _ in range(count):
        k = int(left.argmax())
        b = 6 / (span / 4)
        start.append([np.sqrt(max(left[k], 0)), b, x[k]])
        left = left - start[-1][0] ** 2 * np.exp(-(b**2) * (x - x[k]) ** 2)
    p, damp = np.array(start), 1e-2
    lo, hi = np.array([0, 1 / span, x.min()]), np.array([2 * np.sqrt(y.max() + 1), 6.0, x.max()])
    model = lambda q: (q[:, 0, None] ** 2 * np.exp(-(q[:, 1, None] ** 2) * (x - q[:, 2, None]) ** 2)).sum(0)
    p = np.clip(p, lo, hi)
    best = ((model(p) - y) ** 2).sum()
    for _ in range(rounds):
        a, b, c = (p[:, i, None] for i in range(3))
        g = np.exp(-(b**2) * (x - c) ** 2)
        jac = np.stack([2 * a * g, -2 * a * a * b * (x - c) ** 2 * g, 2 * a * a * b * b * (x - c) * g], 1).reshape(3 * count, -1).T
        r = model(p) - y
        h = jac.T @ jac
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-9), jac.T @ r).reshape(count, 3)
        new = np.clip(p - step, lo, hi)
        e = ((model(new) - y) ** 2).sum()
        p, best, damp = (new, e, damp / 3) if e < best else (p, best, damp * 4)
        if damp > 1e12:
            break
    return p[np.argsort(p[:, 2])]


def fit_rows(hist: DataFrame, count: int) -> DataFrame:
    """Peaks (row, material, a, b, c) of each row of a histogram; a row is one fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        p = fit_peaks(pdf["bin"].to_numpy(), pdf["n"].to_numpy(), count)
        return pd.DataFrame({"row": pdf["row"].iloc[0], "material": np.arange(count, dtype=np.int32), "a": p[:, 0], "b": p[:, 1], "c": p[:, 2]})

    return hist.groupBy("row").applyInPandas(run, "row int, material int, a double, b double, c double")


def powers(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^2 exp(-b^2 |x - c|^(d^2)) of each row (a, b, c, d) of parameters, at x."""
    a, b, c, d = (p[:, k, None] for k in range(4))
    return a**2 * np.exp(-(b**2) * np.abs(x - c) ** (d**2))


def fit_energy(x: np.ndarray, y: np.ndarray, p: np.ndarray, closeness: float = 100.0) -> float:
    """Mean squared residual, that of overshoots once more, and what keeps centres apart."""
    r = y - powers(x, p).sum(0)
    close = (1 / (np.abs(np.diff(p[:, 2])) + 0.001)).sum()
    return float((r * r).mean() + closeness * close + (np.where(r < 0, r, 0) ** 2).mean())


def descend(energy, p: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> np.ndarray:
    """A least point of ``energy`` within bounds: each parameter in turn takes a better step either way, steps grow where they help and shrink where not."""
    p = np.clip(p, low, high)
    step = np.maximum((high - low) / 8, 1e-9)
    best = energy(p)
    for _ in range(rounds):
        for at in np.ndindex(p.shape):
            for sign in (1, -1):
                q = p.copy()
                q[at] = np.clip(p[at] + sign * step[at], low[at], high[at])
                e = energy(q)
                if e < best:
                    p, best = q, e
                    step[at] *= 1.6
                    break
            else:
                step[at] *= 0.4
        if (step < 1e-7 * np.maximum(1, high - low)).all():
            break
    return p


def fit_powers(x, y, labels) -> np.ndarray:
    """(materials, 4) parameters of a row of counts y at x whose bins carry materials (0: none); material k is row k - 1 of those there.

    Starts are each material's greatest count, its place, and widths from half the distance to the next centre;
    bounds as wide as the labelled bins and the model allow.
    """
    x, y, labels = np.asarray(x, float), np.asarray(y, float), np.asarray(labels)
    there = [m for m in np.unique(labels) if m > 0 and y[labels == m].max(initial=0) > 0]
    if not there:
        return np.zeros((0, 5))
    own = [np.flatnonzero(labels == m) for m in there]
    tops = np.array([i[y[i].argmax()] for i in own])
    a, c = np.sqrt(y[tops]), x[tops]
    gaps = np.diff(c) / 2
    width = np.concatenate([gaps[:1], gaps]) if len(gaps) else np.array([0.0])
    b = np.sqrt(3 / (width**2 + (width == 0)))
    d = np.full(len(there), np.sqrt(2.0))
    low = np.stack([0.3 * a, np.minimum(0.5, np.maximum(0.1 * b, 1e-3)), np.array([x[i].min() for i in own]), np.full(len(there), np.sqrt(1.5))], 1)
    high = np.stack([1.1 * a, np.maximum(np.minimum(2.0 * b, 0.7), low[:, 1]), np.array([x[i].max() for i in own]), np.full(len(there), np.sqrt(2.5))], 1)
    p = descend(lambda q: fit_energy(x, y, q), np.stack([a, b, c, d], 1), low, high)
    return np.column_stack([there, p])


def fit_power_rows(hist: DataFrame) -> DataFrame:
    """Peaks (row, material, a, b, c, d, energy) of each row of a dense histogram (row, bin, n, material); a row is one fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        p = fit_powers(pdf["bin"], pdf["n"], pdf["material"])
        e = fit_energy(pdf["bin"].to_numpy(float), pdf["n"].to_numpy(float), p[:, 1:]) if len(p) else 0.0
        return pd.DataFrame({"row": pdf["row"].iloc[0], "material": p[:, 0].astype(np.int32), **{k: p[:, i] for i, k in enumerate("abcd", 1)}, "energy": e})

    return hist.groupBy("row").applyInPandas(run, "row int, material int, a double, b double, c double, d double, energy double")


def smooth_parameters(peaks: DataFrame, rows: int, borders: int) -> DataFrame:
    """Each material's parameters as smooth curves over all ``rows`` rows: centres go on as cubics, the others as constants beyond the rows fitted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at = pdf.sort_values("row"), np.arange(rows)
        x = pdf["row"].to_numpy(float)
        n = max(2, min(borders, len(x) // 2))
        curve = lambda k: eval_piecewise(at, fit_piecewise(x, pdf[k], np.linspace(x.min(), x.max() + 1, n)), "cubic" if k == "c" else "constant")
        return pd.DataFrame({"material": pdf["material"].iloc[0], "row": at.astype(np.int32), **{k: curve(k) for k in "abcd"}, "good": (at >= x.min()) & (at <= x.max())})

    return peaks.groupBy("material").applyInPandas(run, "material int, row int, a double, b double, c double, d double, good boolean")


def power_probabilities(hist: DataFrame, curves: DataFrame, rows: int, bins: int, sigma: float = 10.0, tail: float = 0.001) -> DataFrame:
    """(material, row, bin, p): each of two materials' model over the greater of counts and the whole model, then blurred.

    Long tails are cut: what is under ``tail`` of a row's greatest value, rows beyond those fitted, and bins on the
    far side of the other material's centre.
    """
    other = curves.select((F.lit(3) - F.col("material")).alias("material"), "row", F.col("c").alias("far"))
    grid = curves.join(other, ["material", "row"], "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    m = grid.withColumn("m", power(F.col("bin").cast("double"), F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    top = F.max("m").over(Window.partitionBy("material", "row"))
    beyond = F.when(F.col("material") == 1, F.col("bin") >= F.col("far")).otherwise(F.col("bin") <= F.col("far"))
    m = m.withColumn("m", F.when((F.col("m") < tail * top) | ~F.col("good") | F.coalesce(beyond, F.lit(False)), 0.0).otherwise(F.col("m")))
    m = m.withColumn("total", F.sum("m").over(Window.partitionBy("row", "bin")))
    joined = m.join(hist.select("row", "bin", "n"), ["row", "bin"], "left")
    raw = joined.select("material", "row", "bin", (F.col("m") / F.greatest(dbl(F.coalesce("n", F.lit(0))), F.col("total"), F.lit(1e-12))).alias("n"))
    parts = [smooth_plane(raw.where(F.col("material") == k), rows, bins, sigma).select(F.lit(k).alias("material"), "row", "bin", F.col("s").alias("p")) for k in (1, 2)]
    return parts[0].unionByName(parts[1])


def fit_globally(hist: np.ndarray, start: np.ndarray, borders: np.ndarray, power_: float = 1.6, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Curves of all rows' peaks at once: values (materials, 3, borders) of a, b and c at borders, joined by lines, that lessen the mean squared residual of the whole image; and that residual.

    ``hist`` is an image of rows and bins. A histogram is of a bounded size, so this runs on the driver.
    """
    rows, bins = hist.shape
    at, v = np.arange(rows), np.arange(bins)

    def model(g: np.ndarray) -> np.ndarray:
        total = np.zeros(hist.shape)
        for a, b, c in g:
            a, b, c = (np.interp(at, borders, k)[:, None] for k in (a, b, c))
            total += a**2 * np.exp(-(b**2) * np.abs(v - c) ** power_)
        return total

    energy = lambda g: float(((hist - model(g)) ** 2).mean())
    low = np.stack([np.zeros_like(start[:, 0]), np.full_like(start[:, 1], 1e-3), np.zeros_like(start[:, 2])], 1)
    high = np.stack([2 * start[:, 0] + 1, np.full_like(start[:, 1], 3.0), np.full_like(start[:, 2], bins - 1.0)], 1)
    g = descend(energy, start, low, high, rounds)
    return g, energy(g)


def fitted_probabilities(hist: DataFrame, peaks: DataFrame, rows: int, bins: int, sigma: float = 10.0) -> DataFrame:
    """(material, row, bin, p): each material's model over the greater of counts and the whole model, then blurred."""
    grid = peaks.select("row", "material", "a", "b", "c", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    m = grid.select("row", "material", "bin", gaussian(F.col("bin").cast("double"), F.col("a"), F.col("b"), F.col("c")).alias("m"))
    m = m.withColumn("total", F.sum("m").over(Window.partitionBy("row", "bin")))
    joined = m.join(hist.select("row", "bin", "n"), ["row", "bin"], "left")
    raw = joined.select("material", "row", "bin", (F.col("m") / F.greatest(dbl(F.coalesce("n", F.lit(0))), F.col("total"), F.lit(1e-12))).alias("n"))
    out = None
    for r in raw.select("material").distinct().collect():  # a few materials
        one = smooth_plane(raw.where(F.col("material") == r[0]), rows, bins, sigma).select(F.lit(r[0]).alias("material"), "row", "bin", F.col("s").alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


def otsu_probabilities(hist: DataFrame, bins: int, least: int = 100, borders: int = 12) -> DataFrame:
    """(material, row, bin, p): counts over their row's maximum, below (0) and from (1) a smoothed Otsu threshold.

    Rows with fewer than ``least`` counts have threshold 0 before smoothing. Thresholds are one number a row and
    are smoothed on the driver.
    """
    totals = hist.groupBy("row").agg(F.sum("n").alias("total"))
    found = otsu(hist, bins).join(totals, "row").select("row", F.when(F.col("total") < least, 0).otherwise(F.col("threshold")).alias("t")).orderBy("row").toPandas()
    t = found["t"].to_numpy(float)
    used = np.flatnonzero(t > 0)
    if len(used) > 2 * borders:
        a, b = used[0], used[-1] + 1
        fit = fit_piecewise(found["row"][a:b], t[a:b], np.linspace(found["row"][a], found["row"][b - 1] + 1, borders))
        t = eval_piecewise(found["row"], fit, "linear")
    cut = hist.sparkSession.createDataFrame([(int(r), int(max(0, min(bins, round(v))))) for r, v in zip(found["row"], t, strict=True)], "row int, t int")
    rows = dense(hist, bins).join(F.broadcast(cut), "row").withColumn("material", (F.col("bin") >= F.col("t")).cast("int"))
    top = F.max("n").over(Window.partitionBy("row"))
    return rows.withColumn("top", top).where("n > 0").select("material", "row", "bin", (dbl(F.col("n")) / F.col("top")).alias("p"))


def material_probability(vol: DataFrame, field: DataFrame, table: DataFrame, shape, coarse, vrange, frange, bins: tuple[int, int], sampling: str = "nearest") -> DataFrame:
    """(z, y, x, material, p16): the table's value at each voxel's bins, as 16 bits.

    ``sampling`` of the field: the coarse voxel that holds the voxel (nearest), or trilinear at its centre.
    """
    kept = value_range(vol, *vrange)
    if sampling == "nearest":
        at = with_field(kept, field, shape, coarse)
    else:
        from voxelith.operators.resample import trilinear

        points = kept.select(*[F.col(c).alias(f"i{c}") for c in ZYX], F.col("v").alias("iv"), *[((F.col(c) + 0.5) * (m / n)).alias(f"p{c}") for c, n, m in zip(ZYX, shape, coarse, strict=True)])
        at = trilinear(points, field.withColumnRenamed("f", "v"), coarse, ["iz", "iy", "ix", "iv"]).select(F.col("iz").alias("z"), F.col("iy").alias("y"), F.col("ix").alias("x"), F.col("iv").alias("v"), F.col("value").alias("f"))
    clamped = F.greatest(F.lit(float(frange[0])), F.least(F.lit(float(frange[1])), dbl(F.col("f"))))
    binned = at.withColumn("field_bin", value_bin(clamped, *frange, bins[0])).withColumn("voxel_bin", value_bin(F.col("v"), *vrange, bins[1]))
    return with_table(binned, table).select(*ZYX, "material", F.round(F.col("p") * 65535.0).cast("int").alias("p16"))


def weighted_probability(vol: DataFrame, tables: dict[str, tuple[DataFrame, float]], rows: dict[str, Column], vrange, bins: int) -> DataFrame:
    """Weighted sum of several tables (row, bin, p), each looked up by its own row expression."""
    out = value_range(vol, *vrange).withColumn("bin", value_bin(F.col("v"), *vrange, bins)).withColumn("total", F.lit(0.0))
    for name, (table, weight) in tables.items():
        side = table.select(F.col("row").alias("__row"), "bin", F.col("p").alias("__p"))
        out = out.withColumn("__row", rows[name]).join(small(side), ["__row", "bin"], "left")
        out = out.withColumn("total", F.col("total") + F.coalesce("__p", F.lit(0.0)) * float(weight)).drop("__row", "__p")
    return out.drop("bin")


def nearest_peak(labels: DataFrame, positions: list[float]) -> DataFrame:
    """Material (from 1) of each label by its mean bin: that of the nearest peak, the first of equals."""
    means = labels.groupBy("label").agg((F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("mean"))
    gaps = F.array(*[F.abs(F.col("mean") - float(p)) for p in positions])
    return means.withColumn("material", F.array_position(gaps, F.array_min(gaps)).cast("int"))


def cluster_1d(hist: DataFrame, centres: list[float], rounds: int = 30) -> list[float]:
    """k-means of a 1-D histogram (bin, n), from given centres: each round is one aggregation over the bins."""
    for _ in range(rounds):
        gaps = F.array(*[F.abs(F.col("bin") - float(c)) for c in centres])
        near = F.array_position(gaps, F.array_min(gaps)) - 1
        sums = {r["k"]: r["m"] for r in hist.groupBy(near.alias("k")).agg((F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("m")).collect()}
        new = [sums.get(i, c) for i, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return centres


def absorption_classes(hist: DataFrame, centres: list[float]) -> DataFrame:
    """(bin, class, p): share of each class's density at a bin, at most 1, classes being Gaussians around clusters."""
    found = sorted(cluster_1d(hist, centres))
    gaps = F.array(*[F.abs(F.col("bin") - c) for c in found])
    near = F.array_position(gaps, F.array_min(gaps)) - 1
    spread = {r["k"]: (r["n"], max(r["s"], 0.5)) for r in hist.groupBy(near.alias("k")).agg(F.sum("n").alias("n"), F.sqrt(F.sum(F.col("n") * F.pow(F.col("bin") - F.element_at(F.array(*map(F.lit, found)), (near + 1).cast("int")), F.lit(2))) / F.sum("n")).alias("s")).collect()}
    density = [F.lit(spread[k][0] / spread[k][1]) * F.exp(-F.pow((F.col("bin") - c) / spread[k][1], F.lit(2)) / 2.0) if k in spread else F.lit(0.0) for k, c in enumerate(found)]
    total = sum(density[1:], density[0])
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.least(d / F.nullif(total, F.lit(0.0)), F.lit(1.0)).alias("p")) for k, d in enumerate(density)])
    return hist.select("bin", F.explode(each).alias("e")).select("bin", "e.class", "e.p")


def fft_rows(rows: DataFrame, n: int) -> DataFrame:
    """(row, k, re, im): discrete Fourier transform of each row, zero-filled to n bins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(n)
        line[pdf["bin"]] = pdf["n"]
        f = np.fft.rfft(line)
        return pd.DataFrame({"row": pdf["row"].iloc[0], "k": np.arange(len(f), dtype=np.int32), "re": f.real, "im": f.imag})

    return rows.groupBy("row").applyInPandas(run, "row int, k int, re double, im double")
