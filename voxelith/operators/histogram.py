"""Histograms, thresholds from them, and ordered operators on their rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.scalar import dbl, value_bin
from voxelith.operators.align import with_field
from voxelith.operators.voxels import value_range


def radius(shape: tuple[int, int, int]) -> Column:
    """Whole distance from the middle of a slice."""
    cy, cx = shape[1] // 2, shape[2] // 2
    d = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)
    return F.floor(F.sqrt(dbl(d))).cast("int")


def axis_histograms(vol: DataFrame, lo: float, hi: float, bins: int, shape: tuple[int, int, int], axes: tuple[str, ...] = ("x", "y", "z", "r"), rounding: str = "floor") -> DataFrame:
    """(axis, row, bin, n) over several axes in one pass: grouping sets, combined before the shuffle."""
    kept = value_range(vol, lo, hi).withColumn("bin", value_bin(F.col("v"), lo, hi, bins, rounding))
    if "r" in axes:
        kept = kept.withColumn("r", radius(shape))
    if len(axes) == 1:
        return kept.groupBy(F.lit(axes[0]).alias("axis"), F.col(axes[0]).alias("row"), "bin").agg(F.count("*").alias("n"))
    sets = [[F.col(a), F.col("bin")] for a in axes]
    name = F.coalesce(*[F.when(F.grouping(a) == 0, F.lit(a)) for a in axes])
    out = kept.groupingSets(sets, *[F.col(a) for a in axes], F.col("bin")).agg(name.alias("axis"), F.count("*").alias("n"))
    return out.select("axis", F.coalesce(*[F.when(F.col("axis") == a, F.col(a)) for a in axes]).cast("int").alias("row"), "bin", "n")


def field_histogram(vol: DataFrame, field: DataFrame, shape, coarse, vrange: tuple[float, float], frange: tuple[float, float], bins: tuple[int, int]) -> DataFrame:
    """(row, bin, n): counts by bin of the field and of the voxel's value."""
    kept = with_field(value_range(vol, *vrange), field, shape, coarse).where(F.col("f").between(*frange) & (F.col("f") > 0))
    row, bin_ = value_bin(F.col("f"), *frange, bins[0]), value_bin(F.col("v"), *vrange, bins[1])
    return kept.groupBy(row.alias("row"), bin_.alias("bin")).agg(F.count("*").alias("n"))


def bin_count(rows: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Count of each id; with ``bins`` all ids below it appear."""
    out = rows.groupBy(F.col(column).cast("long").alias("id")).agg(F.count("*").alias("n"))
    if bins is None:
        return out
    every = rows.sparkSession.range(bins)
    return every.join(out, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dense(hist: DataFrame, bins: int) -> DataFrame:
    """All bins of each row, zero where absent: an array a row, as wide as there are bins."""
    rows = hist.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return rows.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("long"))).alias("bin", "n"))


def otsu(hist: DataFrame, bins: int, step: int = 1) -> DataFrame:
    """Threshold of each row that minimises the floored sum of squares within both classes; the first of equals.

    Prefix sums of n, n b and n b^2 give each candidate's sums in one window.
    """
    w = Window.partitionBy("row").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("row")
    b = F.col("bin").cast("long")
    sums = dense(hist, bins)
    for k, e in (("c", F.col("n")), ("s", F.col("n") * b), ("q", F.col("n") * b * b)):
        sums = sums.withColumn(f"{k}0", F.coalesce(F.sum(e).over(w), F.lit(0))).withColumn(f"{k}t", F.sum(e).over(whole))
    sse = lambda c, s, q: dbl(q) - dbl(s) * dbl(s) / dbl(c)
    c1, s1, q1 = (F.col(f"{k}t") - F.col(f"{k}0") for k in "csq")
    empty = (F.col("c0") == 0) | (c1 == 0)
    crit = F.when(~empty, F.floor(sse(F.col("c0"), F.col("s0"), F.col("q0")) + sse(c1, s1, q1)).cast("long")).otherwise(F.lit((1 << 63) - 1))
    return sums.where(F.col("bin") % step == 0).withColumn("crit", crit).groupBy("row").agg(F.min(F.struct("crit", "bin")).alias("m")).select("row", F.col("m.bin").alias("threshold"), F.col("m.crit").alias("crit"))


def kernel(sigma: float, radius: int | None = None) -> list[float]:
    """Normalised Gaussian weights of radius round(4 sigma)."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def smooth_rows(hist: DataFrame, bins: int, sigma: float, border: str = "reflect") -> DataFrame:
    """Each dense row (row, bin, n) convolved with a Gaussian; ``border`` is reflect (edge repeated) or zero.

    Every bin is dealt to those within the kernel's reach, mirrored ones included, and summed: one shuffle.
    """
    w = kernel(sigma)
    r = len(w) // 2
    weights = F.array(*map(F.lit, w))
    reach = hist.where("n <> 0").select("row", "bin", dbl(F.col("n")).alias("n"))
    places = [F.col("bin")]
    if border == "reflect":
        # positions outside that mirror this bin: rows repeat every two lengths, there and back
        times = r // (2 * bins) + 1
        places += [F.col("bin") + 2 * bins * k for k in range(-times, times + 1) if k] + [2 * bins * k - 1 - F.col("bin") for k in range(-times, times + 1)]
    spread = reach.select("row", "n", F.explode(F.array(*places)).alias("p")).where(F.col("p").between(-r, bins - 1 + r))
    taps = spread.select("row", F.explode(F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda d: F.struct((F.col("p") + d).alias("bin"), (F.col("n") * F.element_at(weights, (d + r + 1).cast("int"))).alias("s")))).alias("t"))
    summed = taps.select("row", "t.*").where(F.col("bin").between(0, bins - 1)).groupBy("row", "bin").agg(F.sum("s").alias("s"))
    return summed.select("row", F.col("bin").cast("int").alias("bin"), "s")


def smooth_plane(hist: DataFrame, rows: int, bins: int, sigma: float) -> DataFrame:
    """A 2-D Gaussian with zero border: two separable passes."""
    flipped = smooth_rows(hist, bins, sigma, "zero").select(F.col("bin").alias("row"), F.col("row").alias("bin"), F.col("s").alias("n"))
    return smooth_rows(flipped, rows, sigma, "zero").select(F.col("bin").alias("row"), F.col("row").alias("bin"), "s")


def peaks(rows: DataFrame, value: str = "n", height: Column | float = 0.0) -> DataFrame:
    """Local maxima (row, bin, value) of dense rows; of a plateau, the middle bin. Ends of a row are no peaks."""
    w = Window.partitionBy("row").orderBy("bin")
    change = rows.withColumn("__new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    runs = change.withColumn("__run", F.sum("__new").over(w)).groupBy("row", "__run").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.first(value).alias(value))
    r = Window.partitionBy("row").orderBy("__run")
    near = runs.withColumn("__l", F.lag(value).over(r)).withColumn("__r", F.lead(value).over(r))
    top = near.where((F.col("__l") < F.col(value)) & (F.col("__r") < F.col(value)) & (F.col(value) >= height))
    return top.select("row", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("bin"), value)


def ranked_peaks(found: DataFrame, count: int, value: str = "n", lowest: bool = False) -> DataFrame:
    """The highest (or lowest) peaks of each row, by height and then position."""
    order = F.col(value).asc() if lowest else F.col(value).desc()
    w = Window.partitionBy("row").orderBy(order, "bin")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def valley(rows: DataFrame, bins: int, sigma: float) -> DataFrame:
    """Of each row the lowest bin between its two highest peaks after smoothing; the first of equals."""
    smooth = smooth_rows(rows, bins, sigma).withColumn("s", F.round("s", 6))
    two = ranked_peaks(peaks(smooth, "s"), 2, "s").groupBy("row").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.count("*").alias("k")).where("k = 2")
    return smooth.join(two, "row").where("bin >= a and bin < b").groupBy("row").agg(F.min(F.struct("s", "bin")).alias("m")).select("row", F.col("m.bin").alias("bin"))


def gradient(rows: DataFrame, value: str = "n") -> DataFrame:
    """Central differences along bins, one-sided at the ends."""
    w = Window.partitionBy("row").orderBy("bin")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    here = F.col(value)
    return rows.withColumn("slope", F.when(before.isNull(), dbl(after - here)).when(after.isNull(), dbl(here - before)).otherwise(dbl(after - before) / 2.0))


def sliding_sum(rows: DataFrame, width: int, value: str = "n") -> DataFrame:
    """Sum of ``width`` consecutive bins from each on; only full windows."""
    w = Window.partitionBy("row").orderBy("bin").rowsBetween(0, width - 1)
    return rows.withColumn("total", F.sum(value).over(w)).withColumn("__k", F.count(value).over(w)).where(F.col("__k") == width).drop("__k")


def sliding_sum_2d(rows: DataFrame, width: int, value: str = "n") -> DataFrame:
    """Sum of a square of ``width`` rows and bins from each place on; only full squares of dense rows."""
    along = sliding_sum(rows, width, value).select("row", "bin", "total")
    w = Window.partitionBy("bin").orderBy("row").rowsBetween(0, width - 1)
    whole = along.withColumn("__k", F.count("total").over(w)).withColumn("total", F.sum("total").over(w))
    return whole.where(F.col("__k") == width).drop("__k")


def profiles(points: DataFrame, ranges: dict[str, tuple[float, float]], bins: int = 200) -> DataFrame:
    """(axis, bin, n): dense histograms of several coordinates over their ranges, in one pass."""
    each = [F.struct(F.lit(k).alias("axis"), F.floor((F.col(k) - lo) * (bins / (hi - lo))).cast("int").alias("bin")) for k, (lo, hi) in ranges.items()]
    counted = points.select(F.explode(F.array(*each)).alias("e")).select("e.*").where(F.col("bin").between(0, bins - 1)).groupBy("axis", "bin").agg(F.count("*").alias("n"))
    spark = points.sparkSession
    every = spark.createDataFrame([(k,) for k in ranges], "axis string").crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    return every.join(counted, ["axis", "bin"], "left").select("axis", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def profile_ranges(found: DataFrame) -> DataFrame:
    """(axis, rise, fall): the bins where each profile rises and falls most, the first of equals."""
    slopes = gradient(found.withColumnRenamed("axis", "row"))
    return row_extremes(slopes, "slope").select(F.col("row").alias("axis"), F.col("argmax").alias("rise"), F.col("argmin").alias("fall"))


def support(rows: DataFrame) -> DataFrame:
    """First and last bin of each row that isn't zero."""
    return rows.where("n > 0").groupBy("row").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))


def row_extremes(rows: DataFrame, value: str = "n") -> DataFrame:
    """Bins of each row's greatest and least value; the lowest bin of equals."""
    hi, lo = F.min(F.struct((-F.col(value)).alias("k"), "bin")), F.min(F.struct(F.col(value).alias("k"), "bin"))
    return rows.groupBy("row").agg(hi.alias("h"), lo.alias("l")).select("row", F.col("h.bin").alias("argmax"), F.col("l.bin").alias("argmin"))


def residuals(rows: DataFrame) -> DataFrame:
    """Energy terms of a model against counts (columns n and m): mean squared residual, and that of overshoots."""
    r = dbl(F.col("n")) - F.col("m")
    return rows.agg((F.sum(r * r) / F.count("*")).alias("e1"), (F.sum(F.when(r < 0, r * r).otherwise(0.0)) / F.count("*")).alias("e2"))


def energy(rows: DataFrame, centres: list[float], weight: float = 100.0) -> DataFrame:
    """e1 and e2 of a model against counts, the closeness of its peaks' centres, and their total."""
    close = sum(1 / (abs(b - a) + 0.001) for a, b in zip(centres, centres[1:], strict=False))
    return residuals(rows).withColumn("closeness", F.lit(float(close))).withColumn("total", F.col("e1") + weight * F.col("closeness") + F.col("e2"))


def segment_starts(labels: DataFrame) -> DataFrame:
    """(label, n, start) of each label but 0: where its voxels begin in a list ordered by label. One row a label."""
    sizes = labels.where("label <> 0").groupBy("label").agg(F.count("*").alias("n"))
    w = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def select_segments(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """The voxels of the labels that a table names."""
    return labels.join(chosen.select("label").distinct(), "label", "left_semi")


def bone_contact(vol: DataFrame, field: DataFrame, shape, coarse, limit: float, soft: Column) -> DataFrame:
    """Of each slice the share of voxels near the implant (0 < f < limit) that are not soft; 0 where there are none."""
    near = with_field(vol, field, shape, coarse).where((F.col("f") > 0) & (F.col("f") < limit))
    per = near.groupBy("z").agg(F.count("*").alias("total"), F.sum(F.when(soft, 1).otherwise(0)).alias("soft"))
    every = vol.select("z").distinct()
    return every.join(per, "z", "left").select("z", F.coalesce(1.0 - dbl(F.col("soft")) / dbl(F.col("total")), F.lit(0.0)).alias("bic"))


def range_stats(per_slice: DataFrame, ranges: dict[str, tuple[int, int]], value: str = "bic") -> DataFrame:
    """Mean and population deviation over ranges of slices."""
    name = F.coalesce(*[F.when(F.col("z").between(a, b), F.lit(k)) for k, (a, b) in ranges.items()])
    return per_slice.withColumn("range", name).where("range is not null").groupBy("range").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def segment_reduce(rows: DataFrame, segment: str, value: str, how: str = "sum") -> DataFrame:
    """Segmented reduction with any aggregate by name."""
    return rows.groupBy(segment).agg(F.expr(f"{how}({value})").alias("value"))
