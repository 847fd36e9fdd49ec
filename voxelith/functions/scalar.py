"""Scalar maps on voxel values and coordinates, as column expressions that stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def normalize(v: Column, lo: float, hi: float, bits: int = 16, ref_compat: bool = False) -> Column:
    """Values in [lo, hi] to 1..2**bits-1, zero staying zero; ``ref_compat`` wraps hi to 0 instead of clamping."""
    top = (1 << bits) - 1
    n = F.floor((dbl(v) - lo) / (hi - lo) * top).cast("long") + 1
    n = F.pmod(n, F.lit(1 << bits)) if ref_compat else F.least(n, F.lit(top))
    return F.when(v == 0, 0).otherwise(n).cast("int")


def cylinder(y: Column, x: Column, ny: int, nx: int, inclusive: bool = False) -> Column:
    """Whether (y, x) lies in the unit cylinder over linspace(-1, 1) on both axes."""
    a, b = dbl(y) * 2.0 / max(1, ny - 1) - 1.0, dbl(x) * 2.0 / max(1, nx - 1) - 1.0
    r2 = a * a + b * b
    return r2 <= 1.0 if inclusive else r2 < 1.0


def to_full_range(v: Column, lo: float, hi: float, top: int = 65535) -> Column:
    """(v - lo) / (hi - lo) over [0, top], truncated."""
    return F.floor((dbl(v) - lo) / (hi - lo) * top).cast("int")


def to_positive_range(v: Column, lo: float, hi: float, top: int = 65535) -> Column:
    """(v - lo) / (hi - lo) over [1, top]; equal bounds count as one apart."""
    span = hi - lo + (1 if hi == lo else 0)
    return (F.floor((dbl(v) - lo) / span * (top - 1)) + 1).cast("int")


def unit_to_int(f: Column, bits: int) -> Column:
    """A fraction as an unsigned integer of 8 or 16 bits, truncated."""
    return F.floor(dbl(f) * ((1 << bits) - 1)).cast("int")


def illuminate(mask: Column, f: Column) -> Column:
    """1 wherever the mask is set, else the field."""
    return F.when(mask > 0, F.lit(1.0)).otherwise(f)


def lit_mask(f: Column) -> Column:
    return (f == 1.0).cast("int")


def split_bytes(v: Column) -> tuple[Column, Column]:
    """High and low byte of a 16-bit value."""
    return F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)


def merge_bytes(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 8).bitwiseOR(low)


def dequantise(f: Column, lo: float, hi: float) -> Column:
    return dbl(f) * (hi - lo + 1) / 65535.0 + lo


def in_box(z: Column, y: Column, x: Column, box: tuple[int, int, int, int, int, int]) -> Column:
    """Closed box (z0, z1, y0, y1, x0, x1)."""
    return z.between(box[0], box[1]) & y.between(box[2], box[3]) & x.between(box[4], box[5])


def affine(z: Column, y: Column, x: Column, matrix) -> list[Column]:
    """The first three rows of a 4 x 4 matrix applied to (z, y, x, 1)."""
    return [dbl(z) * float(r[0]) + dbl(y) * float(r[1]) + dbl(x) * float(r[2]) + float(r[3]) for r in matrix[:3]]


def polar(v: Column, w: Column) -> tuple[Column, Column]:
    """theta = atan2(v, w) and the distance."""
    return F.atan2(dbl(v), dbl(w)), F.sqrt(dbl(v) * v + dbl(w) * w)


def gaussian(x: Column, a: Column, b: Column, c: Column) -> Column:
    return a * a * F.exp(-(b * b) * (x - c) * (x - c))


def exponential(x: Column, a: Column, b: Column, c: Column) -> Column:
    return a * a * F.exp(-(b * b) * F.abs(x - c))


def lorentzian(x: Column, a: Column, g: Column, c: Column) -> Column:
    return a * a * g * g / ((x - c) * (x - c) + g * g)


def power(x: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * a * F.exp(-(b * b) * F.pow(F.abs(x - c), d * d))


def rate_from_width(kind: Column, width: Column) -> Column:
    """Decay parameter that gives each kind of peak its width."""
    root = F.sqrt(F.lit(2.0) / width)
    return F.when(kind == "gauss", F.lit(6.0) / width).when(kind.isin("exp", "power"), root).when(kind == "lorentz", width / 4.0)


def value_bin(v: Column, lo: float, hi: float, bins: int, rounding: str = "floor") -> Column:
    """(bins - 1) * (v - lo) / (hi - lo), floored or rounded half away from zero."""
    at = dbl(v) - float(lo)
    at = at * float(bins - 1) / float(hi - lo)
    return (F.floor(at) if rounding == "floor" else F.round(at)).cast("int")


def mean_sd(column: str) -> list[Column]:
    return [F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd")]
