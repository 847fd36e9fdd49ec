"""Exact Euclidean distances, axis by axis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.voxels import ZYX

Shape = tuple[int, int, int]


def lower_envelope(cost: np.ndarray) -> np.ndarray:
    """min over q of (p - q)^2 + cost[line, q] for each line and p: envelopes of parabolas, all lines at a time; infinite costs have none."""
    lines, n = cost.shape
    tops, bounds = np.zeros((lines, n), np.int32), np.empty((lines, n + 1))
    last = np.full(lines, -1)
    finite = np.isfinite(cost)
    for q in range(n):
        at = np.flatnonzero(finite[:, q])
        while len(at):
            k = last[at]
            p = tops[at, np.maximum(k, 0)]
            with np.errstate(invalid="ignore", divide="ignore"):
                s = ((cost[at, q] + q * q) - (cost[at, p] + p * p)) / (2.0 * (q - p))
            s[k < 0] = -np.inf
            covered = (k >= 0) & (s <= bounds[at, np.maximum(k, 0)])
            on = ~covered
            last[at[on]] += 1
            tops[at[on], last[at[on]]] = q
            bounds[at[on], last[at[on]]] = s[on]
            at = at[covered]
            last[at] -= 1
    bounds[np.arange(lines), last + 1] = np.inf
    out, k, used = np.full((lines, n), np.inf), np.zeros(lines, np.int64), np.flatnonzero(last >= 0)
    for p in range(n):
        behind = used[bounds[used, k[used] + 1] < p]
        while len(behind):
            k[behind] += 1
            behind = behind[bounds[behind, k[behind] + 1] < p]
        q = tops[used, k[used]]
        out[used, p] = (p - q) ** 2 + cost[used, q]
    return out


def squared_distances(mask: DataFrame, shape: Shape, lines: int = 64) -> DataFrame:
    """Squared distance (z, y, x, d2) of every voxel to the mask; no rows if no voxel of the mask lies in the volume.

    Lines along x need only the mask's rows, lines along y and z those of the voxels reached so far. A group is a
    strip of up to ``lines`` lines, so each of the three shuffles has many groups and each group fits in memory.
    """
    kinds = "z int, y int, x int, d2 double"

    def along(axis: str):
        at = ZYX.index(axis)
        outer, inner = (c for c in ZYX if c != axis)

        def run(pdf):
            (o,) = {*pdf[outer].tolist()}
            own, line = np.unique(pdf[inner].to_numpy(), return_inverse=True)
            cost = np.full((len(own), shape[at]), np.inf)
            cost[line, pdf[axis].to_numpy()] = pdf["d2"].to_numpy()
            d2 = lower_envelope(cost).ravel()
            cols = {outer: np.full(len(d2), o, np.int32), inner: np.repeat(own, shape[at]).astype(np.int32), axis: np.tile(np.arange(shape[at], dtype=np.int32), len(own))}
            return pd.DataFrame({**{c: cols[c] for c in ZYX}, "d2": d2})

        return [outer, F.expr(f"{inner} div {lines}").alias("__strip")], run

    inside = F.lit(True)
    for c, n in zip(ZYX, shape, strict=True):
        inside = inside & F.col(c).between(0, n - 1)
    field = mask.select(*ZYX).where(inside).distinct().withColumn("d2", F.lit(0.0))
    for axis in ("x", "y", "z"):
        keys, run = along(axis)
        field = field.groupBy(*keys).applyInPandas(run, kinds)
    return field


def distances(mask: DataFrame, shape: Shape) -> DataFrame:
    """Distances as whole numbers, truncated as 16-bit storage does."""
    return squared_distances(mask, shape).select(*ZYX, F.floor(F.sqrt("d2")).cast("int").alias("f"))
