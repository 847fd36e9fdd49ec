"""Operators on planes: images of a histogram's size, one group each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NEAR = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]  # round a pixel, from the one above


def components_2d(mask: np.ndarray, corners: bool) -> np.ndarray:
    """Numbers from 1 of the parts of a mask, in the order of their first pixels; with ``corners`` corners touch too."""
    out, n = np.zeros(mask.shape, np.int64), 0
    steps = NEAR if corners else NEAR[::2]
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        out[start], queue = n, [start]
        while queue:
            y, x = queue.pop()
            for dy, dx in steps:
                p = y + dy, x + dx
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    queue.append(p)
    return out


def outline(part: np.ndarray) -> float:
    """Length of a part's outer border, walked from pixel to pixel round its outside; diagonal steps count sqrt 2."""
    padded = np.pad(part, 1)
    start = tuple(int(c) for c in np.argwhere(padded)[0])
    at, back, length, first = start, 6, 0.0, None  # came from the left
    while True:
        for k in range(1, 9):
            way = (back + k) % 8
            to = at[0] + NEAR[way][0], at[1] + NEAR[way][1]
            if padded[to]:
                break
        else:
            return 0.0  # a single pixel
        if (at, way) == first:
            return length
        first = first or (at, way)
        length += 1.0 if way % 2 == 0 else 2**0.5
        at, back = to, (way + 4) % 8


def filled(part: np.ndarray) -> np.ndarray:
    """A part with its holes."""
    outside = components_2d(~np.pad(part, 1), corners=False)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def thin(mask: np.ndarray) -> np.ndarray:
    """A skeleton one pixel wide: border pixels go in turns from two sides while that parts nothing (Zhang and Suen)."""
    img = np.pad(mask.astype(bool), 1)
    while True:
        gone = False
        for turn in (0, 1):
            n = np.stack([np.roll(img, (-dy, -dx), (0, 1)) for dy, dx in NEAR])
            count = n.sum(0)
            rises = (~n & np.roll(n, -1, 0)).sum(0)
            a, b = ((0, 2, 4), (2, 4, 6)) if turn == 0 else ((0, 2, 6), (0, 4, 6))
            drop = img & (count >= 2) & (count <= 6) & (rises == 1) & ~n[list(a)].all(0) & ~n[list(b)].all(0)
            drop[[0, -1]], drop[:, [0, -1]] = False, False
            img &= ~drop
            gone |= bool(drop.any())
        if not gone:
            return img[1:-1, 1:-1]


def _line(mask: np.ndarray, width: int, axis: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by a line of ``width`` pixels, twice."""
    before, after = (width - 1) // 2, width // 2
    for _ in range(2):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, after)
        padded = np.pad(mask, pad, constant_values=not grow)
        cuts = [np.take(padded, np.arange(k, k + mask.shape[axis]), axis) for k in range(width)]
        mask = np.logical_or.reduce(cuts) if grow else np.logical_and.reduce(cuts)
    return mask


def joints_of(mask: np.ndarray, width: int, reach: int = 5) -> np.ndarray:
    """Where horizontal and vertical lines of a grown skeleton cross, grown by ``reach``."""
    skeleton = thin(mask)
    for axis in (0, 1):
        skeleton = _line(skeleton, 3, axis, True)
    crossing = np.ones_like(mask, bool)
    for axis in (0, 1):
        crossing &= _line(_line(skeleton, width, axis, False), width, axis, True)
    for axis in (0, 1):
        crossing = _line(crossing, 2 * reach + 1, axis, True)
    return crossing


def by_plane(mask: DataFrame, plane: str, shape: tuple[int, int], run, columns: str) -> DataFrame:
    """``run`` on each plane (a boolean image from rows (plane, y, x)); it gives (y, x, *values) arrays."""
    kinds = dict(mask.dtypes)
    names = [c.split()[0] for c in columns.split(", ") if c]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros(shape, bool)
        img[pdf["y"], pdf["x"]] = True
        found = dict(zip(["y", "x", *names], run(img), strict=True))
        return pd.DataFrame({plane: pdf[plane].iloc[0], **found})

    return mask.select(plane, "y", "x").distinct().groupBy(plane).applyInPandas(whole, f"{plane} {kinds[plane]}, y int, x int" + (f", {columns}" if columns else ""))


def contours(mask: DataFrame, plane: str, shape: tuple[int, int], least: float) -> DataFrame:
    """(plane, y, x, contour): parts with an outline longer than ``least``, filled and numbered from 1 by their least x.

    Parts touch at corners too; of equal least x the part that begins first comes first. Where filled parts overlap
    (one in a hole of another) the later number holds.
    """

    def run(img: np.ndarray):
        lab = components_2d(img, corners=True)
        kept = [k for k in range(1, lab.max(initial=0) + 1) if outline(lab == k) > least]
        order = sorted(kept, key=lambda k: np.nonzero(lab == k)[1].min())
        out = np.zeros(img.shape, np.int32)
        for i, k in enumerate(order, 1):
            out[filled(lab == k)] = i
        y, x = np.nonzero(out)
        return y.astype(np.int32), x.astype(np.int32), out[y, x]

    return by_plane(mask, plane, shape, run, "contour int")


def skeletons(mask: DataFrame, plane: str, shape: tuple[int, int]) -> DataFrame:
    """(plane, y, x) of each plane's skeleton."""
    return by_plane(mask, plane, shape, lambda img: [c.astype(np.int32) for c in np.nonzero(thin(img))], "")


def joints(mask: DataFrame, plane: str, shape: tuple[int, int], width: int) -> DataFrame:
    """(plane, y, x) where horizontal and vertical lines of each plane's skeleton cross."""
    return by_plane(mask, plane, shape, lambda img: [c.astype(np.int32) for c in np.nonzero(joints_of(img, width))], "")
