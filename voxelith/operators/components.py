"""Connected components of masks: labels within tiles, merged across their faces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.align import small
from voxelith.operators.voxels import ZYX
from voxelith.sources.scratch import kept


def label_slab(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Component numbers (from 0) of voxels that share faces."""
    ny, nx = int(y.max(initial=0)) + 2, int(x.max(initial=0)) + 2
    key = (z.astype(np.int64) * ny + y) * nx + x
    order = np.argsort(key, kind="stable")
    key = key[order]
    parent = np.arange(len(key))
    a, b = [], []
    for step in (1, nx, ny * nx):
        at = np.searchsorted(key, key + step)
        hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step)
        a.append(np.flatnonzero(hit))
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    while True:  # hooking to the smaller root, then halving paths
        ra, rb = parent[a], parent[b]
        far = ra != rb
        if not far.any():
            break
        np.minimum.at(parent, np.maximum(ra, rb)[far], np.minimum(ra, rb)[far])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    _, number = np.unique(parent, return_inverse=True)
    out = np.empty(len(key), np.int64)
    out[order] = number
    return out


def label_slabs(mask: DataFrame, slab: int, tile: int | None = None) -> DataFrame:
    """(z, y, x, label) with labels unique over slabs of ``slab`` slices: the slab's number above, its own below.

    With ``tile`` a slab is cut into tiles of that many lines and columns, each labelled on its own, so that a group
    holds slab x tile x tile voxels at most whatever the size of a slice; at most 1024 tiles along y and x.
    """
    cell = slab * (tile or 1) ** 2 if tile else None
    if cell and cell >= 1 << 24:
        raise ValueError("a tile holds 2**24 voxels at most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, y, x = (pdf[c].to_numpy() for c in ZYX)
        part = int(z[0]) // slab
        base = part << 40 if tile is None else ((part << 20) + (int(y[0]) // tile << 10) + int(x[0]) // tile) << 24
        return pd.DataFrame({"z": z, "y": y, "x": x, "label": base + label_slab(z - part * slab, y, x) + 1})

    once = mask.select(*ZYX).distinct()
    keys = [F.floor(F.col("z") / slab).alias("__slab")] + [F.floor(F.col(c) / tile).alias(f"__{c}") for c in "yx" if tile]
    return once.groupBy(*keys).applyInPandas(run, "z int, y int, x int, label long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of an edge table (a, b) by alternating stars; root is the least node that can be reached."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a")
        linked = out.where("b > a" if large else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (linked if large else linked.union(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct()

    now, before = kept(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        now = kept(star(star(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def merge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after joining those that ``edges`` (a, b) link; a component is named by its least label."""
    roots = connected(edges)
    return labels.join(small(roots), labels["label"] == roots["node"], "left").withColumn("label", F.coalesce("root", "label")).drop("node", "root")


def label_volume(mask: DataFrame, slab: int = 16, tile: int = 256) -> DataFrame:
    """(z, y, x, label) of a mask's components under face neighbourhood.

    Tiles are labelled on their own, once; only labels that meet on the faces between tiles form the graph that is
    solved. Labels are joined with their roots by tile, so that a component through the whole volume is no hot key.
    """
    local = kept(label_slabs(mask, slab, tile), "labels")
    edges = None
    for axis, n in zip(ZYX, (slab, tile, tile), strict=True):
        low = local.where((F.col(axis) + 1) % n == 0).withColumn(axis, F.col(axis) + 1).withColumnRenamed("label", "a")
        high = local.where(F.col(axis) % n == 0).withColumnRenamed("label", "b")
        pairs = low.join(high, ZYX).select("a", "b")
        edges = pairs if edges is None else edges.union(pairs)
    return merge_labels(local, edges.distinct())


def canonical(labels: DataFrame) -> DataFrame:
    """First voxel in scan order and size of each component."""
    return labels.groupBy("label").agg(F.min(F.struct(*ZYX)).alias("first"), F.count("*").alias("n")).select(F.col("first.z").alias("z"), F.col("first.y").alias("y"), F.col("first.x").alias("x"), "n")


def largest_component(labels: DataFrame) -> DataFrame:
    """The label with most voxels, the least of equals, and its size; background 0 is left out."""
    sizes = labels.where("label <> 0").groupBy("label").agg(F.count("*").alias("n"))
    return sizes.orderBy(F.col("n").desc(), "label").limit(1)


def largest_mask(mask: DataFrame, slab: int = 16) -> DataFrame:
    """The voxels of the largest component; of equals, that which begins first in scan order."""
    labels = label_volume(mask, slab)
    sizes = labels.groupBy("label").agg(F.min(F.struct(*ZYX)).alias("first"), F.count("*").alias("n"))
    return labels.join(sizes.orderBy(F.col("n").desc(), "first").limit(1).select("label"), "label", "left_semi").select(*ZYX)


def chunk_components(voxels: DataFrame) -> DataFrame:
    """Components of chunks labelled on their own: (layout, chunk, z, y, x, local_label) with z within the chunk.

    Chunks of a layout are stacked in z; equal (y, x) of the last and next first layer link their labels. Returns
    (layout, components).
    """
    node = F.concat_ws("|", "layout", F.lpad("chunk", 6, "0"), F.lpad("local_label", 6, "0"))
    rows = voxels.where("local_label <> 0").withColumn("node", node)
    height = voxels.groupBy("layout", "chunk").agg(F.max("z").alias("last"))
    top = rows.join(height, ["layout", "chunk"]).where("z = last").select("layout", (F.col("chunk") + 1).alias("chunk"), "y", "x", F.col("node").alias("a"))
    low = rows.where("z = 0").select("layout", "chunk", "y", "x", F.col("node").alias("b"))
    roots = connected(top.join(low, ["layout", "chunk", "y", "x"]).select("a", "b").distinct())
    nodes = rows.select("layout", "node").distinct().join(roots, "node", "left")
    return nodes.groupBy("layout").agg(F.countDistinct(F.coalesce("root", "node")).alias("components"))


def classify_cells(shapes: DataFrame, volume: tuple[float, float], ratio: float, error: float) -> DataFrame:
    """Components (label, n, a, b, c, outside): cells are of a size, elongated a / c >= ``ratio`` and near their ellipsoid."""
    fits = F.col("outside") / F.col("n") <= error
    return shapes.withColumn("cell", F.col("n").between(*volume) & (F.col("a") / F.nullif(F.col("c"), F.lit(0.0)) >= ratio) & fits)
