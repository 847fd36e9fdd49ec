"""Queries that write a table's volume in a format and read it back with the format's reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelith.plans import fixtures as fx
from voxelith.plans.registry import Registry
from voxelith.sources import raw, scratch

REGISTRY = query = Registry()
ZYX = ["z", "y", "x"]
WHOLE = "SELECT z, y, x, v FROM vox"


def whole(rows):
    return rows.select(*ZYX, F.col("v").cast("int").alias("v"))


@query("vox", WHOLE)
def s3_raw_round_trip(spark, d):
    """Flat files by slab, written by the tasks and read by their names."""
    path, n = scratch.fresh(spark, "raw"), fx.extent(spark, d)
    raw.write_raw_slabs(fx.vox(spark, d), path, n, 16)
    return whole(raw.raw_slabs(spark, f"{path}/*.raw", n))


@query("vox", WHOLE)
def s22_npy_round_trip(spark, d):
    path, n = scratch.fresh(spark, "npy"), fx.extent(spark, d)
    raw.write_npy_slabs(fx.vox(spark, d), path, n, 16)
    return whole(raw.npy_slabs(spark, f"{path}/*.npy"))


@query("vox", WHOLE)
def s22_npz_round_trip(spark, d):
    path, n = scratch.fresh(spark, "npz"), fx.extent(spark, d)
    raw.write_npy_slabs(fx.vox(spark, d), path, n, 16, packed=True)
    return whole(raw.npy_slabs(spark, f"{path}/*.npz"))


def _edf(spark, d) -> str:
    path = scratch.fresh(spark, "edf")
    raw.write_edf_frames(fx.vox(spark, d), path, fx.extent(spark, d))
    return path


@query("vox", WHOLE)
def s8_edf_frames(spark, d):
    return whole(raw.edf_frames(spark, f"{_edf(spark, d)}/*.edf"))


@query("vox", "SELECT z, y, x, v FROM vox WHERE z = 7")
def s9_edf_slice(spark, d):
    """One slice by the template of the files' names."""
    return whole(raw.edf_slice(spark, f"{_edf(spark, d)}/scan_{{:04d}}.edf", 7))


@query("vox", "SELECT z, y, x, v FROM vox WHERE x >= 3 AND x < 40 AND y >= 2 AND y < 11 AND z >= 4 AND z < 19")
def s10_edf_region(spark, d):
    """A box; the feature is to open its slices' files alone."""
    return whole(raw.edf_region(spark, f"{_edf(spark, d)}/*.edf", (3, 2, 4), (40, 11, 19)))


@query("ext", "WITH s AS (SELECT CAST(id AS INT) z FROM ext, range(nz) r(id)) SELECT z, 'LowByteFirst' AS byte_order, 'UnsignedShort' AS kind, 64 AS dim_1, 20 AS dim_2 FROM s")
def s7_edf_metadata(spark, d):
    meta = raw.edf_metadata(spark, f"{_edf(spark, d)}/*.edf")
    return meta.select(raw.slice_number("path").alias("z"), F.col("meta")["ByteOrder"].alias("byte_order"), F.col("meta")["DataType"].alias("kind"), *[F.col("meta")[f"Dim_{k}"].cast("int").alias(f"dim_{k}") for k in (1, 2)])


@query("", "SELECT r_name AS experiment, r_name || '_{:04d}.edf' AS subvolume_name, CAST(100 + r_regionkey AS INT) AS sizex, CAST(5 AS DOUBLE) AS voxelsize FROM region")
def s11_scan_description(spark, d):
    """A description for each row of a table, in XML."""
    path = scratch.fresh(spark, "scans")
    tags = F.concat(F.lit("<scan><SUBVOLUME_NAME>"), "r_name", F.lit("_%04d.edf</SUBVOLUME_NAME><sizex>"), (F.col("r_regionkey") + 100).cast("string"), F.lit("</sizex><voxelSize>5.0</voxelSize></scan>"))
    spark.read.parquet(f"{d}/region.parquet").select(tags.alias("value"), "r_regionkey").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    meta = F.col("meta")
    return raw.scan_description(spark, f"{path}/*/*.txt").select(meta["experiment"].alias("experiment"), meta["subvolume_name"].alias("subvolume_name"), meta["sizex"].cast("int").alias("sizex"), meta["voxelsize"].cast("double").alias("voxelsize"))


@query("", "SELECT n_name AS line FROM nation")
def s12_text_list(spark, d):
    path = scratch.fresh(spark, "list")
    spark.read.parquet(f"{d}/nation.parquet").select("n_name").write.text(path)
    return raw.text_list(spark, path)


@query("prob", "SELECT field_bin, voxel_bin, p FROM prob WHERE material = 1")
def s23_probability_table(spark, d):
    """Tables of two materials under one path; that of the second is read."""
    path, p = scratch.fresh(spark, "tables"), fx.prob(spark)
    for m in (0, 1):
        raw.save_table(p.where(F.col("material") == m).drop("material"), path, method="otsu", material=m)
    return raw.load_table(spark, path, method="otsu", material=1).select("field_bin", "voxel_bin", "p")


@query("", "SELECT 'close kernel x' AS key, 3 AS value UNION ALL SELECT 'min contour size', 1500")
def s26_configuration(spark, d):
    path = scratch.fresh(spark, "config")
    raw.save_config(spark, {"close kernel x": 3, "min contour size": 1500}, path)
    return spark.createDataFrame(sorted(raw.load_config(spark, path).items()), "key string, value int")
