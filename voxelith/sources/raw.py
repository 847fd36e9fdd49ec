"""Raw, npy and EDF volumes, scan metadata, configurations, and the partitioned voxel store."""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Shape = tuple[int, int, int]
#: Data types of EDF headers.
EDF_TYPES = {"UnsignedShort": "<u2", "FloatValue": "<f4", "Float": "<f4"}
#: Tags of scan descriptions.
XML_TAGS = ("subvolume_name", "sizex", "sizey", "sizez", "originx", "originy", "originz", "voxelsize", "valmin", "valmax", "byte_order", "s1", "s2", "S1", "S2")
EDF_HEADER = 1024
VOXELS = "z int, y int, x int, v double"
#: Larger files are read in ranges of whole slices, of about so many bytes.
RANGE = 256 << 20


def _open(path: str):
    """(file system, path on it) of a path as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}")


def _voxels(a: np.ndarray, first: int) -> pd.DataFrame:
    """The non-zero voxels of consecutive slices."""
    z, y, x = np.nonzero(a)
    return pd.DataFrame({"z": (z + first).astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": a[z, y, x].astype(float)})


def _raw(spark: SparkSession, path: str, shape: Shape, kind: str, offset: int | None) -> DataFrame:
    """Voxels of flat files: small ones come as Spark reads them, larger ones in ranges of slices, one a row."""
    _, ny, nx = shape
    size = ny * nx * np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").load(path)

    def start(name: str) -> int:
        return offset if offset is not None else int(re.search(r"(\d+)\.[^/]*$", name)[1])

    def whole(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                a = np.frombuffer(data, kind).reshape(-1, ny, nx)
                for k in range(0, len(a), max(1, (16 << 20) // size)):
                    yield _voxels(a[k : k + max(1, (16 << 20) // size)], start(name) + k)

    def ranges(batches):
        for pdf in batches:
            for name, at, length in zip(pdf["path"], pdf["at"], pdf["length"], strict=True):
                system, where = _open(name)
                with system.open_input_file(where) as f:
                    data = f.read_at(min(step, length - at), at)
                yield _voxels(np.frombuffer(data, kind).reshape(-1, ny, nx), start(name) + at // size)

    step = max(1, RANGE // size) * size
    small = files.where(F.col("length") <= RANGE).select("path", "content").mapInPandas(whole, VOXELS)
    large = files.where(F.col("length") > RANGE).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    return small.unionByName(large.repartition("path", "at").mapInPandas(ranges, VOXELS))


def raw_volume(spark: SparkSession, path: str, shape: Shape, kind: str = "<u2", offset: int = 0) -> DataFrame:
    """(z, y, x, v) of the non-zero values of flat files whose first slice is ``offset``; C order."""
    return _raw(spark, path, shape, kind, offset)


def raw_slabs(spark: SparkSession, path: str, shape: Shape, kind: str = "<u2") -> DataFrame:
    """The same for files named by their first slice (a number before the extension)."""
    return _raw(spark, path, shape, kind, None)


def _write_slabs(vol: DataFrame, path: str, shape: Shape, slab: int, kind: str, name: str, encode) -> DataFrame:
    """One file a slab, or a slice where ``slab`` is 1; (path, slices) of what was written. A task that runs again writes the same file again."""
    nz, ny, nx = shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["z"].iloc[0]) // slab * slab
        a = np.zeros((min(slab, nz - first), ny, nx), kind)
        some = pdf["v"].notna()
        a[pdf["z"][some] - first, pdf["y"][some], pdf["x"][some]] = pdf["v"][some]
        system, where = _open(f"{path}/{name.format(first)}")
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(where) as f:
            f.write(encode(a))
        return pd.DataFrame({"path": [f"{path}/{name.format(first)}"], "slices": [len(a)]})

    every = vol.sparkSession.range(nz).select(F.col("id").cast("int").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(None).cast("double").alias("v"))
    inside = F.col("z").between(0, nz - 1) & F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)
    rows = vol.where(inside).select("z", "y", "x", F.col("v").cast("double").alias("v")).unionByName(every)
    return rows.groupBy(F.expr(f"z div {slab}").alias("__slab")).applyInPandas(run, "path string, slices int")


def write_raw_slabs(vol: DataFrame, path: str, shape: Shape, slab: int = 32, kind: str = "<u2") -> int:
    """Store a volume as flat files named by their first slice; the number of slices written."""
    return _write_slabs(vol, path, shape, slab, kind, "slab_{:06d}.raw", lambda a: a.tobytes()).agg(F.sum("slices")).first()[0] or 0


def _npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def _npz(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, data=a)
    return out.getvalue()


def write_npy_slabs(vol: DataFrame, path: str, shape: Shape, slab: int = 32, kind: str = "<u2", packed: bool = False) -> int:
    """Store a volume as npy files, or compressed npz ones, named by their first slice."""
    return _write_slabs(vol, path, shape, slab, kind, "slab_{:06d}.npz" if packed else "slab_{:06d}.npy", _npz if packed else _npy).agg(F.sum("slices")).first()[0] or 0


def npy_slabs(spark: SparkSession, path: str) -> DataFrame:
    """(z, y, x, v) of npy and npz files of three axes, named by their first slice."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                found = np.load(io.BytesIO(data), allow_pickle=False)
                yield _voxels(found if isinstance(found, np.ndarray) else found[found.files[0]], int(re.search(r"(\d+)\.[^/]*$", name)[1]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, VOXELS)


def write_edf_frames(vol: DataFrame, path: str, shape: Shape, stem: str = "scan_") -> int:
    """Store a volume as EDF files of 16-bit values, one a slice."""
    head = f"{{\nByteOrder = LowByteFirst ;\nDataType = UnsignedShort ;\nDim_1 = {shape[2]} ;\nDim_2 = {shape[1]} ;\n}}\n".encode("latin-1").ljust(EDF_HEADER)
    return _write_slabs(vol, path, shape, 1, "<u2", stem + "{:04d}.edf", lambda a: head + a.tobytes()).agg(F.sum("slices")).first()[0] or 0


def write_slices(vol: DataFrame, path: str, slab: int = 32) -> None:
    """Store voxels by slab; slabs written again replace those there, others stay, and gaps read as zero."""
    rows = vol.withColumn("zslab", F.expr(f"cast(z div {slab} as int)"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("zslab").parquet(path)


def append_slices(vol: DataFrame, path: str, slab: int = 32) -> None:
    vol.withColumn("zslab", F.expr(f"cast(z div {slab} as int)")).write.mode("append").partitionBy("zslab").parquet(path)


def load_slices(spark: SparkSession, path: str, z: tuple[int, int], slab: int = 32, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """Voxels of slices z[0] to z[1] - 1, and of a sub-box: whole slabs are pruned, the rest is a pushed filter."""
    rows = spark.read.parquet(path).where(F.col("zslab").between(z[0] // slab, (z[1] - 1) // slab) & (F.col("z") >= z[0]) & (F.col("z") < z[1]))
    for c, r in (("y", y), ("x", x)):
        rows = rows if r is None else rows.where((F.col(c) >= r[0]) & (F.col(c) < r[1]))
    return rows.drop("zslab")


def with_halo(vol: DataFrame, slab: int, halo: int) -> DataFrame:
    """Each voxel once for every slab whose slices, with ``halo`` more on both sides, hold it."""
    lo, hi = F.expr(f"cast(greatest(0, z - {halo}) div {slab} as int)"), F.expr(f"cast((z + {halo}) div {slab} as int)")
    return vol.withColumn("slab", F.explode(F.sequence(lo, hi)))


def edf_header(data: bytes) -> dict[str, str]:
    """Keys and values of an EDF header, which ends with the first closing brace, in blocks of 1024 bytes or more."""
    text = data[: max(EDF_HEADER, data.find(b"}"))].decode("latin-1")
    meta = {m[1].strip(): m[2].strip() for m in re.finditer(r"([^={};\n]+)=([^;\n]*)", text)}
    if meta.get("ByteOrder", "LowByteFirst") != "LowByteFirst":
        raise ValueError("only LowByteFirst is read")
    return meta


def edf_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta) of EDF files."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, EDF_HEADER).alias("head"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "meta": [edf_header(bytes(h)) for h in pdf["head"]]})

    return rows.mapInPandas(run, "path string, meta map<string,string>")


def slice_number(path: str) -> Column:
    """The digits that end a file's name."""
    return F.regexp_extract(path, r"(\d+)\.[^/.]*$", 1).cast("int")


def edf_frames(spark: SparkSession, path: str, z: tuple[int, int] | None = None) -> DataFrame:
    """(z, y, x, v) of EDF files, one slice each, numbered by the digits that end their names; zeros are absent.

    With ``z`` only files of slices z[0] to z[1] - 1 are opened.
    """

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                meta = edf_header(bytes(data[: 1 << 16]))
                ny, nx = int(meta["Dim_2"]), int(meta["Dim_1"])
                kind = EDF_TYPES[meta["DataType"]]
                a = np.frombuffer(data, kind, ny * nx, len(data) - ny * nx * np.dtype(kind).itemsize).reshape(1, ny, nx)
                yield _voxels(a, int(re.search(r"(\d+)\.[^/.]*$", name)[1]))

    files = spark.read.format("binaryFile").load(path)
    if z is not None:
        names = files.select("path").where(slice_number("path").between(z[0], z[1] - 1)).collect()  # one name a slice of the range
        if not names:
            return spark.createDataFrame([], VOXELS)
        files = spark.read.format("binaryFile").load([r["path"] for r in names])
    return files.select("path", "content").mapInPandas(run, VOXELS)


def edf_slice(spark: SparkSession, template: str, n: int) -> DataFrame:
    """One slice of a scan by the template of its files' names, such as ``scan_{:04d}.edf``."""
    return edf_frames(spark, template.format(n))


def edf_region(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """A box [low, high) of (x, y, z) out of EDF slices; only files of its slices are opened."""
    rows = edf_frames(spark, path, (low[2], high[2]))
    for c, a, b in zip("xyz", low, high, strict=True):
        rows = rows.where((F.col(c) >= a) & (F.col(c) < b))
    return rows


def scan_description(spark: SparkSession, path: str, tags: tuple[str, ...] = XML_TAGS) -> DataFrame:
    """(path, meta) of scan descriptions in XML: the text of each known tag that is there, whatever its case.

    ``experiment`` is the name of the subvolume without its numbered ending, and ``subvolume_name`` a template for
    the names of its slices; ``filename`` and ``dirname`` are those of the description.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pairs = [x for t in tags for x in (F.lit(t), F.nullif(F.regexp_extract("value", rf"(?is)<{t}>\s*(.*?)\s*</{t}>", 1), F.lit("")))]
    name = F.col("meta")["subvolume_name"]
    more = F.create_map(
        F.lit("experiment"), F.replace(name, F.lit("_%04d.edf"), F.lit("")), F.lit("subvolume_name"), F.replace(name, F.lit("%04d"), F.lit("{:04d}")),
        F.lit("filename"), F.col("path"), F.lit("dirname"), F.regexp_replace("path", r"/[^/]*$", ""),
    )
    found = text.select("path", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("meta"))
    known = F.map_filter(more, lambda k, v: v.isNotNull())
    return found.select("path", F.map_concat(F.map_filter("meta", lambda k, v: k != "subvolume_name"), known).alias("meta"))


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    """Store a configuration as one JSON text."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def text_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def save_table(df: DataFrame, path: str, **parts) -> None:
    """Store a small table (probabilities, ranges, a frame of reference) under fixed partition values; only these are replaced."""
    rows = df.withColumns({k: F.lit(v) for k, v in parts.items()})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def load_table(spark: SparkSession, path: str, **parts) -> DataFrame:
    rows = spark.read.parquet(path)
    for k, v in parts.items():
        rows = rows.where(F.col(k) == v)
    return rows.drop(*parts)
