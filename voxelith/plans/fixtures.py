"""Volumes derived from the test tables, and the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vox(spark: SparkSession, d: str) -> DataFrame:
    """Dense volume of 20 x 64 slices from ``embeddings``."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = F.floor((F.least(F.greatest(F.col("e").cast("double"), F.lit(-0.5)), F.lit(0.5)) + 0.5) * 65534).cast("int") + 1
    return e.select(F.expr("cast(vec_id div 20 as int)").alias("z"), F.expr("cast(vec_id % 20 as int)").alias("y"), "x", v.alias("v"))


def lines(spark: SparkSession, d: str) -> int:
    """Lines (z, y) of ``vox``: its last slice may hold fewer than the others."""
    return spark.read.parquet(f"{d}/embeddings.parquet").agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]


def shape(spark: SparkSession, d: str) -> tuple[int, int, int]:
    """Shape of the complete slices of ``vox``."""
    return lines(spark, d) // 20, 20, 64


def extent(spark: SparkSession, d: str) -> tuple[int, int, int]:
    """Shape that holds all rows of ``vox``, those of an incomplete last slice too."""
    return -(-lines(spark, d) // 20), 20, 64


def svox(spark: SparkSession, d: str) -> DataFrame:
    """Sparse volume in a 128^3 box from ``lineitem``."""
    keys = "cast(l_orderkey % 128 as int) z", "cast(l_partkey % 128 as int) y", "cast((l_suppkey * 31 + l_linenumber) % 128 as int) x"
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*keys, "l_extendedprice p")
    return rows.groupBy("z", "y", "x").agg((F.expr("cast(max(floor(p)) % 65535 as int)") + 1).alias("v"))


def field2(spark: SparkSession, d: str) -> DataFrame:
    """Coarse field at scale 2 of ``vox``; an odd last slice is dropped."""
    nz = extent(spark, d)[0] // 2
    v = vox(spark, d).where(F.col("z") < 2 * nz)
    return v.groupBy(*[F.expr(f"cast({c} div 2 as int)").alias(c) for c in "zyx"]).agg(F.expr("cast(sum(v) div 8 as int)").alias("f"))


def prob(spark: SparkSession) -> DataFrame:
    m, f, b = spark.range(2).toDF("m"), spark.range(16).toDF("f"), spark.range(32).toDF("b")
    rows = m.join(f).join(b)
    p = ((F.col("m") * 7 + F.col("f") * 3 + F.col("b") * 5) % 101).cast("double") / 100.0
    return rows.select(*[F.col(k).cast("int").alias(n) for k, n in (("m", "material"), ("f", "field_bin"), ("b", "voxel_bin"))], p.alias("p"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("label") + 1).cast("long").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    return e.select(F.expr("cast(vec_id div 20 as int)").alias("z"), F.expr("cast(vec_id % 20 as int)").alias("y"), "x", "label")


def box(vol: DataFrame) -> DataFrame:
    """The sub-box that brute-force oracles can afford; the operator itself is not bounded."""
    return vol.where("z < 8 and y < 8 and x < 16")


SHAPE_BOX = (8, 8, 16)

VOX = """vox AS (SELECT CAST(vec_id // 20 AS INT) z, CAST(vec_id % 20 AS INT) y, CAST(x - 1 AS INT) x,
 CAST(floor((least(greatest(CAST(e AS DOUBLE), CAST(-0.5 AS DOUBLE)), CAST(0.5 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) * 65534) AS INT) + 1 v
 FROM (SELECT vec_id, unnest(embedding) e, generate_subscripts(embedding, 1) x FROM embeddings))"""
SVOX = """svox AS (SELECT CAST(l_orderkey % 128 AS INT) z, CAST(l_partkey % 128 AS INT) y, CAST((l_suppkey * 31 + l_linenumber) % 128 AS INT) x,
 CAST(max(floor(l_extendedprice)) % 65535 AS INT) + 1 v FROM lineitem GROUP BY 1, 2, 3)"""
DIM = "dim AS (SELECT CAST((max(vec_id) + 1) // 20 AS INT) nz FROM embeddings)"
EXT = "ext AS (SELECT CAST((max(vec_id) + 20) // 20 AS INT) nz FROM embeddings)"
FIELD2 = """field2 AS (SELECT CAST(z // 2 AS INT) z, CAST(y // 2 AS INT) y, CAST(x // 2 AS INT) x, CAST(sum(v) // 8 AS INT) f
 FROM vox WHERE z // 2 < (SELECT (max(z) + 1) // 2 FROM vox) GROUP BY 1, 2, 3)"""
PROB = """prob AS (SELECT CAST(m.id AS INT) material, CAST(f.id AS INT) field_bin, CAST(b.id AS INT) voxel_bin,
 CAST((m.id * 7 + f.id * 3 + b.id * 5) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) p
 FROM range(2) m(id), range(16) f(id), range(32) b(id))"""
LABELS = """lab AS (SELECT CAST(vec_id // 20 AS INT) z, CAST(vec_id % 20 AS INT) y, CAST(x AS INT) x, CAST(label + 1 AS BIGINT) label
 FROM embeddings, range(64) r(x))"""
BOX = "box AS (SELECT * FROM vox WHERE z < 8 AND y < 8 AND x < 16)"
