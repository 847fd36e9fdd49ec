"""Histograms kept up to date while slabs of a volume arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelith.functions.scalar import value_bin
from voxelith.operators.voxels import value_range

SCHEMA = "z int, y int, x int, v int"


def slabs(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def axis_counts(stream: DataFrame, lo: float, hi: float, bins: int, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(axis, row, bin, n): state is one count for each row and bin of the histograms, however many voxels pass."""
    kept = value_range(stream, lo, hi).withColumn("bin", value_bin(F.col("v"), lo, hi, bins))
    each = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("row")) for a in axes])
    return kept.select(F.explode(each).alias("k"), "bin").groupBy("k.axis", "k.row", "bin").agg(F.count("*").alias("n"))


def to_memory(counts: DataFrame, name: str) -> StreamingQuery:
    """Complete results after each trigger, in a table of that name."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).start()


def on_arrival(stream: DataFrame, step, checkpoint: str) -> StreamingQuery:
    """Run ``step(batch, number)`` on each batch of new files; a file is taken once."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
