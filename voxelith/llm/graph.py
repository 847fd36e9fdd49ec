"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.joins import meet
from voxelith.llm.storage import drop_since, mark, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the others and itself) to its smallest neighbour.

    A node that most others are linked to meets them through a broadcast of such nodes; see ``joins``.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
    out = meet(both, least, ["a"], "n")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (columns a and b); root is the smallest node that can be reached.

    Every round is a fixed number of shuffles whose map sides combine; rounds grow with the logarithm of the
    longest path. Each round's edges are written to the shared folder, and those of the round before deleted. An
    empty table gives an empty one.
    """
    spark = edges.sparkSession
    point = mark()
    now, before = stored(edges.where("a <> b").distinct(), "edges"), None
    while True:
        now = stored(_star(stored(_star(now, True), "half"), False), "edges")
        drop_since(spark, point, keep=1)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct().toDF("node", "root"))
