"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources in code point order, null last, have weights that repeat; together they share ``share`` of all words.
Water-filling clamps a source at ``epochs`` times its size and gives its excess to the others by weight, again
and again until none is above its limit. Where that ends follows from one pass over the sources in the order in
which they would be clamped, by limit over weight, with sums of the limits before and the weights after each. A
source is then sampled: every document is taken as many whole times as its target holds whole epochs, and for the
fraction left documents are taken in a seeded order until the words are met; the last one is taken in part. The
running sum behind that order is taken first over buckets of the hash, then, within the one bucket of each source
where the target falls, over draws, and at last within the parts of the table over documents of one draw (rows
equal in all that is drawn by): no task gets all documents of a source, nor all copies of one.

Defined cases: a null or empty text has size 0 and is taken 0 times in words (its copies still count as whole
epochs). Null sources are one source; ids may be null. Repeated rows are documents of their own: they share a draw
and are interchangeable. Texts are only counted and hashed, so their length does not matter. Other columns are
ignored, but for those named in ``keep``; of these, ones named like a result are left out. An empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.joins import meet
from voxelith.llm.storage import stored
from voxelith.llm.texts import WORD, kept_columns


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size and more) with the target of each source.

    The table has one row a source, so ordering it as a whole is no ordering of the corpus.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    limit, weight = F.lit(epochs) * F.col("source_size"), F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("limit", limit)
    # in the order of clamping: what the sources before take, and the weight of this and those after
    clamping = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(clamping.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(clamping.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(whole)
    # the level that holds if this source is the first that is not clamped; it holds if its limit is not below
    rows = rows.withColumn("level", (total - before) / after)
    open_ = F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.col("level"))
    level = F.coalesce(F.max(open_).over(whole), F.lit(float("inf")))
    return rows.withColumn("target", F.least("limit", F.col("weight") * level)).drop("weight", "limit", "level")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 11, keep: tuple[str, ...] = (), buckets: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (copies), part (words of one more copy) and taken, with ``keep``."""
    own = ["doc_id", "source", "size", "source_size", "target", "whole", "part", "taken"]
    cols = kept_columns(keep, own)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *cols, n_words(text).alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__text"), F.spark_partition_id().alias("__deal"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), key, F.col("size").cast("string"), "__text")
    draw = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")  # 60 bits
    sized = sized.withColumns({"__key": key, "__draw": draw}).drop("__text")
    light = stored(sized.withColumn("__bucket", F.expr(f"cast(__draw div {(1 << 60) // buckets + 1} as int)")), "sized")
    hist = stored(light.groupBy("__key", "source", "__bucket").agg(F.sum("size").alias("n"), F.count("*").alias("docs")), "bucket-sizes")
    aims = targets(hist.groupBy("__key", "source").agg(F.sum("n").alias("source_size"), F.sum("docs").alias("__docs")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.greatest(F.lit(0), F.floor(F.col("target")) - F.col("whole") * F.col("source_size")).cast("long")
    aims = stored(aims.withColumn("whole", whole).withColumn("__rest", rest).drop("source"), "aims")
    # the bucket of each source in whose words its rest ends, and the words of the buckets before it
    run = Window.partitionBy("__key").orderBy("__bucket")
    before = hist.withColumn("upto", F.sum("n").over(run)).join(aims.select("__key", "__rest"), "__key").where("upto - n < __rest and upto >= __rest")
    edge = before.groupBy("__key").agg(F.min("__bucket").alias("__edge"), F.min_by(F.col("upto") - F.col("n"), "__bucket").alias("__before"))
    aims = aims.join(edge, "__key", "left").withColumns({"__edge": F.coalesce("__edge", F.lit(-1)), "__before": F.coalesce("__before", F.lit(0)).cast("long")})
    rows = meet(light, stored(aims, "targets"), ["__key"], "__docs")
    at_edge = rows.where("__bucket = __edge")
    # in that bucket draws are summed, not documents; documents of one draw are told apart by their part of the table
    same = ["__key", "__draw", "size", "__deal"]
    draws = at_edge.groupBy(*same, "__before").agg((F.sum("size")).alias("n"))
    start = F.col("__before") + F.coalesce(F.sum("n").over(Window.partitionBy("__key").orderBy("__draw", "size", "__deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = draws.select(*same, start.alias("__start"))
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1
    cut = at_edge.withColumn("__rank", rank).join(starts, same).withColumn("__sofar", F.col("__start") + F.col("__rank") * F.col("size"))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__sofar"))).cast("long")).drop("__rank", "__start", "__sofar")
    away = rows.where("__bucket <> __edge").withColumn("part", F.when(F.col("__bucket") < F.col("__edge"), F.col("size")).otherwise(0).cast("long"))
    out = away.unionByName(cut).withColumn("taken", (F.col("size") * F.col("whole") + F.col("part")).cast("long"))
    return out.select("doc_id", "source", *cols, "size", "source_size", "target", "whole", "part", "taken")
