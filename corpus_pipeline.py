"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.copies import near_copies, row_key
from voxelith.llm.joins import meet
from voxelith.llm.language import identify_languages, train_language_model
from voxelith.llm.mixing import mix
from voxelith.llm.packing import pack, pieces
from voxelith.llm.storage import drop_since, mark, stored
from voxelith.llm.suffixes import remove_repeats
from voxelith.llm.texts import WORD, documents, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one that is unlikely, go."""
    small_batches(spark)
    found = identify_languages(docs, train_language_model(docs), keep=COLUMNS)
    return found.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts linked by 0.8 or more of their five-word shingles stays.

    Texts in one SimHash class, or with a MinHash key in common, are compared; see ``copies``. The row is that with the smallest id (ids before null), of equal ids that with the smallest digest; of rows equal in
    id and text one stays, that with the smallest other columns.
    """
    small_batches(spark)
    classes = near_copies(docs)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")
    first = stored(classes.groupBy("root").agg(F.min_by("key", order).alias("key"), F.min_by("n", order).alias("n")).select("key", "n"), "first-rows")
    rest = [c for c in COLUMNS if c != "doc_id"]
    chosen = meet(docs.select(*COLUMNS).withColumn("key", row_key("doc_id", "text")), first, ["key"], "n")
    once = chosen.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.min(F.struct(*rest)).alias("r"))
    return once.select("doc_id", *[f"r.{c}" for c in rest])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and documents of which no word is left with them."""
    small_batches(spark)
    kept = remove_repeats(docs, keep=("lang", "source"), digest=False).withColumnRenamed("kept", "text")
    left = kept.where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(WORD)))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; of a copy taken in part, its first words."""
    mixed = mix(docs, keep=("text", "lang"))
    copies = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    times = mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    part = (F.col("copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int"))
    out = times.withColumn("text", F.when(part, F.array_join(words, " ")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens."""
    import public_tokenizers

    small_batches(spark)
    return pack(pieces(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), table_bytes=50_000_000, keep_table=False))


STAGES = [("language ID", language_id), ("near-duplicates", near_dedup), ("repeated passages", suffix_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again; what a stage read and stored for itself goes afterwards."""
    docs, point = documents(spark, sf_dir), mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(spark, point, keep=1)
    return docs
