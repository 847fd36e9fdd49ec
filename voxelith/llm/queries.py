"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.texts import documents, held_out, small_batches


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows that are not held out. No documents, no rows; no labels, all `und`."""
    from voxelith.llm.language import identify_languages, train_language_model

    docs = documents(spark, sf_dir)
    model = train_language_model(docs.where(~held_out()))
    return identify_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document under links at three bits or fewer."""
    from voxelith.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that are not held out. Without both classes all scores are 0."""
    from voxelith.llm.toxicity import score_toxicity, train_toxicity_model

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = train_toxicity_model(docs, labels)
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    from voxelith.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "whole", "part")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as a TIFF and read back."""
    from voxelith.llm.tiff import media_digests

    return media_digests(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    import public_tokenizers

    from voxelith.llm.packing import pack, pieces

    docs = documents(spark, sf_dir)
    small_batches(spark, 4000, 8 << 20)  # fewer words are looked up again in larger batches, and no other stage needs the memory
    return pack(pieces(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes covered by repeated strings of 200."""
    from voxelith.llm.suffixes import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document, with cutoffs by language from all labels."""
    from voxelith.llm.quality import quality_rules

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents(spark, sf_dir), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "stratum")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of every document."""
    from voxelith.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document under the law `bytes`."""
    from voxelith.llm.sharding import assign_shards

    shards = assign_shards(documents(spark, sf_dir))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_toxicity, op4_mixing, op5_tiff, op6_packing, op7_suffix_dedup, op8_quality, op9_licenses, op10_sharding)}

ORACLES: dict[str, str] = {
    "op4_mixing": r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size, text FROM documents),
d2 AS (SELECT doc_id, source, size, CAST('0x' || substr(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce('s' || source, 'null') || '|' || CAST(size AS VARCHAR) || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) draw FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST(2 AS DOUBLE) * source_size lim, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) weight FROM s),
c AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(lim, weight * coalesce(max(CASE WHEN weight * level <= lim THEN level END) OVER (), CAST('inf' AS DOUBLE))) target FROM c),
a AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END whole FROM t),
r AS (SELECT d2.doc_id, d2.size, a.source_size, a.target, a.whole, greatest(0, CAST(floor(a.target) AS BIGINT) - a.whole * a.source_size) rest,
 coalesce(sum(d2.size) OVER (PARTITION BY d2.source ORDER BY d2.draw, d2.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) sofar FROM d2 JOIN a ON d2.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, whole, CAST(greatest(0, least(size, rest - sofar)) AS BIGINT) AS part, CAST(size * whole + greatest(0, least(size, rest - sofar)) AS BIGINT) AS taken FROM r""",
}
