"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters of labelled texts into 2**bits buckets per language; the
matrix of log-probabilities (buckets x languages, at most ``LANGUAGES``, so a size that does not depend on the
corpus) is broadcast, and texts are scored in numpy: each text is a sparse row of buckets, and its score a sum over
the matrix's rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if no row had a
label. Texts are read whole, long ones in blocks. Repeated rows get equal answers; ties go to the language that
comes first. Other columns are ignored, but for those named in ``keep``; of these, ones named like a result are
left out. An empty table gives an empty one, or a model without languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.texts import hashed_ngrams, kept_columns, release, slices, unit_hash

LETTER = regex.compile(r"\p{L}")
ORDERS = (1, 2, 3)
BLOCK = 1 << 19
#: More languages than this are an error: the matrix has a column for each.
LANGUAGES = 256


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # (2**bits, languages)
    log_prior: np.ndarray
    bits: int


def _blocks(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams; at most BLOCK characters at a time, overlapping by two."""
    for a, b in slices(map(len, texts), BLOCK):
        part = [t.lower() for t in texts[a:b]]
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(a, b, dtype=np.int32), [len(t) for t in part])
        for at in range(0, len(codes), BLOCK):
            for n in ORDERS:
                end = min(len(codes), at + BLOCK + n - 1)
                yield from hashed_ngrams(codes[at:end], owner[at:end], (n,), bits)


def train_language_model(labelled: DataFrame, *, text: str = "text", lang: str = "lang", bits: int = 15, rows_per_language: int = 4000, seed: int = 7) -> LanguageModel:
    """Learn from rows with a language and a text.

    ``rows_per_language`` bounds the sample of each language that is counted; it is the only bound. A text of c rows
    counts as c times the share sampled, rounded up or down by a hash of the text: copies neither leave the sample nor
    enter it together, and no language with a text is left out.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    copies = rows.groupBy("lang", "h").agg(F.count("*").alias("c"))
    sizes = {r["lang"]: r["n"] for r in copies.groupBy("lang").agg(F.sum("c").alias("n")).limit(LANGUAGES + 1).collect()}
    names = sorted(sizes)
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not names:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros(0), bits)
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, rows_per_language / sizes[k])))])
    weight = F.least("c", F.floor(F.col("c") * share[F.col("lang")] + unit_hash(F.col("h"), seed=seed)))
    chosen = copies.withColumn("w", weight).where("w > 0").drop("c")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"), F.first("w").alias("w")).select("lang", "text", "w")

    def count(batches):
        release()
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("lang"):
                acc, w = total.setdefault(name, np.zeros(1 << bits, np.int64)), part["w"].to_numpy(float)
                for owner, bucket in _blocks(list(part["text"]), bits):
                    acc += np.bincount(bucket, w[owner], 1 << bits).astype(np.int64)
        for name, acc in total.items():
            used = np.flatnonzero(acc)
            yield pd.DataFrame({"lang": name, "bucket": used.astype(np.int32), "n": acc[used]})

    counts = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((1 << bits, len(names)))
    matrix[counts["bucket"], counts["lang"].map(names.index).astype(int)] = counts["n"]
    log_prob = np.log(matrix + 0.1) - np.log(matrix.sum(0) + 0.1 * len(matrix))
    prior = np.array([sizes[k] for k in names], float)
    return LanguageModel(names, log_prob, np.log(prior / prior.sum()), bits)


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Languages and posterior probabilities of whole texts."""
    k = len(model.languages)
    spoken = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
    if not k or not spoken.any():
        return ["und"] * len(texts), np.zeros(len(texts))
    used = np.flatnonzero(spoken)
    total = np.tile(model.log_prior, (len(used), 1))
    for owner, bucket in _blocks([texts[i] for i in used], model.bits):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for j in range(k):
            total[owner[starts], j] += np.add.reduceat(model.log_prob[:, j].take(bucket), starts)
    best = total.argmax(1)
    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    names[used], score[used] = np.array(model.languages, object)[best], posterior
    return list(names), score


def identify_languages(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, lang_pred and score, with the columns named in ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = [doc_id, *kept_columns(keep, [doc_id, "lang_pred", "score"])]
    source = docs.select(*cols, F.col(text).alias("__text"))

    def score(batches):
        release()
        for pdf in batches:
            names, posterior = predict(list(pdf.pop("__text")), sent.value)
            yield pdf.assign(lang_pred=names, score=posterior)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols)
    return source.mapInPandas(score, f"{schema}, lang_pred string, score double")
