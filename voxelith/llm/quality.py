"""Quality rules whose cutoffs are controlled for risk on labelled holdouts.

Each rule rejects a document when a rate measured on its whole text exceeds a cutoff. Cutoffs are chosen for each
stratum (such as a language) from labelled texts, in two halves dealt by a hash of the text. The first half lays a
path: steps from mild to strict, at each of which every rule has the strictest cutoff that rejects no more than the
step's share of good texts there. The second half tests the steps in that order: a step is certified when the exact
binomial test says, at the corrected level, that the rules together reject at most ``risk`` of the stratum's good
texts. The test stops at the first step that fails (fixed sequence), which needs no correction; the level is
divided by the number of strata (Bonferroni). So, with probability 1 - ``level`` at least, no stratum loses more
than ``risk`` of its good texts to the rules. At the default figures 300 good texts or so in a stratum suffice;
with fewer the rules stay off there.

Trials are distinct texts, copies count once; a text is good if none of its labelled rows is marked bad. Near
copies count as texts of their own, so where most labelled texts are near copies the bound is weaker than stated.

Labels are counted over all rows, by aggregation; only counts by stratum, rule and cutoff reach the driver, and
more than ``STRATA`` strata are an error.

Defined cases: a null or empty text has no words and fails the base test. Null strata are one stratum; strata
without labels have no cutoffs, nor has any if there are no labels. Repeated rows are judged alike; rows without an
id have no label. Texts are read whole, very long ones too. Other columns are ignored, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.joins import meet
from voxelith.llm.storage import stored
from voxelith.llm.texts import kept_columns, release

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
UPPER = bytes(range(65, 91))
NOT_COUNTED = bytes([32, *range(9, 14), *range(128, 192)])  # white space, and bytes that continue a code point
WINDOW = 5

#: Rate of each rule and its cutoffs, the mildest first.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)),
    "length": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    "marks": ("n_marks / greatest(word_chars, 1)", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "capitals": ("n_upper / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
}
#: Shares of good texts that the steps of a path let a rule reject.
SHARES = (0.0, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02, 0.03)
#: More strata than this are an error: their cutoffs are kept on the driver and sent to all tasks.
STRATA = 1000
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for k in range(1, WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    maybe = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])].tolist()
    seen = Counter(tuple(words[i : i + WINDOW]) for i in maybe)  # hashes only propose
    starts = np.array([i for i in maybe if seen[tuple(words[i : i + WINDOW])] > 1], np.int64)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """FEATURES of a whole text."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    less = [len(data) - len(data.translate(None, x)) for x in (SYMBOLS, MARKS, UPPER)]
    return len(words), len(data.translate(None, NOT_COUNTED)), less[0], len(lines) - len(set(lines)), repeat_words(words), len(lines), less[1], less[2]


def measured(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and FEATURES of each row; columns to keep that are named like a feature are left out."""
    cols = kept_columns(keep, ["doc_id", *FEATURES])
    source = docs.select(F.col(doc_id).alias("doc_id"), *cols, F.col(text).alias("__text"))

    def run(batches):
        release()
        for pdf in batches:
            rows = pd.DataFrame(list(map(measure, pdf.pop("__text"))), columns=list(FEATURES), index=pdf.index, dtype=np.int64)
            yield pd.concat([pdf, rows], axis=1)

    kinds = dict(source.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ["doc_id", *cols]] + [f"{c} long" for c in FEATURES])
    return source.mapInPandas(run, schema)


def at_most(k: int, n: int, p: float) -> float:
    """Probability of k or fewer successes in n trials; terms are summed from the largest down, until they vanish."""
    if k >= n:
        return 1.0
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
    if k > n * p:
        return 1.0 - sum(_upper(k, n, p, term))
    total = term
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, total)


def _upper(k: int, n: int, p: float, term: float):
    for i in range(k + 1, n + 1):
        term *= (n - i + 1) * p / (i * (1 - p))
        yield term
        if term < 1e-17:
            break


def certified(rejected: list[int], n: int, risk: float, level: float) -> int | None:
    """The last step, from the first, up to which all have a rate of at most ``risk`` by the exact test."""
    best = None
    for i, k in enumerate(rejected):
        if not n or k > n * risk or at_most(k, n, risk) > level:
            break
        best = i
    return best


def path(rejected: dict[str, list[int]], n: int) -> list[dict[str, float]]:
    """Steps of cutoffs, from mild to strict, from each rule's rejections of n good texts at each cutoff."""
    steps = []
    for share in SHARES:
        own = {}
        for rule, (_, grid) in RULES.items():
            fine = [c for c, k in zip(grid, rejected[rule], strict=True) if k <= share * n]
            if fine:
                own[rule] = fine[-1]
        if own and own not in steps:
            steps.append(own)
    return steps


def cutoffs(features: DataFrame, labels: DataFrame, *, risk: float = 0.03, level: float = 0.05, seed: int = 5) -> dict:
    """{stratum: {rule: cutoff}} from labels (doc_id, quality), 1 for good; all labelled rows count.

    ``features`` has the stratum and a digest of the text as ``__stratum`` and ``__digest``.
    """
    spark = features.sparkSession
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {rule: [F.expr(f"cast({rate} > {c}D as long)") for c in grid] for rule, (rate, grid) in RULES.items()}
    rates = [F.expr(rate).alias(f"rate_{rule}") for rule, (rate, _) in RULES.items()]
    over = [F.sum(c).alias(f"{rule}_{i}") for rule, grid in counts.items() for i, c in enumerate(grid)]
    texts = features.where(f"not ({BASE})").groupBy("__stratum", "__digest", "doc_id").agg(*[F.first(c).alias(c) for c in FEATURES])
    found = stored(marks.join(texts.groupBy("doc_id").agg(F.count("*").alias("times")), "doc_id"), "marks")
    marked = meet(texts, found, ["doc_id"], "times").groupBy("__stratum", "__digest").agg(F.min("quality").alias("quality"), *[F.first(c).alias(c) for c in FEATURES])
    good = stored(marked.where("quality = 1").withColumn("half", F.pmod(F.xxhash64(F.lit(seed), "__digest"), F.lit(2))), "good-texts")
    if good.select("__stratum").distinct().limit(STRATA + 1).count() > STRATA:
        raise ValueError(f"more than {STRATA} strata")
    first = good.where("half = 0").groupBy("__stratum").agg(F.count("*").alias("n"), *over).collect()
    steps = {r["__stratum"]: path({rule: [r[f"{rule}_{i}"] for i in range(len(grid))] for rule, (_, grid) in RULES.items()}, r["n"]) for r in first}
    rows = [(s, i, *(own.get(r) for r in RULES)) for s, found_ in steps.items() for i, own in enumerate(found_)]
    if not rows:
        return {}
    kind = dict(features.dtypes)["__stratum"]
    table = spark.createDataFrame(rows, f"__s {kind}, step int, " + ", ".join(f"__{r} double" for r in RULES))
    any_ = F.coalesce(F.greatest(*[F.col(f"rate_{r}") > F.col(f"__{r}") for r in RULES]), F.lit(False))
    # at most STRATA times as many rows as there are steps
    tried = good.where("half = 1").select("__stratum", *rates).join(F.broadcast(table), F.col("__stratum").eqNullSafe(F.col("__s")))
    second = tried.groupBy("__s", "step").agg(F.count("*").alias("n"), F.sum(any_.cast("long")).alias("k")).collect()
    tests = {(r["__s"], r["step"]): r for r in second}
    out = {}
    for s, found_ in steps.items():
        own = [tests[s, i] for i in range(len(found_)) if (s, i) in tests]
        last = certified([r["k"] for r in own], own[0]["n"] if own else 0, risk, level / len(steps))
        if last is not None:
            out[s] = found_[last]
    return out


def judge(features: DataFrame, cuts: dict) -> DataFrame:
    """doc_id, stratum and FEATURES with base_failed, rejected_by (a rule or null) and kept."""
    spark = features.sparkSession
    kind = dict(features.dtypes)["__stratum"]
    rows = [(s, *(own.get(r) for r in RULES)) for s, own in cuts.items()]
    table = spark.createDataFrame(rows, f"__s {kind}, " + ", ".join(f"__{r} double" for r in RULES))
    joined = features.join(F.broadcast(table), F.col("__stratum").eqNullSafe(F.col("__s")), "left")  # at most STRATA rows
    by = F.coalesce(*[F.when(F.expr(f"{rate} > __{rule}"), F.lit(rule)) for rule, (rate, _) in RULES.items()])
    out = joined.withColumn("base_failed", F.expr(BASE)).withColumn("rejected_by", by)
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
    return out.select("doc_id", F.col("__stratum").alias("stratum"), *FEATURES, "base_failed", "rejected_by", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.03, level: float = 0.05) -> DataFrame:
    """Features and verdicts of all documents, with cutoffs from ``labels``."""
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).alias("__stratum"), digest.alias("__digest"))
    features = stored(measured(source, keep=("__stratum", "__digest")), "features")
    return judge(features, cutoffs(features, labels, risk=risk, level=level))
