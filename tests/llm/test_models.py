"""Trained operators: against plain twins, on held-out rows, and cutoffs by simulation."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.llm import language, quality, toxicity
from voxelith.llm.texts import held_out

SF = "/root/testdata/sf0.1"
M = (1 << 32) - 1
TEXTS = ["The cat sat.", "Le chat est là.", "the the the", "été à la mer", "", None, "123", "ÄÖ x", "a", "chat cat " * 50]


def plain_bucket(gram, bits):
    """The hash of one n-gram, symbol by symbol."""
    h = (gram[0] * 0x85EBCA6B + len(gram)) & M
    for c in gram[1:]:
        h ^= h >> 15
        h = (h * 0x2C1B3C6D + c) & M
    h ^= h >> 16
    return ((h * 0x9E3779B1) & M) >> (32 - bits)


def grams(codes, orders):
    return [codes[i : i + n] for n in orders for i in range(len(codes) - n + 1)]


def test_naive_bayes_by_brute_force(spark):
    bits = 10
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("a dog", "en"), ("le chat et le chien", "fr"), ("un été", "fr"), ("el perro", "es"), (None, "es"), ("no label", None)])]
    model = language.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=bits)
    counts, prior = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        if t and lang:
            prior[lang] += 1
            counts[lang].update(plain_bucket(g, bits) for g in grams([ord(c) for c in t.lower()], (1, 2, 3)))
    assert model.languages == sorted(prior)
    names, scores = language.predict(TEXTS, model)
    for t, name, score in zip(TEXTS, names, scores, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (name, score) == ("und", 0)
            continue
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.1 * 2**bits
            logs[lang] = math.log(prior[lang] / sum(prior.values())) + sum(math.log((c[plain_bucket(g, bits)] + 0.1) / total) for g in grams([ord(x) for x in t.lower()], (1, 2, 3)))
        best = max(sorted(logs), key=logs.get)
        assert name == best and score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-9)


def test_toxicity_scores_by_brute_force():
    bits = 10
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(0, 1, 1 << bits), -0.3, bits, 2)

    def word_logit(w):
        mark = b"<" + w + b">"
        rows = [plain_bucket(g, bits) for g in grams(list(mark), (3, 4, 5))] + [zlib.crc32(mark) >> (32 - bits)]
        return sum(model.logit[r] for r in rows) / len(rows)

    for t, p in zip(TEXTS, toxicity.predict(TEXTS, model), strict=True):
        z = [word_logit(w) for w in toxicity.words_of(t)]
        worst = max((sum(z[i : i + 2]) / len(z[i : i + 2]) for i in range(0, len(z), 2)), default=0.0)
        assert p == pytest.approx(1 / (1 + math.exp(-worst - model.bias)))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_held_out_rows(spark):
    from voxelith.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 1000 and right >= 0.97 * n
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = queries.op3_toxicity(spark, SF).join(labels, "doc_id").where(held_out()).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("p"))
    by = {r.toxic: r.p / r.n for r in judged.collect()}
    assert by[1] >= 0.9 and by[0] <= 0.03


def test_at_most_is_the_binomial_sum():
    for n, p in ((1, 0.5), (7, 0.03), (40, 0.2), (300, 0.03)):
        total = 0.0
        for k in range(n + 1):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert quality.at_most(k, n, p) == pytest.approx(total, abs=1e-9)
    assert quality.at_most(29_000_000, 10**9, 0.03) < 1e-9 < 0.4 < quality.at_most(30_000_000, 10**9, 0.03) < 0.6


def test_false_rejection_stays_under_the_risk():
    """Good texts whose rates are drawn at random: how often the chosen step rejects more than the risk allows."""
    rng, risk, level, n = np.random.default_rng(9), 0.03, 0.05, 400
    truth = {rule: np.sort(rng.uniform(0, 0.05, len(grid))) for rule, (_, grid) in quality.RULES.items()}
    over, chosen, runs = 0, 0, 600
    for _ in range(runs):
        halves = []
        for _ in range(2):
            u = rng.uniform(0, 1, (n, len(truth)))  # a text fails a rule's cutoff if its draw is below the cutoff's true rate
            halves.append({rule: u[:, j, None] < truth[rule] for j, rule in enumerate(truth)})
        steps = quality.path({rule: hit.sum(0).tolist() for rule, hit in halves[0].items()}, n)
        at = lambda rule, c: quality.RULES[rule][1].index(c)
        k = [int(np.any([halves[1][rule][:, at(rule, c)] for rule, c in s.items()], axis=0).sum()) for s in steps]
        last = quality.certified(k, n, risk, level)
        if last is not None:
            chosen += 1
            true = 1 - np.prod([1 - truth[rule][at(rule, c)] for rule, c in steps[last].items()])
            over += true > risk
    assert chosen > runs / 2 and over <= level * runs
