"""Near copies with scattered edits: the stage's classes against all pairs by exact Jaccard similarity."""

import itertools

import numpy as np
import pytest

from voxelith.llm import copies


def jaccard(s, t):
    a, b = (set(copies.shingles(copies.folded(x)).tolist()) for x in (s, t))
    return len(a & b) / len(a | b)


def edited(words, places):
    return " ".join("edit" if i in places else w for i, w in enumerate(words))


def corpus(groups, size):
    rng, texts = np.random.default_rng(3), []
    for g in range(groups):
        words = [f"w{g}x{rng.integers(1000)}" for _ in range(200)]
        texts += [" ".join(words)] + [edited(words, set(rng.choice(200, k, replace=False).tolist())) for k in rng.integers(1, 6, size - 1)]
    return texts


def test_stage_drops_copies_with_scattered_edits(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words), edited(words, {20, 80, 140, 200, 260}), edited(words, set(range(0, 300, 12)))]
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


@pytest.mark.parametrize("small,block", [(32, 2048), (2, 2048), (2, 7)])
def test_classes_by_brute_force(spark, small, block):
    texts = corpus(3, 24)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.root for r in copies.near_copies(docs, small=small, block=block).collect()}
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    want = {frozenset(i for i in found if root[i] == r) for r in root}
    assert {frozenset(i for i in found if found[i] == r) for r in found.values()} == want


def test_rows_without_ids_are_copies_too(spark, monkeypatch):
    import corpus_pipeline
    from voxelith.llm import joins

    monkeypatch.setattr(joins, "hot_bar", lambda total: 2)
    words = [f"word{i}" for i in range(100)]
    one, near, other = " ".join(words), edited(words, {50}), "another text of its own"
    rows = [(None, one, "en", "a"), (None, one, "en", "b"), (7, near, "en", "a"), (9, one, "fr", "a"), (None, other, "en", "a"), (None, other, "en", "a"), (None, None, None, None), (None, "", "en", "a")]
    docs = spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert len(got) == 3 and (7, near) in got and (None, other) in got


def test_links_come_from_fingerprints(spark, monkeypatch):
    import corpus_pipeline
    from voxelith.llm import simhash

    monkeypatch.setattr(copies, "band_keys", lambda found: [int(np.bitwise_xor.reduce(found) >> np.uint64(1))] if len(found) else [])  # no two texts share one
    words = [f"word{i}" for i in range(900)]
    texts = [" ".join(words), edited(words, {300}), " ".join(f"other{i}" for i in range(900)), None, ""]
    a, b = (simhash.fingerprint(t) for t in texts[:2])
    assert 0 < (a ^ b).bit_count() <= 3
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]


@pytest.mark.parametrize("small,block", [(32, 2048), (2, 7)])
def test_fingerprint_classes_are_checked_by_similarity(spark, monkeypatch, small, block):
    monkeypatch.setattr(copies, "band_keys", lambda found: [])
    monkeypatch.setattr(copies, "fingerprint", lambda text: 5)  # one class of all texts with words
    texts = [*corpus(3, 8), None, "  ", "one", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.root for r in copies.near_copies(docs, small=small, block=block).collect()}
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (i, j) == (24, 25) or (j < 24 and jaccard(texts[i], texts[j]) >= 0.8):
            root = [root[i] if r == root[j] else r for r in root]
    want = {frozenset(i for i in found if root[i] == r) for r in root}
    assert {frozenset(i for i in found if found[i] == r) for r in found.values()} == want
