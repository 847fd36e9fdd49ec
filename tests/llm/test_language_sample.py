"""The language fit's sample: copies of one text."""

import numpy as np

from voxelith.llm import language


def test_no_language_is_left_out_of_the_fit(spark):
    texts = [f"{w} lorem {w} ipsum {w}" for w in ("alpha", "beta", "gamma", "delta", "omega")]
    rows = [(i * 1000 + j, t, f"l{i}") for i, t in enumerate(texts) for j in range(200)]
    model = language.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=10)
    flat = [k for j, k in enumerate(model.languages) if np.ptp(model.log_prob[:, j]) == 0]
    assert model.languages == ["l0", "l1", "l2", "l3", "l4"] and not flat
    assert language.predict(texts, model)[0] == model.languages


def test_copies_count_as_their_share(spark):
    rows = [(j, "aaaa" if j < 300 else "bbbb", "en") for j in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some, every = language.train_language_model(docs, rows_per_language=40), language.train_language_model(docs)
    ratio = lambda m: np.ptp(np.sort(m.log_prob[:, 0])[-6:])
    assert abs(ratio(some) - ratio(every)) < 0.1
