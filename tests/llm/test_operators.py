"""Operators and pipeline stages on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.llm import joins, language, licenses, mixing, packing, quality, sharding, simhash, suffixes, tiff, toxicity
from voxelith.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, fp string, slot string, size string, kept string, spans string, label string, bucket string"
LONG = " ".join(f"word{i % 9973} thing{i * 7 % 9967}" for i in range(60_000))
WALL = " ".join(f"passage{i}" for i in range(40))
ENGLISH, FRENCH = "the cat sat on the mat and then the dog ran over the hill " * 3, "le chat est sur la table et le chien est dans le jardin de la ville " * 3


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        (0, ENGLISH, "en", "a"), (1, FRENCH, "fr", "a"), (2, None, "en", "b"), (3, "", None, "b"), (4, "   \n\t ", "en", None),
        (5, LONG, None, "a"), (6, ENGLISH, "en", "a"), (6, ENGLISH, "en", "a"), (7, "12 34 !!", "fr", None), (None, "an orphan text", None, None),
        (None, None, None, None), (8, "Été " * 30, "fr", "a"), (9, f"before {WALL} after one", "en", "c"), (10, f"other {WALL} end two", "en", "c"), (11, FRENCH, "fr", "a"), (12, "x", "en", "zz"),
    ]
    return spark.createDataFrame([(d, t, g, s, None if t is None else len(t), *["clash"] * 9) for d, t, g, s in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_language(docs, empty):
    model = language.train_language_model(docs)
    assert model.languages == ["en", "fr"]
    rows = language.identify_languages(docs, model, keep=("lang",)).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None}
    assert got[0] == got[6] == "en" and got[1] == got[11] == "fr" and {got[2], got[3], got[4], got[7]} == {"und"}
    none = language.train_language_model(empty)
    assert {r.lang_pred for r in language.identify_languages(docs, none).collect()} == {"und"}
    assert language.identify_languages(empty, model).count() == 0


def test_simhash(docs, empty, spark):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 16
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].component_id == by[0].component_id == 0 and by[11].component_id == 1
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16
    assert {by[i].component_id for i in (2, 3, 4)} == {2}
    for d, t in texts_of(docs):
        if d is not None:
            assert int(by[d].fingerprint, 16) == simhash.fingerprint(t)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("kw", [{}, {"bucket": 1, "most": 3}, {"bucket": 1, "most": 1}])
def test_links_by_brute_force(spark, kw):
    rng = np.random.default_rng(4)
    fps = set()
    for b in rng.integers(0, 1 << 62, 25, dtype=np.uint64):
        for _ in range(10):
            x = int(b)
            for k in rng.choice(62, rng.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3 and find(x) != find(y):
                root[max(find(x), find(y))] = min(find(x), find(y))
    want = {x: min(y for y in fps if find(y) == find(x)) for x in fps}
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), **kw)
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got.get(x, x) == want[x] for x in fps)


@pytest.mark.parametrize("bar", [1, 3, 10**9])
def test_shared_keys(spark, monkeypatch, bar):
    monkeypatch.setattr(joins, "hot_bar", lambda total: bar)
    rows = [(k, i) for k, n in ((1, 1), (2, 2), (3, 5), (4, 40), (5, 1)) for i in range(n)]
    got = Counter((r.key, r.v, r.n) for r in joins.shared(spark.createDataFrame(rows, "key long, v long"), "key", "test", buckets=3).collect())
    assert got == Counter((k, i, n) for k, n in ((2, 2), (3, 5), (4, 40)) for i in range(n))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 99)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
    assert components(edges.where("a < 0")).count() == 0


def test_toxicity(docs, empty, spark):
    bad = [(100 + i, f"words number {i} you worthless idiot and moron") for i in range(30)]
    fine = [(200 + i, f"words number {i} of a quiet walk in the garden") for i in range(60)]
    table = spark.createDataFrame(bad + fine, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1) for d, _ in bad] + [(d, 0) for d, _ in fine] + [(None, 1), (999, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(table, labels, bits=14, epochs=60)
    rows = toxicity.score_toxicity(table, model).collect()
    assert all((r.score >= 0.5) == (r.predicted == 1) == (r.doc_id < 200) for r in rows)
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == 16 and all(0 <= r.score <= 1 for r in scored)
    none = toxicity.train_toxicity_model(table, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, model).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, full, total = set(order), {}, share * sum(sizes.values())
    while left:
        level = (total - sum(full.values())) / sum(w[s] for s in left)
        over = {s for s in left if w[s] * level > epochs * sizes[s]}
        if not over:
            break
        full |= {s: epochs * sizes[s] for s in over}
        left -= over
    return full | {s: w[s] * level for s in left}


@pytest.mark.parametrize("buckets", [1, 4, 1024])
def test_mixing(docs, empty, buckets):
    rows = mixing.mix(docs, buckets=buckets).collect()
    assert len(rows) == 16
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) < 1 and all(0 <= r.taken <= 2 * r.size for r in own)
    again = mixing.mix(docs.repartition(3), buckets=buckets).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0


def test_targets_by_clamping_again_and_again(spark):
    rng = np.random.default_rng(2)
    for n, big in ((1, 10), (7, 100), (40, 2**30)):
        sizes = {f"s{i:02}": int(rng.integers(0, big)) if n < 40 else 2 ** (i % 30) for i in range(n)} | {None: int(rng.integers(1, big))}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        for share in (0.3, 1.5, 2.0, 3.0):
            want = plain_targets(sizes, share=share)
            assert all(abs(r.target - want[r.source]) <= 1e-9 * max(1, r.target) for r in mixing.targets(table, share=share).collect())


def test_mixing_against_sql(spark):
    import duckdb

    from voxelith.llm import queries

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op4_mixing(spark, sf)
    want = db.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES['op4_mixing']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_mixing_of_one_row_many_times(spark):
    rows = [(None, "a few words here", "s")] * 500 + [(i, "one two " * (i % 5), "s") for i in range(50)] + [(1, "other source", "t")] * 30
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.mix(table.repartition(k), share=0.9, buckets=4).collect()) for k in (2, 5))
    assert first == again
    want = plain_targets({"s": 2000 + sum(2 * (i % 5) for i in range(50)), "t": 60}, share=0.9)
    for s in "st":
        assert abs(sum(k[3] * n for k, n in first.items() if k[1] == s) - want[s]) < 1


def test_tiff(docs, empty, spark):
    rows = tiff.media_digests(docs).collect()
    assert len(rows) == 16
    want = Counter((d, len(t.encode()), hashlib.sha256(tiff.payload_of(t)).hexdigest(), zlib.crc32(tiff.payload_of(t)[-16:])) for d, t in texts_of(docs))
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert tiff.media_digests(empty).count() == 0
    good = tiff.store(tiff.payload_of(LONG))
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"II*\0nonsense")), (3, None), (1, bytearray(good))], "key int, media binary")
    pages = tiff.tiff_pages(files, key="key", media="media").orderBy("key", "page").collect()
    n = -(-len(tiff.payload_of(LONG)) // (192 * 512))
    assert [r.key for r in pages].count(1) == 2 * n and [r.error is not None for r in pages if r.key == 2] == [True]
    assert b"".join(bytes(r.data) for r in pages[: 2 * n : 2]) == tiff.payload_of(LONG)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(docs, tokenizer=path), least=3, rows=4).collect()
    want = Counter()
    for d, t in texts_of(docs):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            part = np.array(ids[a : a + 1024], "<u4")
            want[d, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    packs = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == packs.get(r.sequence_id, 0)
        packs[r.sequence_id] = r.offset + r.length
    assert sorted(packs) == list(range(len(packs))) and max(packs.values()) <= 1024
    assert packing.pack(packing.pieces(empty, tokenizer=path)).count() == 0


def plain_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4000, 2, 0])
def test_suffix_dedup(docs, empty, group, monkeypatch):
    small = docs.where("doc_id is null or doc_id <> 5")
    rows = texts_of(small)
    want = Counter(zip([d for d, _ in rows], plain_removal([t.encode() for _, t in rows], 200), strict=True))
    if group == 0:  # all keys with two rows are hot
        monkeypatch.setattr(joins, "hot_bar", lambda total: 1)
        monkeypatch.setattr(suffixes, "hot_bar", lambda total: 1)
    got = suffixes.remove_repeats(small, group=group).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert sum(r.n_removed for r in got) > 1000
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("group", [4000, 3, 0])
def test_suffix_dedup_of_runs(spark, group):
    texts = ["a" * 1000, "ab" * 300, "abc" * 200 + "tail", "a" * 150, "é" * 90 + "b" * 40, "é" * 95 + "b" * 40, "q" * 199, "zé" * 120]
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcde"), 5)) for _ in range(30)]
    base = " ".join(rng.choice(words, 400))
    texts += [base, base[:900] + "X" + base[901:], base[100:700], "Y" + base[300:], base[:1500].replace("a", "A", 1)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()}
    assert got == dict(enumerate(plain_removal([t.encode() for t in texts], 200)))


def test_suffix_dedup_of_one_passage_in_many_texts(spark):
    """A common anchor with more distinct segments than a task takes; also a very long text."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"common{i}" for i in range(28))
    texts = [f"{' '.join(map(str, rng.integers(0, 10**6, 30)))} {passage} {' '.join(map(str, rng.integers(0, 10**6, 30)))}" for _ in range(60)]
    texts += [passage[:205], passage[20:], "x" + passage, LONG[:20_000], LONG[9000:12_000] + "end"]
    rows = list(enumerate(texts))
    want = dict(enumerate(plain_removal([t.encode() for t in texts], 200)))
    for group in (4000, 10):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()}
        assert got == want


def test_quality(docs, empty, spark):
    many = [(1000 + i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(1500)] + [(5000 + i, " ".join(f"$$$&&&w{i}y{j}" for j in range(30)), "en") for i in range(100)]
    table = spark.createDataFrame(many, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 5000)) for d, _, _ in many] + [(None, 1), (1000, 1)], "doc_id long, quality int")
    rows = quality.quality_rules(table, labels).collect()
    assert len(rows) == 1600 and all(r.kept == (r.doc_id < 5000) for r in rows)
    assert {r.rejected_by for r in rows} == {None, "symbols"}
    judged = quality.quality_rules(docs, labels).collect()
    assert len(judged) == 16 and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in judged)
    assert quality.quality_rules(empty, labels).count() == 0


def test_few_labels_decide_where_they_suffice(spark):
    """300 good texts or so in a stratum; copies of one text count once."""
    many = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(400)] + [(5000 + i, " ".join(f"$$$&&&w{i}y{j}" for j in range(30)), "en") for i in range(40)]
    many += [(9000 + i, " ".join(f"same{j}" for j in range(30)), "fr") for i in range(2000)] + [(20_000, " ".join(f"$$$&&&v{j}" for j in range(30)), "fr"), (None, " ".join(f"v{j}" for j in range(30)), None)]
    table = spark.createDataFrame(many, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(d, int(d < 5000 or 9000 <= d < 20_000)) for d, _, _ in many if d is not None], "doc_id long, quality int")
    rows = quality.quality_rules(table, labels, stratum="n_words").collect()
    assert len(rows) == len(many) and all(r.kept == (r.stratum != "en" or r.doc_id < 5000) for r in rows)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "STRATA", 1)
        with pytest.raises(ValueError):
            quality.quality_rules(table, labels, stratum="n_words").collect()


def test_kept_columns_named_like_results_are_left_out(docs, spark):
    model = language.train_language_model(docs)
    assert language.identify_languages(docs, model, keep=("score", "lang", "lang")).columns == ["doc_id", "lang", "lang_pred", "score"]
    some = toxicity.ToxicityModel(np.zeros(16), 0.0, 4, 2)
    assert toxicity.score_toxicity(docs, some, keep=("score", "key")).columns == ["doc_id", "key", "score", "predicted"]
    out = simhash.near_duplicates(docs, keep=("fp", "key", "lang"))
    assert out.columns == ["doc_id", "key", "lang", "fingerprint", "component_id"] and out.count() == 16
    out = suffixes.remove_repeats(docs.withColumn("uid", F.lit("x")).withColumn("spans", F.lit("x")), keep=("uid", "spans", "text", "n_bytes"))
    assert out.columns == ["doc_id", "uid", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and out.count() == 16
    assert mixing.mix(docs, keep=("size", "bucket", "key")).columns[:4] == ["doc_id", "source", "bucket", "key"]


def test_licenses(docs, empty, spark):
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == 16 and {r.labels for r in rows} == {""} and {r.score for r in rows} == {0.0}
    one = spark.createDataFrame([(1, "Released under the MIT License. Released under the MIT license")], "doc_id long, text string")
    (r,) = licenses.scan_licenses(one).collect()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (2, 3, 8, "mit", "mit,mit-notice")
    assert licenses.scan_licenses(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs, shards=3, slots=64).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts_of(docs))
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(empty).count() == 0


def test_template_matches_by_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(60):
        alphabet = list("abc")
        templates = {f"t{k}": " ".join(rng.choice(alphabet, rng.integers(3, 12))) for k in range(4)}
        text = " ".join(rng.choice([*alphabet, "z"], 40, p=[0.3, 0.3, 0.3, 0.1]))
        a, words = licenses.build(templates, {"a b": "x"}), licenses.words_of(text)
        got = licenses.template_matches(words, a, 3)
        for t, body in enumerate(templates.values()):
            own, want = licenses.words_of(body), set()
            longest = [max((n for n in range(1, i + 2) if any(own[e - n + 1 : e + 1] == words[i - n + 1 : i + 1] for e in range(n - 1, len(own)))), default=0) for i in range(len(words))]
            for i, n in enumerate(longest):
                if n >= 3 and (i + 1 == len(words) or longest[i + 1] != n + 1):
                    want |= {(i - n + 1, e - n + 1, n) for e in range(n - 1, len(own)) if own[e - n + 1 : e + 1] == words[i - n + 1 : i + 1]}
            assert set(got.get(t, [])) == want


def test_every_copy_of_a_notice_and_notices_within_others():
    a = licenses.build(licenses.TEMPLATES, licenses.PHRASES)
    body, other = licenses.TEMPLATES["apache"], licenses.TEMPLATES["isc"]
    r = licenses.scan(f"intro {body} middle words {other} and again {body} end", a)
    spans = sorted((n, x, y) for n, _, x, y in r["spans"])
    n, m = len(licenses.words_of(body)), len(licenses.words_of(other))
    assert [s for s in spans if s[0] == "apache"] == [("apache", 1, n), ("apache", n + m + 5, 2 * n + m + 4)]
    assert sum(s[0] == "apache-2.0" for s in spans) == 2 and r["labels"] == "apache,apache-2.0,isc"
    many = licenses.scan(" ".join([body] * 300), a)
    assert sum(s[0] == "apache" for s in many["spans"]) == 300


@pytest.mark.parametrize("parts", [1, 7])
def test_shards_of_null_and_repeated_ids_are_even(spark, parts):
    rows = [(None if i % 2 else i % 5, f"text {i % 3}" if i % 4 else f"other {i}") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sharding.assign_shards(table, shards=24, slots=2048).collect()
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    assert len(got) == 6000 and max(held.values()) - min(held.values()) <= 0.01 * sum(held.values()) / 24
    again = sharding.assign_shards(table.repartition(3), shards=24, slots=2048).collect()
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.shard)
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_slot_map_is_read_back_and_edited(docs, spark, tmp_path):
    path = f"file://{tmp_path}/map"
    table = spark.createDataFrame([(i, "words " * (1 + i % 7)) for i in range(4000)], "doc_id long, text string")
    first = {r.doc_id: r for r in sharding.assign_shards(table, shards=24, slots=1024, path=path).collect()}
    again = {r.doc_id: r for r in sharding.assign_shards(table, shards=24, slots=1024, path=path).collect()}
    assert {r.map_version for r in first.values()} == {r.map_version for r in again.values()} == {1}
    assert all(first[i].shard == again[i].shard for i in first)
    grown = {r.doc_id: r for r in sharding.assign_shards(table, shards=25, slots=1024, path=path).collect()}
    moved = [i for i in first if first[i].shard != grown[i].shard]
    assert {r.map_version for r in grown.values()} == {2} and all(first[i].virtual_slot == grown[i].virtual_slot for i in first)
    assert 0 < len(moved) < 2 * len(first) / 25  # few slots move, most of them to the new shard
    fewer = sharding.assign_shards(table, shards=20, slots=1024, path=path).collect()
    assert {r.shard for r in fewer} == set(range(20)) and {r.map_version for r in fewer} == {3}
    with pytest.raises(ValueError):
        sharding.assign_shards(table, shards=24, slots=512, path=path)


def test_pipeline(docs, empty, spark, tmp_path):
    import corpus_pipeline

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs, empty):
        now = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, "")
            out.write.mode("overwrite").parquet(f"{tmp_path}/{table is docs}-{i}")
            now = spark.read.parquet(f"{tmp_path}/{table is docs}-{i}")
            if i < 4:
                assert now.columns == cols
                assert now.where("n_chars <> length(text)").count() == 0
            if table is docs and i == 1:
                ids = [r.doc_id for r in now.collect()]
                assert ids.count(6) == 0 and 0 in ids and 1 in ids and 11 not in ids and None in ids
        assert (now.count() > 0) == (table is docs)
    path = tmp_path / "documents.parquet"
    docs.select(*cols).write.parquet(str(path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
