"""The numpy and Python kernels against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelith.llm import language, licenses, packing, quality, sharding, simhash, suffixes, tiff, toxicity

TEXTS = st.text(st.sampled_from("ab \n\té#A!"), max_size=60)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


# simhash ------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_blocks():
    text = " ".join(str(i % 97) for i in range(1000))
    assert simhash.fingerprint(text, block=64) == plain_fingerprint(text)


def test_golay_code_is_perfect():
    every = np.arange(1 << 23)
    found = np.bincount(simhash.golay_index(every), minlength=4096)
    assert (found == 2048).all()


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 22, 500)
    y = x ^ (1 << rng.integers(0, 22, 500))
    a, b = simhash.golay_keys(x, 22), simhash.golay_keys(y, 22)
    assert set(np.count_nonzero(a >= 0, axis=1)) <= {1, 2, 3, 4, 5, 6}
    for p, q in zip(a, b, strict=True):
        assert {*p[p >= 0]} & {*q[q >= 0]}


def test_keys_meet_at_three_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(400):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (ra, ka), (rb, kb) = simhash.keys(x), simhash.keys(y)
    for i in range(400):
        assert {*ka[ra == i].tolist()} & {*kb[rb == i].tolist()}


def test_ball():
    word, far = simhash.ball(np.array([5], np.uint64))
    assert word.shape == (1, 1 + 64 + 2016) and len({*word[0].tolist()}) == word.size
    assert (np.bitwise_count(word[0] ^ np.uint64(5)) == far).all()


@settings(deadline=None)
@given(st.lists(st.integers(0, 255), unique=True, max_size=40))
def test_forest(values):
    fps = np.array([v | v << 40 for v in values], np.uint64)
    a, b = simhash.forest(fps)
    group = {int(x): {int(x)} for x in fps}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 3 and group[x] is not group[y]
        both = group[x] | group[y]
        for z in both:
            group[z] = both
    assert all(group[int(x)] is group[int(y)] for x in fps for y in fps if (int(x) ^ int(y)).bit_count() <= 3)


# suffixes -----------------------------------------------------------------------------------------------------


def plain_starts(strings, length):
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    return [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 6), st.sampled_from([1, 10, 40, 1000]))
def test_merge_finds_repeats(strings, length, shard):
    assert [x.tolist() for x in suffixes.repeated_starts(strings, length, shard)] == plain_starts(strings, length)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=5))
def test_shard_bwt(strings):
    symbols, lf, order = suffixes.shard_bwt(strings)
    text, at = [], 0
    for k, s in enumerate(strings):
        for i in range(len(s) + 1):
            text.append((tuple((1, b) for b in s[i:]) + ((0, k),), at + i, s[i - 1] + 1 if i else 0))
        at += len(s) + 1
    text.sort()
    assert order.tolist() == [x[1] for x in text] and symbols.tolist() == [x[2] for x in text]
    inner = np.flatnonzero(symbols)
    assert (order[lf[inner]] == order[inner] - 1).all()


def test_lcp_of_a_merge():
    strings = [b"banana", b"bandana"]
    shards = [suffixes.shard_bwt([s])[:2] for s in strings]
    lcp = []
    rows, interval = suffixes.merge_intervals(shards, 3, lcp=lcp)
    assert len(rows) == 5 and len(set(interval.tolist())) == 2  # "ana" three times, "ban" twice
    assert [d for d, _ in lcp] == [1, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400).map(lambda b: bytes(97 + x % 2 for x in b)))
def test_segments_hold_each_string_once(data):
    length, gram = 20, 6
    h, _, first, n = suffixes.segments(data, length, gram)
    starts = [i for a, k in zip(first, n, strict=True) for i in range(a, a + k)]
    assert starts == list(range(max(0, len(data) - length + 1)))
    at = {}
    for x, a, k in zip(h, first, n, strict=True):
        for i in range(a, a + k):
            assert at.setdefault(data[i : i + length], x) == x  # equal strings, equal anchors


def test_segments_in_blocks(monkeypatch):
    data = np.random.default_rng(3).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    whole = suffixes.segments(data)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    cut = suffixes.segments(data)
    assert {*whole[0].tolist()} == {*cut[0].tolist()} and whole[3].sum() == cut[3].sum() == 4801


# tiff ---------------------------------------------------------------------------------------------------------


@settings(deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(kind, order):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 40, s).astype(np.uint8) for s in ((1, 192), (130, 192), (64, 50))]
    for differ in (1, 2):
        for side in (0, 64):
            data = tiff.encode(images, [kind] * 3, predictor=[differ] * 3, tile=[side] * 3, order=order)
            assert [(p[:, :, 0] == q).all() for (_, p), q in zip(tiff.pages(data), images, strict=True)] == [True] * 3


def test_lzw_full_table():
    data = np.random.default_rng(6).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_known_bytes():
    # the example of the TIFF 6.0 specification: 7 7 7 8 8 7 7 6 6
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.unpack_lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == data


@pytest.mark.parametrize("text", [None, "", "a", "é" * 96, "x" * 192, "ab" * 100_000])
def test_media_row(text):
    row = tiff.media_row(text)
    data = (text or "").encode()
    payload = tiff.payload_of(text)
    assert row[0] == len(data) and row[1] == len(payload) and row[1] % 192 == 0 and row[1] > 0
    assert payload.startswith(data) and not payload[len(data) :].strip(b" ")
    assert row[3] == zlib.crc32(payload[-16:])


def test_damaged_tiff():
    data = tiff.store(tiff.payload_of("some text"))
    for cut in (1, 7, 9, 40, len(data) - 60):
        with pytest.raises(ValueError):
            list(tiff.pages(data[:cut]))


# packing ------------------------------------------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns(histogram):
    used = Counter()
    for lengths, n in packing.patterns(histogram, 64):
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            used[x] += n
    assert used == Counter(histogram)


def test_piece_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = packing.PieceIds(tok, limit=5000, slice_chars=100)
    rng = np.random.default_rng(8)
    parts = ["the", " ", " ", "  ", "\n", "\n", "\t", "\u00c9t\u00e9", "don't", "'ll", "123", "!?", "\u00a0", " ", "<|endoftext|>", "\x1c", "a" * 80, "\x85", "\u6f22\u5b57", "\u0120", "\u010a"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), k % 23)) for k in range(600)]
    texts += [" ".join(parts[i].strip() or "x" for i in rng.integers(0, len(parts), 9)) for _ in range(100)]
    for text, ids in zip(texts, table.many(texts), strict=True):
        assert ids == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


# quality ------------------------------------------------------------------------------------------------------


def plain_measure(text):
    w = [x.decode() for x in words(text)]
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@settings(deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\x0b", " "]), max_size=80).map(" ".join))
def test_measure(text):
    assert quality.measure(text)[:5] == plain_measure(text)


def test_exact_bound():
    assert abs(quality.at_most(0, 100, 0.03) - 0.97**100) < 1e-12
    assert quality.certified([0, 1, 30], 2000, 0.005, 0.01) == 1
    assert quality.certified([0], 50, 0.005, 0.01) is None
    assert quality.certified([], 0, 0.005, 0.01) is None


# licenses -----------------------------------------------------------------------------------------------------


def test_phrases_by_brute_force():
    a = licenses.build(licenses.TEMPLATES, licenses.PHRASES)
    rng = np.random.default_rng(9)
    vocab = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "the", "é", "GNU", "x1"]
    for k in range(300):
        text = " ".join(vocab[i] for i in rng.integers(0, len(vocab), k % 40))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = licenses.scan(text, a)
        assert r["n_words"] == len(w) and r["n_base"] == len(places)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_statistics_by_brute_force():
    a = licenses.build({"t": "a b c a b d", "u": "b c b c a"}, {"c a": "x"})
    texts = [licenses.words_of(t) for t in ("a b c a b d", "b c b c a", "c a")]
    held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = np.random.default_rng(10)
    for _ in range(200):
        w = [b"abcdz"[i : i + 1] for i in rng.integers(0, 5, 30)]
        want = {i: max((n for n in range(1, i + 2) if tuple(w[i - n + 1 : i + 1]) in held), default=0) for i in range(30)}
        assert {i: n for i, n, _ in licenses.statistics(w, a)} == {i: n for i, n in want.items() if n > 1}


def test_template_in_text():
    a = licenses.build(licenses.TEMPLATES, licenses.PHRASES)
    text = "intro words " + licenses.TEMPLATES["mit"].replace("furnished", "given") + " and more"
    r = licenses.scan(text, a)
    assert r["labels"] == "mit" and r["base_labels"] == "" and r["score"] > 0.9
    assert licenses.scan("a plain text about the software and the public", a)["labels"] == ""
    assert licenses.scan(None, a)["score"] == 0


# sharding, language, toxicity ----------------------------------------------------------------------------------


def test_rebalance():
    rng = np.random.default_rng(11)
    sizes = rng.integers(1, 1000, 2000).tolist()
    now = sharding.rebalance([i % 24 for i in range(2000)], sizes, 24)
    held = np.bincount(now, sizes, 24)
    assert held.max() - held.min() <= 10
    assert sharding.rebalance([], [], 3) == []


def test_language_blocks(monkeypatch):
    texts = ["abc", "", "hé llo wörld", "x" * 50]
    whole = np.concatenate([b for _, b in language._blocks(texts, 12)])
    monkeypatch.setattr(language, "BLOCK", 7)
    assert sorted(np.concatenate([b for _, b in language._blocks(texts, 12)])) == sorted(whole)
    assert len(whole) == sum(max(0, len(t) - n + 1) for t in texts for n in (1, 2, 3))


def test_toxicity_learns_misspellings():
    rng = np.random.default_rng(12)
    syllables = ["ka", "lo", "mi", "re", "tu", "so"]
    clean = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(40)) for _ in range(200)]
    bad = [t + " you worthless idiot" for t in clean[:100]]
    model = toxicity.fit(bad + clean[100:], np.array([1] * 100 + [0] * 100), bits=14, dim=4, passage=8, epochs=80, seed=1)
    p = toxicity.predict(["kalomi worthles idi0t", "kalomi tusore relomi", "", None], model)
    assert p[0] > 0.5 > p[1] and p[2] == p[3]
