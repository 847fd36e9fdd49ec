"""Near-duplicate classes of SimHash fingerprints by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, words of the binary Golay code of length 23.
That code is perfect: each word lies within three bits of exactly one codeword, whose twelve data bits are its
index. The keys of a segment are the indices of the word and of its one-bit neighbours, one or six in all; two
segments at distance one or less always share a key. Three differing bits over three segments leave either one
segment equal and another within one bit (keys: the equal segment with the other's indices), or one bit in each
(keys: the indices of the first two with an equal half of the third). Keys carry about 35 bits, so buckets stay
small whatever the corpus.

Buckets of up to ``bucket`` distinct fingerprints compare their pairs. Those of up to ``most`` are searched
breadth first, each fingerprint against those not reached yet, and give only the links of a spanning forest.
Fingerprints in a larger bucket, which one task should not hold, meet in another exact way whose rows grow
linearly: each emits all words within two bits of it; at a word that one of them reaches within one bit, all that
reach it are linked to that one, as 1 + 2 <= 3, and every pair within three bits meets so. Links are verified and
joined into components of distinct fingerprints; copies of a text share one fingerprint and never multiply.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other.
Fewer words than a shingle form one shingle. Repeated rows fall into one class. Rows without an id join classes,
whose id is the smallest id that is not null. Texts are read whole, very long ones in blocks of shingles. Other
columns are ignored, but for those named in ``keep``; of these, ones named like a result are left out. An empty
table gives an empty one.

Of near copies, those within three differing bits are found, all of them; edits that change more bits are beyond
this distance (of the near copies planted in the check tool's tables, about half are within it).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.graph import components
from voxelith.llm.joins import meet, shared
from voxelith.llm.storage import stored
from voxelith.llm.texts import kept_columns, release

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str | None, width: int = 3, block: int = 1 << 16) -> int:
    """SimHash of a whole text over word shingles, as unsigned 64 bits."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, block):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + block], ends[at : at + block], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and fp of each row; fp is the fingerprint's bits as a signed long."""
    cols = kept_columns(keep, ["doc_id", "fp"])
    source = docs.select(F.col(doc_id).alias("doc_id"), *cols, F.col(text).alias("__text"))

    def run(batches):
        release()
        for pdf in batches:
            fps = np.array([fingerprint(t, width) for t in pdf.pop("__text")], np.uint64)
            yield pdf.assign(fp=fps.view(np.int64))

    kinds = dict(source.dtypes)
    return source.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *cols]) + ", fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of polynomials below degree 23 by the generator."""
    r = words.astype(np.int64)
    for i in range(22, 10, -1):
        r ^= np.where(r >> i & 1, GENERATOR << (i - 11), 0)
    return r


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndromes of the low 12 and high 11 bits, and of each syndrome the one error of three bits or fewer."""
    errors = np.array([sum(1 << i for i in c) for k in range(4) for c in combinations(range(23), k)])
    by_syndrome = np.zeros(2048, np.int64)
    by_syndrome[_remainder(errors)] = errors
    return _remainder(np.arange(4096)), _remainder(np.arange(2048) << 12), by_syndrome


def golay_index(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each word of 23 bits."""
    low, high, error = _code()
    words = words.astype(np.int64)
    return (words ^ error[low[words & 4095] ^ high[words >> 12]]) >> 11


def golay_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Sorted indices of each word and its neighbours at one of ``bits`` bits, padded with -1 to six columns."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(golay_index(words[:, None] ^ flips), axis=1)
    fresh = np.diff(found, axis=1, prepend=-1) > 0
    out = np.full((len(words), 6), -1)
    at, _ = np.nonzero(fresh)
    out[at, (np.cumsum(fresh, 1) - 1)[fresh]] = found[fresh]
    return out


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints."""
    seg = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay_keys(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    rows, out = [], []
    kinds = [(near[j], seg[i]) for i, j in permutations(range(3), 2)]
    pair = np.where((near[0][:, :, None] < 0) | (near[1][:, None, :] < 0), -1, near[0][:, :, None] << 12 | near[1][:, None, :]).reshape(len(fps), 36)
    kinds += [(pair, seg[2] & 1023), (pair, seg[2] >> 10)]
    for k, (fuzzy, exact) in enumerate(kinds):
        row, col = np.nonzero(fuzzy >= 0)
        rows.append(row)
        out.append(k << 48 | exact[row] << 24 | fuzzy[row, col])
    return np.concatenate(rows), np.concatenate(out)


def ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words within two bits of each fingerprint, and their distances; one row of columns for each."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = np.array([one[a] | one[b] for a, b in combinations(range(64), 2)], np.uint64)
    flips = np.concatenate([[np.uint64(0)], one, two]).astype(np.uint64)
    return fps[:, None] ^ flips, np.repeat([0, 1, 2], [1, len(one), len(two)])


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of distinct unsigned fingerprints under pairs within three bits."""
    left, a, b = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= 3
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue += [*found]
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, *, bucket: int = 48, most: int = 8192) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span all pairs within three bits."""

    def emit(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                fp = pdf["fp"].to_numpy()[at : at + 4096]
                row, key = keys(fp.view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": fp[row]})

    def near(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                fp = pdf["fp"].to_numpy()[at : at + 64]
                word, far = ball(fp.view(np.uint64))
                yield pd.DataFrame({"word": word.view(np.int64).ravel(), "fp": np.repeat(fp, len(far)), "far": np.tile(far, len(fp)).astype(np.int8)})

    def span(batches):
        for pdf in batches:
            for s in pdf["s"]:
                a, b = forest(np.unique(np.asarray(s, np.int64)).view(np.uint64))
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    keyed = fps.mapInPandas(emit, "key long, fp long")
    found = stored(shared(stored(keyed, "simhash-keys"), "key", "simhash"), "simhash-shared")
    small = found.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("s"))
    pairs = small.select(F.explode(F.expr("flatten(transform(s, x -> transform(filter(s, y -> y > x and bit_count(x ^ y) <= 3), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    middle = found.where(F.col("n").between(bucket + 1, most)).groupBy("key").agg(F.collect_list("fp").alias("s"))
    spanned = middle.mapInPandas(span, "a long, b long")
    hot = found.where(F.col("n") > most).select("fp").distinct()
    met = hot.mapInPandas(near, "word long, fp long, far byte")
    centre = met.groupBy("word").agg(F.min(F.when(F.col("far") <= 1, F.col("fp"))).alias("a"), F.count("*").alias("n")).where("a is not null and n > 1").drop("n")
    around = met.join(centre, "word").where("a <> fp and bit_count(a ^ fp) <= 3").select("a", F.col("fp").alias("b"))
    return pairs.union(spanned).union(around).distinct()


def fingerprint_classes(marked: DataFrame, *, bucket: int = 48, most: int = 8192) -> DataFrame:
    """Rows of ``marked`` (stored; doc_id, fp and others) with component_id, the smallest id of their class."""
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    root = components(links(first.select("fp"), bucket=bucket, most=most))
    rooted = stored(first.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("k")), "classes")
    classes = stored(meet(rooted, least, ["root"], "k").select("fp", "component_id", "n"), "class-of")
    return meet(marked, classes, ["fp"], "n")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, bucket: int = 48, most: int = 8192, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, fingerprint (16 hex digits) and component_id of each row."""
    cols = kept_columns(keep, ["doc_id", "fp", "fingerprint", "component_id"])
    marked = stored(fingerprints(docs, doc_id=doc_id, text=text, width=width, keep=tuple(cols)), "fingerprints")
    named = fingerprint_classes(marked, bucket=bucket, most=most)
    return named.select("doc_id", *cols, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
