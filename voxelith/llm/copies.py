"""Near copies of texts: classes linked by a Jaccard similarity of their word shingles of 0.8 or more.

Texts are classed by ``simhash`` first: fingerprints, Golay-code keys and links at three differing bits. A class is
a bucket, in which all pairs that are similar are linked. Edits that are scattered change more bits (about ten at
similarity 0.8), so there are buckets of MinHash keys beside: ``BANDS`` keys of ``ROWS`` minima each; of pairs with
similarity 0.8 that are not in one class, one in 5000 shares no key (fewer above).

Every link is verified on the exact shingle sets, texts with equal words are collapsed before, and the work in a
bucket grows with its rows, not with its pairs: first each member is compared with the bucket's smallest one.
Buckets whose members are then all in one component are done. In the others only pairs of different components are
left: those of small buckets are compared as rows, each pair once, those of larger ones breadth first in tasks, in
blocks if one task should not hold the bucket.

Keys that hold many rows (copies of a text, a bucket of very many texts) are met as ``joins`` says.

Defined cases: words are split and folded as in ``simhash``, so texts with equal words share a fingerprint. They are
one class, as are all null texts and texts without words. Fewer words than a shingle form one shingle. Ids may be
null or repeat: rows are told apart by id and text, and rows equal in both are one. Texts are read whole; a very
long one adds minima in blocks of shingles. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.graph import components
from voxelith.llm.joins import meet, shared
from voxelith.llm.simhash import LOWER, fingerprint, fingerprint_classes
from voxelith.llm.storage import drop_since, mark, stored
from voxelith.llm.texts import release

BANDS, ROWS = 28, 6
_rng = np.random.default_rng(20)
FLIP, TIMES = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted 64-bit digests of the distinct shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 5) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)], np.uint64))


def band_keys(found: np.ndarray, block: int = 2048) -> list[int]:
    """One signed key a band; none of an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), block):
        least = np.minimum(least, ((found[at : at + block, None] ^ FLIP) * TIMES).min(0))
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def bridges(roots: list, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of members of different roots that are similar, enough to span all such pairs. Sets are not empty."""
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    own = np.split(code, np.cumsum(sizes)[:-1])
    _, root = np.unique(np.array(roots), return_inverse=True)
    marked, out = np.zeros(code.max() + 1, bool), []
    left = np.arange(len(sets))
    while len(left):
        first = root[left] == root[left[0]]
        queue, left = [*left[first]], left[~first]
        flat, start = None, None
        while queue and len(left):
            if flat is None:
                flat, start = np.concatenate([own[i] for i in left]), np.cumsum(sizes[left]) - sizes[left]
            x = queue.pop()
            marked[own[x]] = True
            both = np.add.reduceat(marked[flat], start, dtype=np.int64)
            marked[own[x]] = False
            hit = left[both >= least * (sizes[x] + sizes[left] - both)]
            if len(hit):
                out += [(int(x), int(y)) for y in hit]
                met = np.isin(root[left], root[hit])
                queue += [*left[met]]
                left, flat = left[~met], None
    return out


def row_key(doc_id: str, text: str) -> Column:
    """A string that tells rows apart, but for rows equal in id and text; ids may be null."""
    known = F.when(F.col(doc_id).isNotNull(), F.concat(F.lit(":"), F.col(doc_id).cast("string")))
    return F.concat(F.md5(F.coalesce(F.col(text), F.lit(""))), F.coalesce(known, F.lit("")))


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, small: int = 32, block: int = 2048) -> DataFrame:
    """key, doc_id, root (equal within a class) and n of each key of rows, n rows; see ``row_key``. Stored."""
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def digest(batches):
        release()
        for pdf in batches:
            texts = pdf.pop("text")
            words, fps = [folded(t) for t in texts], np.array([fingerprint(t) for t in texts], np.uint64)
            ids, bands = [xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words], [band_keys(shingles(w, width)) for w in words]
            yield pdf.assign(node=ids, bands=bands, fp=fps.view(np.int64), worded=[bool(w) for w in words])

    def verify(batches):
        release()
        for pdf in batches:
            known = {n: shingles(folded(t), width) for n, t in {**dict(zip(pdf["a"], pdf["s"])), **dict(zip(pdf["b"], pdf["t"]))}.items()}
            keep = [similar(known[a], known[b], least) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    def search(batches):
        release()
        for pdf in batches:
            for m in pdf["m"]:
                pairs = bridges([x["root"] for x in m], [shingles(folded(x["text"]), width) for x in m], least)
                yield pd.DataFrame([(m[x]["node"], m[y]["node"]) for x, y in pairs], columns=["a", "b"]).astype(str)

    marked = stored(source.mapInPandas(digest, f"doc_id {kind}, key string, node string, bands array<long>, fp long, worded boolean"), "minhash")
    nodes = stored(marked.where("worded").groupBy("node").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp")), "minhash-nodes")
    point = mark()
    alike = stored(fingerprint_classes(stored(nodes.select(F.col("node").alias("doc_id"), "fp"), "fingerprints")).select("doc_id", F.xxhash64("component_id")), "simhash-classes")
    drop_since(docs.sparkSession, point, keep=1)
    own = stored(marked.groupBy("key", "node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "minhash-rows")
    keyed = nodes.select("node", F.explode("bands").alias("band")).union(alike)
    keys = stored(shared(stored(keyed, "minhash-keyed"), "band", "minhash"), "minhash-keys")
    centres = stored(keys.groupBy("band").agg(F.min("node").alias("a"), F.first("n").alias("times")), "minhash-centres")
    # of each text that shares a key one row is read
    of = own.groupBy("node").agg(F.min("key").alias("key")).join(keys.select("node").distinct(), "node", "left_semi")
    named = stored(of.join(own.select("node", "key", "n"), ["node", "key"]), "minhash-named")
    texts = stored(meet(source.select("key", "text"), named, ["key"], "n").groupBy("node").agg(F.min("text").alias("text")), "minhash-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        second = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
        return stored(second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").mapInPandas(verify, "a string, b string"), "minhash-links")

    tried = stored(meet(keys, centres, ["band"], "times").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "minhash-pairs")
    links = verified(tried)
    root = stored(components(links), "minhash-roots")
    rooted = stored(keys.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-rooted")
    mixed = stored(rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("times")).where("lo <> hi").select("band", "times"), "minhash-mixed")
    open_ = stored(meet(rooted, mixed, ["band"], "times").drop("times"), "minhash-open")
    few = open_.where(F.col("n") <= small).groupBy("band").agg(F.collect_list(F.struct("node", "root")).alias("s"))
    pairs = few.select(F.explode(F.expr("flatten(transform(s, x -> transform(filter(s, y -> y.node > x.node and y.root <> x.root), y -> struct(x.node as a, y.node as b))))")).alias("p")).select("p.a", "p.b").distinct()
    more = verified(pairs.join(tried, ["a", "b"], "left_anti"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = open_.where(F.col("n") > small).withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    groups = dealt.join(texts, "node").groupBy("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list(F.struct("node", "root", "text")).alias("m"))
    found = groups.select("m").mapInPandas(search, "a string, b string").distinct()
    final = components(links.union(more).union(found)).toDF("node", "root")
    class_of = own.groupBy("node").agg(F.count("*").alias("k")).join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return stored(meet(own, stored(class_of, "minhash-class-of"), ["node"], "k").select("key", "doc_id", "root", "n"), "minhash-classes")
