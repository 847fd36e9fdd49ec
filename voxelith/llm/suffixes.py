"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus. The corpus is
not sorted as a whole. Each document is first cut, by content, into segments, so that every string of ``length``
bytes lies in exactly one segment and equal strings lie in segments with equal anchors: a string's anchor is the
rightmost smallest hash of its ``GRAM``-byte grams, and a segment holds the consecutive strings with one anchor.
Segments whose anchor occurs once hold nothing repeated; equal segments collapse into one with a count. An anchor
with more than ``group`` distinct segments (say a passage quoted by a third of all documents) would not fit a
task: its segments are cut again, by where a string lies about the anchor, and get longer anchors, all bytes that
the strings of a piece share; pieces that are equal collapse again, and the last cut leaves single strings. What
is left, distinct segments that share an anchor, goes by anchor to tasks, and a task finds the strings they share:

* segments are dealt into shards, and each shard's transform (BWT) is built by sorting its own suffixes;
* the transforms are merged by refining their interleave: a stable sort of the rows by the symbols before them
  turns an order by h symbols into one by h + 1. Rows whose prefixes part in a round have a common prefix of just
  that round's length; rows alone in their interval are settled and skipped. No suffix is sorted again;
* intervals left after ``length`` rounds are the repeated strings.

Equal segments are told by an anchor's 64 bits and 64 more of the segment. Keys that hold many rows (a common
anchor, a text of many copies) are never shuffled to one task; see ``joins``.

Defined cases: a null text is empty; texts under ``length`` bytes lose nothing. Matches never cross documents.
All rows count, so a repeated row or text of ``length`` bytes or more is removed whole, ties included; ids may be
null or repeat, as rows are told apart by their texts alone. Texts are read whole, long ones in blocks. Other
columns are ignored, but for those named in ``keep``; of these, ones named like a result are left out. An empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.joins import hot_bar, meet
from voxelith.llm.storage import stored
from voxelith.llm.texts import kept_columns, release

LENGTH = 200
GRAM = 40
BLOCK = 1 << 22
BASE = 0x9E3779B97F4A7C15
BYTE_HASH = np.random.default_rng(1729).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of all grams of ``gram`` bytes, put together from powers of two."""
    have, at, done, out = BYTE_HASH[data], 1, 0, None
    while True:
        if gram & at:
            n = len(data) - done - at + 1
            out = have[: len(data) - at + 1].copy() if out is None else have[:n] * _power(done) + out[at : at + n]
            done += at
        if done == gram:
            break
        have = have[: len(have) - at] * _power(at) + have[at:]
        at *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, digest, first string and number of strings of each segment of one text."""
    parts = []
    width = length - gram + 1
    mask = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8), gram)
        low = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        n = len(part) - length + 1
        low = np.minimum(low[:n], low[width - span : width - span + n])
        anchor = (mask - (low & mask)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(first, append=n)
        where = anchor[first]
        digest = xxhash.xxh3_64_intdigest
        own = [digest(part[a : a + c + length - 1], w - a) for a, c, w in zip(first.tolist(), count.tolist(), where.tolist(), strict=True)]
        parts.append((h[where].view(np.int64), np.array(own, np.uint64).view(np.int64), first + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def shard_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (bytes + 1; 0 before a string's start), LF map and suffix starts of one shard's sorted suffixes.

    Each string ends in a terminator of its own, smaller than all bytes; UTF-8 leaves room for it.
    """
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    ends = np.flatnonzero(text == 0)
    n, m = len(text), len(ends)
    own = np.repeat(ends, np.diff(ends, prepend=-1))  # the terminator of each suffix
    # first by seven symbols at once; symbols after the terminator don't count
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    key = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    for k in range(7):
        key = key << 8 | np.where(inside, padded[k : n + k], 0)
        inside &= padded[k : n + k] != 0
    order = np.argsort(key)
    live = order[_shared(key[order])]
    rank = _dense(key, order)
    rank[ends] = np.arange(m)
    live = live[text[live] != 0]
    step = 7
    while len(live):
        key = rank[live] * (n + 1) + rank[np.minimum(live + step, own[live])]
        by = np.argsort(key)
        live, key = live[by], key[by]
        base = rank[live]
        start = np.flatnonzero(np.diff(base, prepend=-1))
        place = np.arange(len(live)) - np.repeat(start, np.diff(start, append=len(live)))
        fresh = np.diff(key, prepend=-1) != 0
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))
        rank[live] = base + place[first]
        live = live[_shared(key)]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    symbols = text[order - 1]
    starts = np.zeros(n, bool)
    starts[np.concatenate([[0], ends[:-1] + 1])] = True
    symbols[starts[order]] = 0
    lf = np.empty(n, np.int64)
    lf[np.argsort(symbols, kind="stable")] = np.arange(n)
    return symbols, lf, order


def _shared(ordered: np.ndarray) -> np.ndarray:
    same = ordered[1:] == ordered[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _dense(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each value's number of smaller values."""
    fresh = np.diff(values[order], prepend=-1) != 0
    out = np.empty(len(values), np.int64)
    out[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    return out


def merge_intervals(shards: list[tuple[np.ndarray, np.ndarray]], length: int, first: np.ndarray | None = None, lcp: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shards' transforms, interleaved, whose suffixes share ``length`` symbols; and their intervals.

    Rows are numbered through all shards. Refinement begins with the rows ``first`` (all, if None): those whose
    suffix has ``length`` symbols before it, as others would drop out at a string's start before the last round.
    ``lcp``, if a list, gets (round, rows that parted in it) with the common prefix of those rows and their former
    neighbours, round - 1.
    """
    sizes = np.cumsum([0, *(len(s) for s, _ in shards)])
    symbols = np.concatenate([s for s, _ in shards])
    lf = np.concatenate([f + a for (_, f), a in zip(shards, sizes, strict=False)]).astype(np.int32)
    rows = np.arange(len(symbols), dtype=np.int32) if first is None else first.astype(np.int32)
    interval = np.zeros(len(rows), np.int32)
    for depth in range(1, length + 1):
        before = symbols[rows]
        real = before != 0
        if not real.all():
            rows, interval, before = rows[real], interval[real], before[real]
        order = np.argsort(before, kind="stable")
        before, interval, rows = before[order], interval[order], lf[rows[order]]
        if not len(rows):
            break
        fresh = np.empty(len(rows), bool)
        fresh[0] = True
        np.logical_or(before[1:] != before[:-1], interval[1:] != interval[:-1], out=fresh[1:])
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        if lcp is not None:
            lcp.append((depth, rows[fresh]))
        if alone.any():
            rows, fresh = rows[~alone], fresh[~alone]
        interval = np.cumsum(fresh, dtype=np.int32)
    return rows, interval


def repeated_starts(strings: list[bytes], length: int = LENGTH, shard: int = 1 << 18) -> list[np.ndarray]:
    """Of each string, the starts of its substrings of ``length`` bytes that occur at two places in all strings."""
    shards, orders, held, total, at = [], [], [], 0, 0
    for i, s in enumerate(strings):
        held.append(s)
        total += len(s) + 1
        if total >= shard or i == len(strings) - 1:
            symbols, lf, order = shard_bwt(held)
            shards.append((symbols, lf))
            orders.append(order + at)
            at += total
            held, total = [], 0
    suffix = np.concatenate(orders)
    bases = np.cumsum([0, *(len(s) + 1 for s in strings)])
    within = np.arange(bases[-1]) - np.repeat(bases[:-1], np.diff(bases))
    rows, _ = merge_intervals(shards, length, np.flatnonzero(within[suffix] >= length))
    hits = np.sort(suffix[rows])
    owner = np.searchsorted(bases, hits, side="right") - 1
    local = hits - bases[owner]
    cuts = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [local[cuts[i] : cuts[i + 1]] for i in range(len(strings))]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return starts[first], np.diff(first, append=len(starts))


def text_key(text: str) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def repeated_spans(docs: DataFrame, *, text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = 400) -> tuple[DataFrame, DataFrame]:
    """(uid, spans) and (uid): of each text with repeated strings its key and an array of (first, n), its repeated starts; and the keys of texts with very many copies, which are repeated whole. Both stored."""
    spark = docs.sparkSession
    keyed = docs.select(text_key(text).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches):
        release()
        for pdf in batches:
            found = [segments(t.encode(), length, gram) for t in pdf["text"]]
            if n := sum(len(x[0]) for x in found):
                uid = np.repeat(pdf["uid"].to_numpy(), [len(x[0]) for x in found])
                h, d, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
                for a in range(0, n, 200_000):
                    s = slice(a, a + 200_000)
                    yield pd.DataFrame({"h": h[s], "d": d[s], "uid": uid[s], "first": first[s], "n": count[s].astype(np.int32)})

    anchors = stored(keyed.mapInPandas(cut, "h long, d long, uid binary, first long, n int"), "anchors")
    copies = anchors.where("first = 0").groupBy("uid").agg(F.count("*").alias("n"))  # a long text has one such segment
    copied = stored(copies.where(F.col("n") > hot_bar(anchors.where("first = 0").count())).select("uid"), "copied-texts")
    counts = anchors.groupBy("h").agg(F.count("*").alias("rows"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    shared = stored(counts.where("rows > 1").select("h", F.col("rows").alias("times"), (F.col("d0") == F.col("d1")).alias("one")), "shared-anchors")
    hits = stored(meet(anchors, shared, ["h"], "times").drop("times"), "hits")
    mixed = hits.where("not one")
    kinds = stored(mixed.groupBy("h", "d").agg(F.count("*").alias("rows"), F.min(F.struct("uid", "first", "n")).alias("at")), "kinds")
    many = kinds.where("rows > 1").select("h", "d", "rows")
    # segments that occur twice are repeated whole; strings of the others have to be found
    whole = hits.where("one").select("uid", "first", "n").unionByName(meet(mixed, many, ["h", "d"], "rows").select("uid", "first", "n"))
    fetched = _fetch(keyed, _open(kinds), length)
    merged, repeated = _spread(spark, fetched, length, gram, group)
    spans = whole.select("uid", "first", F.col("n").cast("long").alias("n")).unionByName(merged)
    for part in repeated:
        spans = spans.unionByName(part)
    out = stored(spans.groupBy("uid").agg(F.collect_set(F.struct("first", "n")).alias("spans")), "spans")
    return out, copied


def _open(kinds: DataFrame) -> DataFrame:
    """Distinct segments (h, d, rows, ...) of anchors with several, one of which occurs once; with ``kinds``, their number."""
    per_anchor = stored(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("rows").alias("least")).where("kinds > 1 and least = 1").drop("least"), "open-anchors")
    return meet(kinds, per_anchor, ["h"], "kinds")


def _fetch(keyed: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """The bytes of each distinct segment, taken from one text that holds it; stored."""
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed number of partitions, as few bytes here make many rows
    part = kinds.select("at.uid", F.struct("h", "d", "rows", "kinds", "at.first", "at.n").alias("p")).repartition(tasks, "uid")
    need = part.groupBy("uid").agg(F.collect_list("p").alias("parts"))

    def read(batches):
        release()
        for pdf in batches:
            rows = []
            for uid, text, parts in zip(pdf["uid"], pdf["text"], pdf["parts"], strict=True):
                data = text.encode()
                rows += [(p["h"], p["d"], p["rows"], p["kinds"], uid, p["first"], data[p["first"] : p["first"] + p["n"] + length - 1]) for p in parts]
            yield pd.DataFrame(rows, columns=["h", "d", "rows", "kinds", "uid", "first", "data"])

    # copies of a text combine before the shuffle
    once = keyed.where(F.octet_length("text") >= length).groupBy("uid").agg(F.first("text").alias("text"))
    joined = once.join(need, "uid").select("uid", "text", "parts")
    return stored(joined.mapInPandas(read, "h long, d long, rows long, kinds long, uid binary, first long, data binary"), "segment-bytes")


def pieces_about(data: bytes, off: int, width: int, length: int) -> list[tuple[int, int, int, int]]:
    """(anchor, digest, first, n) of a segment's pieces; the first of its strings begins ``off`` bytes before the anchor.

    Strings that begin the same number of bytes before it, up to a multiple of ``width``, form a piece. All strings
    that a piece can have share the bytes of its longer anchor.
    """
    n, out = len(data) - length + 1, []
    for block in range(off // width, (off - n + 1) // width - 1, -1):
        far, near = block * width + width - 1, block * width  # bytes before the anchor
        first, last = max(0, off - far), min(n - 1, off - near)
        context = data[off - near : off - far + length]
        part = data[first : last + length]
        out.append((xxhash.xxh64_intdigest(context, near * 1000 + width) - (1 << 63), xxhash.xxh64_intdigest(part, off - first) - (1 << 63), first, last - first + 1))
    return out


def anchor_place(data: bytes, length: int, gram: int) -> int:
    """The anchor of a segment's bytes: the rightmost smallest gram of those that all its strings have."""
    n = len(data) - length + 1
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)[n - 1 : length - gram + 1] >> np.uint64(24)
    return n - 1 + len(h) - 1 - int(np.argmin(h[::-1]))


def _spread(spark: SparkSession, fetched: DataFrame, length: int, gram: int, group: int, widths: tuple[int, ...] = (12, 1)) -> tuple[DataFrame, list[DataFrame]]:
    """(uid, first, n) of strings found by merging, and of pieces of segments that are repeated whole."""

    def cut(width: int, placed: bool):
        def run(batches):
            release()
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    data = r.data
                    off = r.off if placed else anchor_place(data, length, gram)
                    rows += [(h, d, r.rows, r.uid, r.first + a, n, off - a, data[a : a + n + length - 1]) for h, d, a, n in pieces_about(data, off, width, length)]
                yield pd.DataFrame(rows, columns=["h", "d", "rows", "uid", "first", "n", "off", "data"])

        return run

    columns = ["h", "d", "rows", "uid", "first", "data"]
    ready, repeated, held = fetched.where(F.col("kinds") <= group).select(*columns), [], fetched
    for i, width in enumerate(widths):
        hot = held.where(F.col("kinds") > group)
        if hot.isEmpty():
            break
        parts = stored(hot.mapInPandas(cut(width, i > 0), "h long, d long, rows long, uid binary, first long, n long, off int, data binary"), "pieces")
        kinds = stored(parts.groupBy("h", "d").agg(F.sum("rows").alias("rows"), F.count("*").alias("parts"), F.min(F.struct("uid", "first", "off", "data")).alias("at")), "piece-kinds")
        again = kinds.where("rows > 1").select("h", "d", "parts")
        repeated.append(meet(parts.where("rows = 1").select("h", "d", "uid", "first", "n"), again, ["h", "d"], "parts").select("uid", "first", "n"))
        held = stored(_open(kinds).select("h", "d", "rows", "kinds", "at.uid", "at.first", "at.off", "at.data"), "open-pieces")
        ready = ready.unionByName(held.where(F.col("kinds") <= group).select(*columns))
    return _merge(spark, ready, length), repeated


def _merge(spark: SparkSession, fetched: DataFrame, length: int, block: int = 1 << 21) -> DataFrame:
    """Repeated starts (uid, first, n) in segments that occur once, found among all segments with their anchor."""
    total = fetched.agg(F.sum(F.length("data"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * block) + 1)

    def work(held: list) -> pd.DataFrame:
        rows = []
        for (_, _, times, uid, first, _), starts in zip(held, repeated_starts([r[5] for r in held], length), strict=True):
            if times == 1 and len(starts):
                rows += [(uid, first + a, n) for a, n in zip(*_runs(starts), strict=True)]
        return pd.DataFrame(rows, columns=["uid", "first", "n"])

    def run(batches):
        held, size, last = [], 0, None
        for pdf in batches:
            for r in zip(pdf["h"], pdf["d"], pdf["rows"], pdf["uid"], pdf["first"], pdf["data"], strict=True):
                if size >= block and r[0] != last:
                    yield work(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5]) + 1
                last = r[0]
        if held:
            yield work(held)

    dealt = fetched.select("h", "d", "rows", "uid", "first", "data").repartition(tasks, "h").sortWithinPartitions("h")
    return dealt.mapInPandas(run, "uid binary, first long, n long")


def removal(data: bytes, spans, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the repeated strings."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(s["first"]), int(s["first"] + s["n"]) + length - 1) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _kept(data: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    ends = [0, *(b for _, b in runs)]
    return [data[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(data)], strict=True)]


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: tuple[str, ...] = (), digest: bool = True, group: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or, without ``digest``, what is left as the string ``kept``).

    In ``kept`` a character that was removed in part is left out.
    """
    spans, copied = repeated_spans(docs, text=text, length=length, group=group)
    last = "kept_sha256 string" if digest else "kept string"
    own = ["n_bytes", "n_removed", "n_spans", last.split()[0]]
    cols = [c for c in kept_columns(keep, ["doc_id", *own]) if c != text]
    keyed = docs.select(text_key(text).alias("__uid"), F.col(doc_id).alias("doc_id"), *cols, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    many = F.broadcast(copied.withColumnRenamed("uid", "__uid"))  # at most HOT_KEYS keys
    spans = spans.withColumnsRenamed({"uid": "__uid", "spans": "__spans"})
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.octet_length("__text") - (length - 1)).cast("long").alias("n")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = keyed.join(many, "__uid", "left_anti").repartition(tasks, "__uid").join(spans.repartition(tasks, "__uid"), "__uid", "left")
    joined = rest.unionByName(keyed.join(many, "__uid", "left_semi").withColumn("__spans", all_of_it)).drop("__uid")

    def apply(batches):
        release()
        for pdf in batches:
            out = []
            for t, s in zip(pdf.pop("__text"), pdf.pop("__spans"), strict=True):
                data = t.encode()
                runs = [] if s is None else removal(data, s, length)
                rest = _kept(data, runs)
                size = sum(map(len, rest))
                out.append((len(data), len(data) - size, len(runs), hashlib.sha256(b"".join(rest)).hexdigest() if digest else "".join(x.decode(errors="ignore") for x in rest)))
            more = pd.DataFrame(out, columns=own, index=pdf.index)
            yield pd.concat([pdf, more], axis=1)

    kinds = dict(keyed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *cols])
    return joined.mapInPandas(apply, f"{schema}, n_bytes long, n_removed long, n_spans long, {last}")
