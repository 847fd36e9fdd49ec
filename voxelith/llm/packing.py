"""Packing by shortest-pack-first over the histogram of lengths.

Documents are tokenized, closed by an end id and cut into pieces of at most ``capacity`` ids. The histogram of
piece lengths, at most ``capacity`` rows, goes to the driver. There lengths are placed longest first, all pieces
of a length at once, each into the open packing pattern with the shortest packs, whose count is split when fewer
pieces than packs remain. Patterns then meet the pieces by rank: each place of a pattern owns an interval of the
ranks of its length. Ranks are taken within groups of a length, as many as its pieces need, with the groups'
counts before them added, so that no task ranks a whole length.

The table of places is bounded by the capacity: each length splits one pattern at most, and equal lengths of a
pattern, of which it has at most sqrt(2 capacity) different ones, form one row.

Defined cases: a null or empty text is its end id alone. Texts are tokenized whole, very long ones too. Repeated
rows are packed as documents of their own; ids may be null. Other columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.storage import stored
from voxelith.llm.texts import release, slices

CAPACITY = 1024
SPLIT = re.compile(r"(?<=\S)(?= \S)")
OTHER = re.compile(r"[^\S \n]")  # white space but space and line feed
#: The pre-tokenizer whose words can be tokenized one by one; with any other, texts are tokenized whole.
BY_WORDS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def ids_of(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def crowded(text: str) -> bool:
    """Whether a text has other white space than single spaces and line feeds between other characters."""
    beside = any(two in text for two in ("  ", "\n\n", " \n", "\n "))
    return bool(text) and (beside or text[0] in " \n" or text[-1] in " \n" or OTHER.search(text) is not None)


class Numbers(dict):
    """Numbers of words, given in the order in which they are first looked up; ``new`` holds those since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` from ``at`` on, twice as long as need be where it is too short."""
    if at + len(values) > len(array):
        array = np.concatenate([array[:at], np.zeros(at + 2 * len(values), array.dtype)])
    array[at : at + len(values)] = values
    return array


class PieceIds:
    """Ids of texts as little-endian 32-bit bytes, by words.

    The pre-tokenizer never joins characters across a single space or line feed with other characters on both
    sides, so a text's ids are those of its words, each with the space or line feed before it. Words are numbered; a
    new one is tokenized once, many at a time, and its ids lie in one array, from which those of whole slices are
    gathered. The tables are emptied when they hold ``limit`` bytes. Texts with other white space are cut only where
    a single space stands between other characters.
    """

    def __init__(self, tokenizer, limit: int = 50_000_000, slice_chars: int = 1 << 20):
        self.tokenizer, self.limit, self.slice_chars = tokenizer, limit, slice_chars
        self.feed = len(ids_of(tokenizer, "\n")) // 4
        # of each id, whether its token begins with the joint that stands before words in a batch
        size = tokenizer.get_vocab_size()
        self.joints = {}
        for joint, mark in ((" ", "\u0120"), ("\n", "\u010a")):
            self.joints[joint] = np.fromiter(((tokenizer.id_to_token(i) or "").startswith(mark) for i in range(size)), bool, size)
        self.empty()

    def empty(self) -> None:
        self.numbers, self.held, self.used = Numbers(), 0, 0
        self.ids, self.starts, self.counts = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, group: int = 512) -> None:
        """Tokenize the new words: those that begin with a line feed, and those that follow a space."""
        new, self.numbers.new = self.numbers.new, []
        first = np.fromiter((w[0] == "\n" for w in new), bool, len(new))
        starts, counts, parts, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], self.used
        for joint, chosen in (("\n", np.flatnonzero(first)), (" ", np.flatnonzero(~first))):
            groups = [chosen[k : k + group] for k in range(0, len(chosen), group)]
            # words after a line feed bring their own
            texts = ["".join([new[i] for i in g]) if joint == "\n" else " " + " ".join([new[i] for i in g]) for g in groups]
            for g, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                begin = np.flatnonzero(self.joints[joint][ids])
                starts[g], counts[g] = begin + at, np.diff(begin, append=len(ids))
                parts.append(ids)
                at += len(ids)
        known = len(self.numbers) - len(new)
        self.ids = _put(self.ids, self.used, np.concatenate(parts))
        self.starts, self.counts = _put(self.starts, known, starts), _put(self.counts, known, counts)
        self.held += sum(map(len, new)) + 180 * len(new) + 4 * (at - self.used)
        self.used = at

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out: list[bytes] = []
        for a, b in slices(map(len, texts), self.slice_chars):
            if self.held > self.limit:
                self.empty()
            words, ends, clean = [], [0], [bool(t) and not crowded(t) for t in texts[a:b]]
            for t, ok in zip(texts[a:b], clean, strict=True):
                if ok:
                    words += ("\n" + t).replace("\n", " \n").split(" ")[1:]
                    ends.append(len(words))
            numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            if self.numbers.new:
                self.learn()
            counts = self.counts[numbers]
            upto = np.concatenate([[0], np.cumsum(counts)])
            found = self.ids[np.repeat(self.starts[numbers] - upto[:-1], counts) + np.arange(upto[-1])]
            bounds = iter(zip(upto[ends[:-1]].tolist(), upto[ends[1:]].tolist(), strict=True))
            for t, ok in zip(texts[a:b], clean, strict=True):
                if ok:
                    lo, hi = next(bounds)
                    out.append(found[lo + self.feed : hi].tobytes())  # the first word has no line feed before it
                else:
                    out.append(b"".join(ids_of(self.tokenizer, x) for x in SPLIT.split(t)) if t else b"")
        return out


def by_words(tokenizer) -> bool:
    """Whether a tokenizer's words can be tokenized one by one."""
    parts = json.loads(tokenizer.to_str())
    pre = parts["pre_tokenizer"] or {}
    return not parts["normalizer"] and all(pre.get(k) == v for k, v in BY_WORDS.items())


def _tokenize(path: str, table_bytes: int):
    """The function from texts to their ids."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return PieceIds(model, table_bytes).many if by_words(model) else lambda texts: [ids_of(model, t) for t in texts]


@lru_cache(maxsize=1)
def _kept(path: str, table_bytes: int):
    return _tokenize(path, table_bytes)


def pieces(docs: DataFrame, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY, table_bytes: int = 120_000_000, keep_table: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece.

    A table of words holds ``table_bytes`` at most. With ``keep_table`` a worker keeps it for its next task, so that
    fewer words are tokenized again; without, it goes with its task, where memory matters more.
    """
    kind = dict(docs.dtypes)[doc_id]

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        release()
        many = (_kept if keep_table else _tokenize)(tokenizer, table_bytes)
        end = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            out = defaultdict(list)
            for i, ids in enumerate(many([t or "" for t in pdf["text"]])):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for k, v in (("row", i), ("start", start), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part)), ("doc_tokens", n)):
                        out[k].append(v)
            if out:
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[out.pop("row")].to_numpy(), **out})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths) and how many packs have each, for a histogram of lengths."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by the room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            # among the packs with room, the shortest: those with the most room
            room = max((r for r, packs in open_.items() if r >= length and packs), default=None)
            if room is None:
                open_[capacity - length].append(((length,), left))
                break
            pattern, packs = open_[room].pop()
            used = min(packs, left)
            if packs > used:
                open_[room].append((pattern, packs - used))
            open_[room - length].append(((*pattern, length), used))
            left -= used
    return sorted(x for packs in open_.values() for x in packs)


def places(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first pack, packs, offset) of each run of equal lengths in the patterns: ranks low to high - 1 of the length fill its places, pack by pack."""
    out, first, used = [], 0, defaultdict(int)
    for pattern, packs in found:
        offset = 0
        for length, same in groupby(pattern):
            n = len(list(same))
            out.append((length, used[length], used[length] + n * packs, first, packs, offset))
            used[length] += n * packs
            offset += n * length
        first += packs
    return out


def pack(cut: DataFrame, *, capacity: int = CAPACITY, least: int = 64, rows: int = 100_000) -> DataFrame:
    """Pieces with sequence_id and offset. Ranks of a length are taken in ``least`` groups, or as many as keep about ``rows`` pieces in one."""
    spark = cut.sparkSession
    cut = stored(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = spark.createDataFrame([(k, max(least, -(-n // rows))) for k, n in histogram.items()], "length long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "part"), F.col("salts")).cast("int")
    dealt = cut.withColumn("part", F.spark_partition_id()).join(F.broadcast(salts), "length").withColumn("salt", salt)
    dealt = stored(dealt.drop("salts"), "dealt-pieces")
    counts = stored(dealt.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    table = spark.createDataFrame(places(patterns(histogram, capacity)), "length long, low long, high long, first long, packs long, offset long")
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    # one row a group of pieces: capacity x least rows, and one for each ``rows`` pieces
    ranked = dealt.withColumn("rank", rank).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    hit = (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    joined = ranked.alias("r").join(F.broadcast(table).alias("p"), hit)  # bounded by the capacity, as told above
    at = F.col("rank") - F.col("low")
    return joined.select("doc_id", "start", "r.length", "ids_crc32", "doc_tokens", (F.col("first") + at % F.col("packs")).alias("sequence_id"), (F.col("offset") + F.floor(at / F.col("packs")).cast("long") * F.col("r.length")).alias("offset"))
