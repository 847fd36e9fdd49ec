"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton accepts all word sequences that occur in a template or phrase; built once, it is sent to the tasks
(its size depends on the templates only). Each text streams through it word by word, which gives its matching
statistics: at each word the longest sequence ending there that a template holds, and by the suffix links the
longest that each template holds. Phrases end where their state is on the suffix links of the present one. A
template's matches of at least ``least`` words that it does not hold longer are chained, in order and without
crossing, into spans; each span that covers ``cover`` or more of the template's words counts, best first, and gives
its label. So every copy of a notice in a text has a span, and a notice within another's wording has one too.

Defined cases: a null or empty text has no words, no labels and score 0. Texts are read whole, very long ones too;
matches end at a text's end. Overlapping places all count; spans of one template do not overlap. Repeated rows give
equal results; ids may be null. Other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates (short notices, and those that public licences ask to be attached), by their labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring
        rights to this work.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software.""",
}

FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Automaton:
    vocabulary: dict[bytes, int]
    pairs: np.ndarray  # whether a template holds word b after word a
    step: list[dict[int, int]]
    link: list[int]
    depth: list[int]
    held: list[list[tuple[int, int, list[int]]]]  # (template, words, places of their last word) for each template on the suffix links of each state
    phrases: list[list[tuple[int, int]]]  # (words, phrase) on the suffix links of each state
    names: list[str]  # labels of the templates
    sizes: list[int]
    phrase_labels: list[str] = field(default_factory=list)


def build(templates: dict[str, str], phrases: dict[str, str]) -> Automaton:
    """The generalised suffix automaton of the words of all templates and phrases."""
    texts = [words_of(t) for t in [*templates.values(), *phrases]]
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in t] for t in texts]
    step, link, depth, ends = [{}], [-1], [0], [[]]

    def state(d: int, edges: dict[int, int], up: int) -> int:
        step.append(edges)
        link.append(up)
        depth.append(d)
        ends.append([])
        return len(step) - 1

    def split(p: int, w: int, q: int) -> int:
        copy = state(depth[p] + 1, dict(step[q]), link[q])
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def extend(p: int, w: int) -> int:
        q = step[p].get(w)
        if q is not None:  # another text had this already
            return q if depth[q] == depth[p] + 1 else split(p, w, q)
        new = state(depth[p] + 1, {}, 0)
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if depth[q] == depth[p] + 1 else split(p, w, q)
        return new

    whole = {}
    for t, ids in enumerate(coded):
        at = 0
        for i, w in enumerate(ids):
            at = extend(at, w)
            if t < len(templates):
                ends[at].append((t, i))
        whole[t] = ids
    for v in sorted(range(1, len(step)), key=lambda v: -depth[v]):
        if link[v] > 0:
            ends[link[v]] += ends[v]
    own = defaultdict(list)
    for k in range(len(phrases)):
        ids, at = coded[len(templates) + k], 0
        for w in ids:
            at = step[at][w]
        own[at].append((len(ids), k))
    found: list[list[tuple[int, int]]] = [[] for _ in step]
    for v in sorted(range(1, len(step)), key=lambda v: depth[v]):
        found[v] = own[v] + found[link[v]]
    pairs = np.zeros((len(vocabulary),) * 2, bool)
    for ids in coded:
        pairs[ids[:-1], ids[1:]] = True
    held: list[list[tuple[int, int, list[int]]]] = [[] for _ in step]
    for v in sorted(range(1, len(step)), key=lambda v: depth[v]):
        own = defaultdict(list)
        for t, i in sorted(set(ends[v])):
            own[t].append(i)
        held[v] = [(t, depth[v], places) for t, places in own.items()] + [x for x in held[link[v]] if x[0] not in own]
    return Automaton(vocabulary, pairs, step, link, depth, held, found, list(templates), [len(coded[t]) for t in range(len(templates))], list(phrases.values()))


def statistics(words: list[bytes], a: Automaton):
    """(place, length, state) at each word whose match has two words or more."""
    ids = np.fromiter((a.vocabulary.get(w, -1) for w in words), np.int64, len(words))
    met = (ids[:-1] >= 0) & (ids[1:] >= 0)
    at = np.flatnonzero(met)
    at = at[a.pairs[ids[at], ids[at + 1]]]  # no match of two words or more lies elsewhere
    if not len(at):
        return
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    for lo, n in zip(at[first].tolist(), np.diff(first, append=len(at)).tolist(), strict=True):
        v, length = 0, 0
        for i, w in enumerate(ids[lo : lo + n + 1].tolist(), lo):
            while v and w not in a.step[v]:
                v = a.link[v]
                length = a.depth[v]
            if w in a.step[v]:
                v = a.step[v][w]
                length += 1
            if length > 1:
                yield i, length, v


def template_matches(words: list[bytes], a: Automaton, least: int) -> dict[int, list[tuple[int, int, int]]]:
    """Of each template its (text start, template start, words) that it does not hold longer, of ``least`` words or more."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    open_: dict[int, tuple[int, list[int]]] = {}  # template: words, places of the last word
    last = -2

    def close(t: int) -> None:
        n, places = open_.pop(t)
        if n >= least:
            out[t] += [(last - n + 1, end - n + 1, n) for end in places]

    for i, length, v in statistics(words, a) if len(words) > 1 else ():
        now = {t: (min(n, length), places) for t, n, places in a.held[v]}
        for t in [*open_]:
            if i != last + 1 or t not in now or now[t][0] != open_[t][0] + 1:
                close(t)
        open_, last = now, i
    for t in [*open_]:
        close(t)
    return out


def chains(matches: list[tuple[int, int, int]], size: int, gap: int, cover: float) -> list[tuple[float, int, int]]:
    """(covered share, first word, last word) of chains of a template's matches (text start, template start, words) that cover ``cover`` or more, best first; none overlaps another."""
    matches = sorted(matches)
    best: list[tuple[int, int]] = []  # words covered by the best chain that ends here; where it starts
    for i, (x, y, n) in enumerate(matches):
        own = (n, x)
        for j in range(i - 1, -1, -1):
            px, py, pn = matches[j]
            if x - px - pn > gap + size:
                break
            skip = max(0, px + pn - x, py + pn - y)
            if px < x and py < y and skip < n and abs((x - px) - (y - py)) <= gap:
                own = max(own, (best[j][0] + n - skip, best[j][1]), key=lambda c: (c[0], -c[1]))
        best.append(own)
    found = [(k / size, first, x + n - 1) for (k, first), (x, _, n) in zip(best, matches, strict=True) if k >= cover * size]
    taken: list[tuple[int, int]] = []
    out = []
    for share, first, last in sorted(found, key=lambda c: (-c[0], c[1], c[2])):
        at = bisect_left(taken, (last + 1,))
        if at == 0 or taken[at - 1][1] < first:
            insort(taken, (first, last))
            out.append((share, first, last))
    return out


def scan(text: str | None, a: Automaton, least: int = 3, cover: float = 0.7, gap: int = 12) -> dict:
    """Base places and labels, labels with those of covered templates, their spans, and the score of one text."""
    words = words_of(text)
    places, base = [], set()
    for i, length, v in statistics(words, a) if len(words) > 1 else ():
        for n, k in a.phrases[v]:
            if n <= length:
                places.append(i - n + 1)
                base.add(a.phrase_labels[k])
    spans = [(a.names[t], *c) for t, m in sorted(template_matches(words, a, least).items()) for c in chains(m, a.sizes[t], gap, cover)]
    best = max([1.0 if places else 0.0, *(s[1] for s in spans)])
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[0] for s in spans})), "score": min(1.0, best), "spans": spans}


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: int = 3, cover: float = 0.7, gap: int = 12) -> DataFrame:
    """One row per document: places and labels of phrases, labels of all, spans of templates, score."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(build(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def run(batches):
        for pdf in batches:
            rows = [scan(t, sent.value, least, cover, gap) for t in pdf["text"]]
            out = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype="Int64" if c.endswith("_word") else None) for c in names})
            out["spans"] = [[{"template": n, "share": s, "first": x, "last": y} for n, s, x, y in r["spans"]] for r in rows]
            yield out.assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", *names]]

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInPandas(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template: string, share: double, first: long, last: long>>")
