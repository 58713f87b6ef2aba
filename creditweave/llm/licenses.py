"""License scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs (lines, and the parts of joined lines that hold a notice) become sparse hashed word 1- and 2-grams. A multinomial logistic regression over licence families and
an unknown class is trained on variations of the templates below and on paragraphs of the corpus; its temperature is
calibrated on held-out variations. A family counts once the paragraph also shares enough words, in order, with one
of that family's templates."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

# Usual wordings of licence notices, by family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This software is distributed under the Apache License 2.0."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.", "Released under the GPL version 3 license."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Released into the public domain under CC0."],
    "proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced without permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Notices so short that all their words must stand there, one after another.
SHORT = {"proprietary": ["All rights reserved."]} | {
    f: [f"SPDX-License-Identifier: {x}" for x in ids]
    for f, ids in {"mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "gpl-3.0": ["GPL-3.0"], "gpl-2.0": ["GPL-2.0"], "lgpl": ["LGPL-2.0", "LGPL-2.1", "LGPL-3.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "mpl-2.0": ["MPL-2.0"], "cc-by": ["CC-BY-4.0", "CC-BY-3.0"], "cc-by-sa": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"], "cc-by-nc": ["CC-BY-NC-4.0", "CC-BY-NC-3.0"], "cc0": ["CC0-1.0"]}.items()
}
UNKNOWN, FAMILIES = "unknown", sorted(TEMPLATES)
DIMENSIONS = 1 << 15
_WORD = re.compile(r"[^\W_]+")


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _hash(words: tuple[str, ...]) -> int:
    return zlib.crc32("\x1f".join(words).encode()) % DIMENSIONS


def features(words: list[str]) -> np.ndarray:
    """Indices of the hashed 1- and 2-grams, each once."""
    return np.array(sorted({_hash((w,)) for w in words} | {_hash(p) for p in zip(words, words[1:], strict=False)}), np.int64)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    return _prefixes(a, b)[-1] if b else 0


def _prefixes(a: list[str], b: list[str]) -> list[int]:
    """For each prefix of b, the length of its longest common subsequence with a; one bit a word of a."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    out = []
    for w in b:
        hit = free & where.get(w, 0)
        free = ((free + hit) | (free - hit)) & full
        out.append(len(a) - free.bit_count())
    return out


def confirmation(words: list[str], family: str) -> float:
    """The best share of a template's words that the paragraph has in order; the paragraph may go on around them."""
    found = 0.0
    for t in TEMPLATES[family]:
        want = tokens(t)
        if len(words) <= 4 * len(want):
            found = max(found, common_words(want, words) / len(want))
        else:
            found = max([found, *(common_words(want, words[a : a + 2 * len(want)]) / len(want) for a in range(len(words) - 2 * len(want) + 1) if a == 0 or words[a] in want or a == len(words) - 2 * len(want))])
    return found


_NOTICES = [(f, tokens(t), 2) for f in FAMILIES for t in TEMPLATES[f]] + [(f, tokens(t), 1) for f in FAMILIES for t in SHORT.get(f, [])]
_PLACE = {w: i for i, w in enumerate(sorted({w for _, t, _ in _NOTICES for w in t}), 1)}
_HAS = np.zeros((len(_PLACE) + 1, len(_NOTICES)), np.int32)  # whether a notice has a word
for _j, (_, _t, _) in enumerate(_NOTICES):
    _HAS[[_PLACE[w] for w in _t], _j] = 1
_WIDTH = np.array([len(t) * room for _, t, room in _NOTICES])
_LONG = np.array([room > 1 for _, _, room in _NOTICES])
LINES_AT_ONCE = 4096


def worth_judging(places: list[np.ndarray], confirmed: float) -> list[bool]:
    """For lines given as the places of their words: whether they have `confirmed` of the words of any template, in any order.
    Lines that don't cannot be confirmed, so leaving them unjudged loses nothing."""
    least = np.ceil(confirmed * _WIDTH[_LONG] / 2 - 1e-9)
    out: list[bool] = []
    for a in range(0, len(places), LINES_AT_ONCE):
        some = places[a : a + LINES_AT_ONCE]
        line = np.repeat(np.arange(len(some)), [len(p) for p in some])
        counts = np.bincount(line * len(_HAS) + np.concatenate(some), minlength=len(some) * len(_HAS)).reshape(len(some), -1)
        out += (counts @ _HAS[:, _LONG] >= least).any(1).tolist()
    return out


def notices(words: list[str], confirmed: float) -> list[tuple[int, int, str, float]]:
    """(first word, end, family, share) of every part of words that has `confirmed` of a template's words in order within twice
    its length, or all words of a short notice; parts are as tight as they can be. Of parts that overlap, those with the most
    words of a template stay (a version 3 is not also a version 2 whose number is missing).

    No more words are in order than a window has of the template, so windows that have too few are not compared."""
    least = np.array([np.ceil(confirmed * len(t) - 1e-9) if room > 1 else len(t) for _, t, room in _NOTICES])
    place = np.array([_PLACE.get(w, 0) for w in words])
    n, out = len(words), []
    for j in np.flatnonzero(np.bincount(place, minlength=len(_HAS)) @ _HAS >= least):
        has = _HAS[place, j]
        before = np.concatenate(([0], has.cumsum()))
        many = (before[np.minimum(np.arange(n) + _WIDTH[j], n)] - before[:-1] >= least[j]) & (has > 0)
        family, want, room = _NOTICES[j]
        after, best = 0, None
        for a in np.flatnonzero(many).tolist():
            if best and a >= best[1]:
                out.append(best)
                after, best = best[1], None
            if a < after:
                continue
            part = words[a : a + room * len(want)]
            if room == 1:
                if part == want:
                    out.append((a, a + len(want), family, 1.0, len(want)))
                continue
            row = _prefixes(want, part)
            if row[-1] >= least[j] and (best is None or row[-1] / len(want) >= best[3]):
                best = (a, a + row.index(row[-1]) + 1, family, row[-1] / len(want), row[-1])
        if best:
            out.append(best)
    longest: list[tuple] = []
    for part in sorted(out, key=lambda x: -x[4]):
        if not any(part[0] < b and a < part[1] and part[4] < k for a, b, _, _, k in longest):
            longest.append(part)
    return [part[:4] for part in longest]


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # (DIMENSIONS, families + 1); the last class is unknown
    bias: np.ndarray
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        f = features(words)
        z = (self.bias + self.weights[f].sum(0) / max(1.0, len(f)) ** 0.5) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(docs: DataFrame, sample: int = 500, sample_lines: int = 10_000, line_chars: int = 2000, variations: int = 60, rounds: int = 120, rate: float = 0.5, seed: int = 0) -> Classifier:
    """Trains on `variations` of each template (words dropped, other words around them) and, as unknown, on lines without a notice
    from a hash sample of about `sample` documents: at most sample_lines, chosen by a hash, of up to line_chars characters each
    (bounds of training alone: scans judge all lines, whole). The temperature is fitted on held-out variations, held-out
    lines, and the sample's own lines that hold a notice. Without documents the unknown class has shuffled template words only."""
    rng = np.random.default_rng(seed)
    lines = bounded(docs.select("doc_id", "text"), "doc_id", sample).select("doc_id", F.posexplode(F.split("text", "\n"))).where(F.length("col").between(1, line_chars))
    drawn = [tokens(r["col"]) for r in lines.orderBy(F.xxhash64("doc_id", "pos", "col"), "doc_id", "pos", "col").select("col").limit(sample_lines).collect()]
    told = [(w, notices(w, 0.6)) for w in drawn if w]
    other = [w for w, n in told if not n] or [["text"]]
    real = [(w, n[0][2]) for w, n in told if len(n) == 1 and n[0][3] >= 0.75]
    rows, y = [], []
    for k, family in enumerate(FAMILIES):
        for template in [*TEMPLATES[family], *SHORT.get(family, [])]:
            want = tokens(template)
            for v in range(variations):
                kept = [w for w in want if v == 0 or rng.random() > 0.08]
                extra = other[rng.integers(len(other))][: int(rng.integers(0, 12))] if v % 2 else []
                rows.append(extra + kept if rng.random() < 0.5 else kept + extra)
                y.append(k)
            for _ in range(variations // 3):  # the same words in no order
                rows.append(list(rng.permutation(want)[: max(1, len(want) // 2)]))
                y.append(len(FAMILIES))
    for i in rng.permutation(len(other))[: len(rows)]:
        rows.append(other[i])
        y.append(len(FAMILIES))
    for w, family in real:  # for calibration only
        rows.append(w)
        y.append(FAMILIES.index(family))
    x = [features(w) for w in rows]
    size, own = np.array([max(1, len(f)) for f in x]), np.array(y)
    row, col = np.repeat(np.arange(len(x)), [len(f) for f in x]), np.concatenate(x)
    value = 1.0 / size[row] ** 0.5
    fit = (np.arange(len(x)) % 5 != 0) & (np.arange(len(x)) < len(x) - len(real))
    classes = len(FAMILIES) + 1
    used, place = np.unique(col, return_inverse=True)
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    want = np.eye(classes)[own]

    def logits() -> np.ndarray:
        z = np.zeros((len(x), classes))
        np.add.at(z, row, w[place] * value[:, None])
        return z + b

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    square = np.full(w.shape, 1e-6)
    for _ in range(rounds):  # full-batch Adagrad
        g = (soft(logits()) - want) * fit[:, None] / fit.sum()
        step = np.zeros_like(w)
        np.add.at(step, place, g[row] * value[:, None])
        step += 1e-6 * w
        square += step**2
        w -= rate * step / np.sqrt(square)
        b -= rate * g.sum(0)
    z = logits()[~fit]
    losses = [(-np.log(soft(z / t)[np.arange(len(z)), own[~fit]] + 1e-12).mean(), t) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)]
    weights = np.zeros((DIMENSIONS, classes))
    weights[used] = w
    return Classifier(weights, b, min(losses)[1])


def scan_licenses(docs: DataFrame, model: Classifier, least: float = 0.5, confirmed: float = 0.75) -> DataFrame:
    """A row for each row of docs: doc_id, licenses (families found, sorted), hits (an array of paragraph number from 0,
    family, probability, similarity) and n_paragraphs (non-blank lines).

    A hit's calibrated probability is `least` or more and its similarity to a template `confirmed` or more. Null and empty
    texts have no paragraphs. Every line that has enough words of a template to be confirmed is judged, whole. Lines up to
    the next blank one are also joined, and each part of them that has a notice is judged by itself, so notices may be wrapped or
    stand in a longer line; such a hit's paragraph is the line that it starts in.
    Repeated rows and null ids are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 x families

    def run(batches):
        m = shared.value
        for batch in batches:
            hits, counts = [], []
            for text in batch.column(1).to_pylist():
                found, n, own = {}, 0, []

                def judge(words, paragraph, family, similarity):
                    p = m.probabilities(words)
                    k = int(p.argmax())
                    if k < len(FAMILIES) and p[k] >= least and family in (None, FAMILIES[k]):
                        s = confirmation(words, FAMILIES[k]) if similarity is None else similarity
                        if s >= confirmed and s > found.get((paragraph, FAMILIES[k]), (0, 0))[1]:
                            found[paragraph, FAMILIES[k]] = (float(p[k]), s)  # noqa: B023

                for line in [*(text or "").split("\n"), ""]:
                    if line.strip():
                        own.append(tokens(line))
                        continue
                    if own:
                        places = [np.array([_PLACE.get(w, 0) for w in words], np.int64) for words in own]
                        for i, yes in enumerate(worth_judging(places, confirmed)):
                            if yes:
                                judge(own[i], n + i, None, None)
                        joined = [w for words in own for w in words]
                        lines = np.repeat(np.arange(len(own)), [len(words) for words in own])
                        for a, b, family, s in notices(joined, confirmed) if joined else ():
                            judge(joined[a:b], n + int(lines[a]), family, s)
                        n, own = n + len(own), []
                hits.append([{"paragraph": i, "family": f, "probability": p, "similarity": s} for (i, f), (p, s) in sorted(found.items())])
                counts.append(n)
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, kind), pa.array(counts, pa.int32())], names=["doc_id", "hits", "n_paragraphs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hits array<struct<paragraph: int, family: string, probability: double, similarity: double>>, n_paragraphs int")
    return found.select("doc_id", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"]))).alias("licenses"), "hits", "n_paragraphs")
