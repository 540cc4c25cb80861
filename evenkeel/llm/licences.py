"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines; long ones are cut into overlapping windows, so that a licence sentence inside
prose is seen too.  Hashed word 1- and 2-grams go through a multinomial logistic regression with one
class per licence family and one for everything else.  It is trained on cut, thinned and embedded
pieces of the templates against a bounded sample of at most `most` paragraphs of the documents (the
first in the order of a seeded hash; pieces that resemble a template are left out).  The
temperature of the softmax is fitted on pieces that were not trained on; a paragraph whose best family
stays below `sure` is no licence.  A prediction is confirmed when word triples agree with a template
of that family (of the sentence, or of the paragraph) by at least `alike`; otherwise the family is
`unknown`.

One row per document and family; a document without any has one row with family `none`.  Every whole
text is scored.  Null and empty texts have none.  Rows that repeat are scored each for itself.  Empty
table: empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm import textkeys

# Notices and opening sentences of public licences, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced or distributed without the prior written "
        "permission of the publisher.",
    ],
}

FAMILIES = ["none", *TEMPLATES]
BITS = 15
LONG, WIDTH, STEP = 40, 24, 8
MOST, FIT_CHARS, COPIES, EPOCHS = 4000, 4000, 160, 12
SURE, ALIKE = 0.5, 0.6
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD))


_FOLD = {c: c + 32 for c in range(65, 91)}


def _triples(words: list[str]) -> set:
    """Word triples; a shorter text is one tuple."""
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


PIECES = {f: [_triples(tokens(t)) for t in texts] for f, texts in TEMPLATES.items()}


def likeness(words: list[str], family: str) -> float:
    mine = _triples(words)
    best = 0.0
    for piece in PIECES[family]:
        common = len(mine & piece)
        best = max(best, common / len(piece), common / max(1, len(mine)))
    return best


def _features(raw: np.ndarray, begins: np.ndarray, powers: textkeys.Powers):
    """Buckets of words and of word pairs (one per word, with the next), words and texts' firsts."""
    first, last, at = textkeys.words(raw, begins, _GAP)
    sums = textkeys.prefix_sums(raw, powers, textkeys._FOLDED)
    h = textkeys.string_hash(sums, powers, first, last)
    one = (h >> np.uint64(64 - BITS)).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = textkeys.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return one, (pair >> np.uint64(64 - BITS)).astype(np.int64), first, last, at


def _bag(words: list[str], powers: textkeys.Powers) -> np.ndarray:
    raw, begins = textkeys.text_bytes(pa.array([" ".join(words)]))
    one, two, *_ = _features(raw, begins, powers)
    return np.concatenate([one, two + (1 << BITS)])


def _samples(background: list[list[str]], rng: np.random.Generator) -> tuple[list[list[str]], list[int]]:
    filler = [w for p in background for w in p] or ["lorem"]
    texts, classes = [], []
    for c, family in enumerate(FAMILIES[1:], 1):
        for k in range(COPIES):
            words = tokens(TEMPLATES[family][k % len(TEMPLATES[family])])
            size = max(min(3, len(words)), int(len(words) * rng.uniform(0.7, 1)))
            a = int(rng.integers(0, len(words) - size + 1))
            piece = [w for w in words[a : a + size] if rng.random() > 0.05]
            before, after = rng.integers(0, 9, 2) if rng.random() < 0.5 else (0, 0)
            pad = [filler[i] for i in rng.integers(0, len(filler), before + after)]
            texts.append(pad[:before] + piece + pad[before:])
            classes.append(c)
    for p in background:
        texts.append(p)
        classes.append(0)
    # single licence words among others are no licence
    hints = [w for t in TEMPLATES.values() for s in t for w in tokens(s)]
    for _ in range(COPIES * 4):
        words = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(4, 24)))]
        words[int(rng.integers(0, len(words)))] = hints[int(rng.integers(0, len(hints)))]
        texts.append(words)
        classes.append(0)
    return texts, classes


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(background: list[list[str]], seed: int = 9) -> dict:
    """Weights of the classifier, with the temperature folded in."""
    rng = np.random.default_rng(seed)
    clean = [p for p in background if p and max(likeness(p, f) for f in TEMPLATES) < 0.3]
    texts, classes = _samples(clean, rng)
    y = np.array(classes)
    powers = textkeys.Powers()
    bags = [_bag(t, powers) for t in texts]
    k = len(FAMILIES)
    w, b = np.zeros((2 << BITS, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    sums = np.full((2 << BITS, 1), 1e-3, dtype=np.float32)
    order = rng.permutation(len(y))
    fit, kept = order[len(y) // 5 :], order[: len(y) // 5]

    def logits(d: int) -> np.ndarray:
        return w[bags[d]].sum(axis=0) / np.sqrt(max(1, len(bags[d]))) + b

    for _ in range(EPOCHS):
        for d in rng.permutation(fit):
            bag, n = bags[d], np.sqrt(max(1, len(bags[d])))
            g = _softmax(logits(d)[None, :])[0]
            g[y[d]] -= 1
            sums[bag] += float(g @ g) / (n * n)
            w[bag] -= 0.2 * g / n / np.sqrt(sums[bag])
            b -= 0.01 * g
    z = np.stack([logits(d) for d in kept])
    scales = np.geomspace(0.2, 5, 33)
    losses = [-np.log(_softmax(s * z)[np.arange(len(kept)), y[kept]] + 1e-12).mean() for s in scales]
    scale = float(scales[int(np.argmin(losses))])
    return {"w": w * np.float32(scale), "b": b * np.float32(scale)}


def _segments(first: np.ndarray, at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word ranges and texts of the paragraphs (a long line is several)."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    line = np.searchsorted(breaks, first)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    a = np.flatnonzero(new)
    n = np.diff(np.append(a, len(first)))
    parts = np.where(n <= LONG, 1, -(-(n - WIDTH) // STEP) + 1)
    start = np.repeat(a, parts) + STEP * (
        np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    )
    end = np.minimum(np.repeat(np.where(n <= LONG, n, WIDTH), parts) + start, np.repeat(a + n, parts))
    return start, end, text[start] if len(start) else text[:0]


def _scan(model_of, sure: float, alike: float):
    names = ["doc_id", "family", "n_paragraphs", "probability", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, powers = model_of.value, textkeys.Powers()
        w, b = model["w"], model["b"]
        for batch in batches:
            raw_all, begins_all = textkeys.text_bytes(batch.column(1))
            for i, j in textkeys.slices(begins_all):
                begins = begins_all[i : j + 1] - begins_all[i]
                raw = raw_all[begins_all[i] : begins_all[j]]
                one, two, first, last, at = _features(raw, begins, powers)
                start, end, text = _segments(first, at, np.flatnonzero(raw == 10))
                size = end - start
                zero = np.zeros((1, len(b)))
                ones = np.concatenate([zero, np.cumsum(w[one], axis=0, dtype=np.float64)])
                twos = np.concatenate([zero, np.cumsum(w[two + (1 << BITS)], axis=0, dtype=np.float64)])
                total = ones[end] - ones[start] + twos[np.maximum(end - 1, start)] - twos[start]
                p = _softmax(total / np.sqrt(np.maximum(1, 2 * size - 1))[:, None] + b)
                best = p[:, 1:].argmax(axis=1) + 1 if len(p) else np.zeros(0, dtype=int)
                data, found = raw.tobytes(), {}
                for s in np.flatnonzero(p[np.arange(len(p)), best] >= sure):
                    family = FAMILIES[best[s]]
                    piece = data[first[start[s]] : last[end[s] - 1]].decode("utf-8", "replace")
                    near = likeness(tokens(piece), family)
                    name = family if near >= alike else "unknown"
                    n, prob, sim = found.get((int(text[s]), name), (0, 0.0, 0.0))
                    found[int(text[s]), name] = (n + 1, max(prob, float(p[s, best[s]])), max(sim, near))
                have = {d for d, _ in found}
                rows = [(d, f, *v) for (d, f), v in found.items()]
                rows += [(d, "none", 0, 0.0, 0.0) for d in range(j - i) if d not in have]
                cols = list(zip(*rows))
                ids = batch.column(0).take(pa.array(np.array(cols[0]) + i))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in cols[1:]]], names)

    return run


def background(documents: DataFrame, most: int, seed: int) -> list[list[str]]:
    """At most `most` paragraphs, one per doc_id (a bounded, documented sample); of a line that is a
    whole book the first `FIT_CHARS` characters."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    pick = F.get(lines, F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.size(lines)).cast("int"))
    ids = documents.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(
        F.xxhash64("doc_id", F.lit(seed)), "doc_id"
    ).limit(most)
    line = F.substring(pick, 1, FIT_CHARS)
    rows = documents.join(ids, "doc_id").groupBy("doc_id").agg(F.min(line).alias("line"))
    return [tokens(line)[:LONG] for _, line in sorted(tuple(r) for r in rows.collect())]


def licences(
    documents: DataFrame, most: int = MOST, sure: float = SURE, alike: float = ALIKE, seed: int = 9
) -> DataFrame:
    """doc_id, family, n_paragraphs, probability, similarity."""
    model = train(background(documents.select("doc_id", "text"), most, seed), seed)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select("doc_id", "text").mapInArrow(
        _scan(shared, sure, alike),
        "doc_id long, family string, n_paragraphs long, probability double, similarity double",
    )
