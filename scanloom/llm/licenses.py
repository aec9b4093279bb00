"""License scans (operator 7) by a trained paragraph classifier.

A paragraph (lines up to one without a word, with comment marks taken away) is cut
into overlapping windows of some numbers of words, and each window is classified:
hashed word one- to three-grams go into a multinomial logistic regression, trained
by stochastic gradient descent in numpy on varied notices of each licence family,
alone and amid words of the corpus, and on a bounded sample of windows from whole
texts of the corpus as the class without a licence. The temperature comes from a
model that some notices and the held-out windows were kept from; the score that a
claim must reach is one that few held-out windows do. A claim is its
family's if a template of that family confirms it, else ``unknown``; of claims that
overlap the one that agrees more with its template stays.

Defined results: null and empty texts have no findings; very long texts and
paragraphs are scored in blocks, whole; of claims that agree and score alike the
earlier one stays; repeated rows and null ids keep their own
findings; an empty table gives no rows (the model then has notices alone to learn
from); other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, small_batches, text_chunks
from .minhash import word_hashes

UNKNOWN = "unknown"
#: Notices by which works name their licence.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL, version 2 or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
        "ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "MIT License Copyright (c) 2020 Example Inc.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages",
        "This software is provided 'as-is', without any express or implied warranty.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    UNKNOWN: [
        "Licensed under the terms of the license that comes with this work.",
        "See the license file for the terms of use.",
        "Use is subject to the license agreement.",
        "Distributed under a custom licence.",
        "Permission to copy, modify and distribute this material for any purpose is hereby granted, provided that this notice is kept.",
        "You may use, copy and share this work free of charge under the terms below.",
    ],
}
#: Plain prose with the words of notices, which is none.
PROSE = [
    "The Apache tribe and the MIT professor met under the license of the state.",
    "The driver had lost his license and asked the officer for permission to go on.",
    "Children under six may enter the museum free of charge on Sundays.",
    "She had a fishing license, and the lake was open to the public.",
    "The restaurant applied for a licence to sell wine and was granted one in May.",
    "He wrote about copyright in the eighteenth century and the rights of authors.",
    "The software was sold for a fee, and the source of the error was never found.",
    "Without warning, the general opened the public meeting and read the terms of peace.",
    "A driving licence is valid for ten years and must be renewed in person.",
    "The creative director and the commons committee shared the work of the festival.",
    "In the public domain of politics, no right is reserved for the few.",
    "The library opens at nine, and every reader may copy a page for private use.",
    "The license plate of the car was covered with mud when the police stopped it.",
    "They were granted permission to build on the condition that the trees be kept.",
    "The distribution of the prizes followed the conditions that the author had set.",
    "Poetic license lets a writer modify the facts for any purpose he likes.",
    "The GNU is a large antelope, and its public appearance in general draws a crowd.",
    "Mozilla was the name of the mascot that the company used in its early years.",
    "An eclipse was seen over the public square, and the program went on in the dark.",
    "All rights of way across the field were reserved for walkers by the old law.",
]

BUCKET_BITS, GRAMS = 16, 3
#: Windows of the corpus that stand for the class without a licence, at most, characters of one, and varied notices of a template.
SAMPLE, EXAMPLE, VARIANTS = 20000, 160, 60
#: Words of the windows; they start at every quarter of their size.
SIZES = (5, 10, 20, 40)
EPOCHS, BATCH, RATE = 6, 256, 6.0
#: Share of a template's word pairs that confirms a claim, and that an unknown licence has at least (or it names one).
CONFIRM, UNSURE = 0.6, 0.4
#: Share of held-out windows without a licence that may be claimed, and of prose about licences, of which every so many sentences are held out.
FALSE_CLAIMS, FALSE_PROSE, HELD_PROSE = 0.001, 0.1, 4
#: Bounds of the score that a claim must reach: the one for a corpus of which nothing is held out, and the one that whole notices always pass.
LOWEST, HIGHEST = 0.05, 0.95
#: Words of a block that is scored at once.
BLOCK = 1 << 15


ASCII = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Punctuation and blanks beyond ASCII, and words that start a comment line.
GLUE = re.compile(rb"\xe2\x80[\x80-\xbf]|\xc2[\xa0-\xbf]")
MARK = re.compile(rb"^ *(?:dnl|rem)(?= |$)")
WORD = re.compile(rb"[^ \t-\r]+")
NAMES_ONE = re.compile(rb"licen[cs]|copyright|rights reserved|public domain")


def plain(text: str) -> bytes:
    """A line's words in lower case, each byte in its place; what isn't a letter or digit is a blank."""
    raw = text.encode("utf-8", "surrogatepass").translate(ASCII)
    if not raw.isascii():
        raw = GLUE.sub(lambda m: b" " * len(m[0]), raw)
    return MARK.sub(lambda m: b" " * len(m[0]), raw)


def gram_buckets(word: np.ndarray) -> list[np.ndarray]:
    """For one to GRAMS words, the bucket of the run that starts at each word; those that pass the end are of no use."""
    pad = np.r_[word, np.zeros(GRAMS, np.uint64)]
    out, run = [], np.zeros(len(word), np.uint64)
    for k in range(GRAMS):
        run = run * np.uint64(0xD6E8FEB86659FD93) + pad[k : k + len(word)]
        h = (run ^ np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD)
        out.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return out


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # of family k in column k; the last column is the class without a licence
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.5

    def logits(self, word: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Those of the windows ``word[start:end]``; a window's features weigh one over the root of their number."""
        z, n = np.zeros((len(start), self.weights.shape[1])), np.zeros(len(start), np.int64)
        for k, bucket in enumerate(gram_buckets(word)):
            sums = np.zeros((len(word) + 1, z.shape[1]))
            np.cumsum(self.weights[bucket], axis=0, out=sums[1:])
            stop = np.maximum(end - k, start)
            z += sums[stop] - sums[start]
            n += stop - start
        z = z / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        z[n == 0, -1] += 100
        return z

    def softmax(self, z: np.ndarray) -> np.ndarray:
        z = np.exp((z - z.max(axis=1, keepdims=True)) / self.heat)
        return z / z.sum(axis=1, keepdims=True)

    def scores(self, lines: list[str]) -> np.ndarray:
        """Those of whole lines, a window each."""
        word, of = word_hashes([plain(x) for x in lines])
        return self.softmax(self.logits(word, of[:-1], of[1:]))


# -- templates -------------------------------------------------------------------


def _pair_keys(word: np.ndarray) -> np.ndarray:
    return word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:]


def _template_pairs() -> tuple[np.ndarray, list[list[tuple[str, int]]], dict[tuple[str, int], int]]:
    """Sorted keys of the templates' word pairs, the owners of each, and how many a template has."""
    owners: dict[int, list[tuple[str, int]]] = {}
    sizes = {}
    for family, notices in TEMPLATES.items():
        for k, notice in enumerate(notices):
            word, _ = word_hashes([plain(notice)])
            keys = set(_pair_keys(word).tolist())
            sizes[(family, k)] = len(keys)
            for key in keys:
                owners.setdefault(key, []).append((family, k))
    keys = np.array(sorted(owners), np.uint64)
    return keys, [owners[k] for k in keys.tolist()], sizes


PAIR_KEYS, PAIR_OWNERS, PAIRS_OF = _template_pairs()


def pair_hits(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of word pairs that a template has, and which pairs they are."""
    if len(word) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _pair_keys(word)
    at = np.minimum(np.searchsorted(PAIR_KEYS, key), len(PAIR_KEYS) - 1)
    hits = np.flatnonzero(PAIR_KEYS[at] == key)
    return hits, at[hits]


def agreement(places: list[int], pairs: list[int], family: str | None = None) -> tuple[float, int, int]:
    """The best template's share of word pairs among the hits, and the first and last word of those.

    Only templates of ``family``, or of all.
    """
    held: dict[tuple[str, int], dict[int, int]] = {}
    for place, pair in zip(places, pairs, strict=True):
        for owner in PAIR_OWNERS[pair]:
            if family is None or owner[0] == family:
                held.setdefault(owner, {}).setdefault(pair, place)
    best = max(sorted(held), key=lambda o: len(held[o]) / PAIRS_OF[o], default=None)
    if best is None:
        return 0.0, 0, 0
    own = held[best].values()
    return len(own) / PAIRS_OF[best], min(own), max(own) + 1


# -- training --------------------------------------------------------------------


def varied(rng: np.random.Generator, template: str, filler: list[str]) -> str:
    """A window around a notice: words left out, in other case, alone, amid words of the corpus, or most of a longer notice."""
    words = template.split()
    kept = [w for w in words if len(words) < 4 or rng.random() > 0.06]
    if rng.random() < 0.2:
        kept = [["Copyright", "(c)", str(rng.integers(1990, 2026))], ["Note:"], ["©", str(rng.integers(1990, 2026))]][rng.integers(3)] + kept
    sizes = [s for s in SIZES if 0.75 * len(kept) <= s <= 3 * len(kept)]
    if filler and sizes and rng.random() < 0.7:
        size = sizes[rng.integers(len(sizes))]
        if size < len(kept):
            at = rng.integers(0, len(kept) - size + 1)
            kept = kept[at : at + size]
        else:
            extra = [filler[i] for i in rng.integers(0, len(filler), size - len(kept))]
            at = rng.integers(0, len(extra) + 1)
            kept = extra[:at] + kept + extra[at:]
    out = " ".join(kept)
    return out.upper() if rng.random() < 0.1 else out.lower() if rng.random() < 0.2 else out


def _fit(families: int, word: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a logistic regression over the windows."""
    w, b = np.zeros((1 << BUCKET_BITS, families + 1), np.float32), np.zeros(families + 1)
    buckets = gram_buckets(word)
    none = (y == families).sum()
    weight = np.where(y == families, min(1.0, 4 * (len(y) - none) / max(1, none)), 1.0)
    for epoch in range(EPOCHS):
        turn = rng.permutation(len(y))
        for i in range(0, len(turn), BATCH):
            pick = turn[i : i + BATCH]
            at, row = [], []
            for k, bucket in enumerate(buckets):
                n = np.maximum(end[pick] - k - start[pick], 0)
                own = np.repeat(np.arange(len(pick)), n)
                at.append(bucket[np.arange(n.sum()) + np.repeat(start[pick] - np.cumsum(n) + n, n)])
                row.append(own)
            at, row = np.concatenate(at), np.concatenate(row)
            order = np.argsort(row, kind="stable")
            at, row = at[order], row[order]
            n = np.bincount(row, minlength=len(pick))
            share = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
            z = np.zeros((len(pick), families + 1))
            full = np.flatnonzero(n)
            if len(full):
                z[full] = np.add.reduceat(w[at], offsets(n)[:-1][full], axis=0) * share[full, None]
            z += b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None] * (RATE / (1 + epoch) / len(pick)) * 4
            if len(at):
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                w[at[order][first]] -= np.add.reduceat((p * share[:, None]).astype(np.float32)[row[order]], first, axis=0)
            b -= p.sum(axis=0) * 0.1
    return w, b


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, of = word_hashes([plain(t) for t in texts])
    return word, of[:-1], of[1:]


def train(lines: list[str], seed: int = 11) -> Model:
    """Fit on varied notices and on ``lines`` of the corpus that no template agrees with."""
    rng = np.random.default_rng(seed)
    word, start, end = _windows(lines)
    hits, pairs = pair_hits(word)
    low, high = np.searchsorted(hits, start), np.searchsorted(hits, end - 1)
    clean = [
        k for k in range(len(lines)) if low[k] >= high[k] or agreement(hits[low[k] : high[k]].tolist(), pairs[low[k] : high[k]].tolist())[0] < 0.3
    ]
    lines = [lines[k] for k in clean]
    filler = [w for x in lines[:2000] for w in x.split()]
    lines = [x if rng.random() < 0.3 else " ".join(x.split()[: SIZES[rng.integers(len(SIZES))]]) for x in lines]
    # Prose with the words of notices: a part of the sentences sets the bar and is not trained on.
    prose = [(k, varied(rng, t, filler)) for k, t in enumerate(PROSE) for _ in range(VARIANTS)]
    families = sorted(TEMPLATES)
    rows, y, notice = [], [], []
    for k, f in enumerate(families):
        for i, t in enumerate(TEMPLATES[f]):
            own = [t] + [varied(rng, t, filler) for _ in range(VARIANTS)]
            rows, y, notice = rows + own, y + [k] * len(own), notice + [i] * len(own)
    rows += lines + [t for _, t in prose]
    y, notice = np.array(y + [len(families)] * (len(lines) + len(prose))), np.array(notice + [-1] * (len(lines) + len(prose)))
    word, start, end = _windows(rows)
    none = y == len(families)
    hard = np.zeros(len(y), bool)
    hard[len(y) - len(prose) :] = True
    kept_prose = np.r_[np.zeros(len(y) - len(prose), bool), [k % HELD_PROSE == 0 for k, _ in prose]]
    # Held out: a fifth of the windows without a licence, for both models; one notice of
    # each family that has several, for the one that sets the temperature.
    test = (none & ~hard & (rng.random(len(y)) < 0.2)) | kept_prose
    several = np.isin(y, [k for k, f in enumerate(families) if len(TEMPLATES[f]) > 2])
    apart = several & (notice == 1)
    mine = ~test & ~apart
    model = Model(families, *_fit(len(families), word, start[mine], end[mine], y[mine], rng))
    seen = test | apart
    z, own = model.logits(word, start[seen], end[seen]), y[seen]

    def loss(heat: float) -> float:
        s = z / heat
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(own)), own]).mean())

    heat = float(min(np.geomspace(0.2, 10, 40), key=loss))
    model = Model(families, *_fit(len(families), word, start[~test], end[~test], y[~test], rng), heat)
    bars = [LOWEST]
    for some, share in ((test & ~hard, FALSE_CLAIMS), (kept_prose, FALSE_PROSE)):
        if some.any():
            claimed = 1 - model.softmax(model.logits(word, start[some], end[some]))[:, -1]
            bars.append(float(np.quantile(claimed, 1 - share)))
    model.least = min(max(bars), HIGHEST)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train with at most ``sample`` windows, drawn by a hash over whole texts of rows that a hash draws."""
    text = F.col("text").cast("string")
    own = docs.where(text.isNotNull() & (F.length(text) > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = max(1, own.count())
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("rows")), F.lit(1 << 20)) < min(1 << 20, ((sample // 4) << 20) // n + 1)
    parts = own.where(drawn).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{EXAMPLE}}}"), F.lit(0))).alias("place", "line"))
    rows = parts.orderBy(F.xxhash64("doc_id", "place", "line"), "line").limit(sample).select("line").collect()
    return train(sorted(r["line"] for r in rows))


# -- scans -----------------------------------------------------------------------


def windows(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over each part's words ``of[i]:of[i + 1]``."""
    starts, ends, before = [], [], 0
    for size in SIZES:
        n, step = np.diff(of), max(1, size // 4)
        count = np.where(n > before, np.maximum(1, -(-(n - size) // step) + 1), 0)
        part = np.repeat(np.arange(len(n)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a = of[:-1][part] + nth * step
        starts.append(a)
        ends.append(np.minimum(a + size, of[1:][part]))
        before = size
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((b, a))
    return a[order], b[order]


def claims(model: Model, word: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, family number, score) of the windows that the model claims; words are scored in blocks."""
    a, b = windows(of)
    out = []
    for w0 in range(0, len(word), BLOCK):
        i, j = np.searchsorted(a, (w0, w0 + BLOCK))
        if i == j:
            continue
        z = model.logits(word[w0 : w0 + BLOCK + SIZES[-1] + GRAMS], a[i:j] - w0, b[i:j] - w0) / model.heat
        top = z[:, :-1].max(axis=1)
        # the share of the class without a licence, from the other classes' logits
        score = 1 - 1 / (1 + np.exp(np.minimum(z[:, :-1] - z[:, -1:], 60)).sum(axis=1))
        own = np.flatnonzero((score >= model.least) & (top > -np.inf))
        out.append((a[i:j][own], b[i:j][own], z[own, :-1].argmax(axis=1), score[own]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FOUND = "doc_id long, line int, lines int, start long, end long, family string, score double, agreement double, notice_start long, notice_end long"


def _decided(model: Model, claimed, hits: np.ndarray, pairs: np.ndarray, part: tuple[int, int], named) -> list[tuple[int, int, str, float, float]]:
    """(first word, end word, family, score, agreement) of the notices of one paragraph's claims."""
    a, b, family, score = claimed
    low, high = part
    taken: list[tuple[int, int]] = []
    out = []

    def free(x: int, y: int) -> bool:
        at = bisect.bisect(taken, (x, y))
        return not ((at and taken[at - 1][1] > x) or (at < len(taken) and taken[at][0] < y))

    def near(x: int, y: int) -> tuple[list[int], list[int]]:
        i, j = np.searchsorted(hits, (x, y - 1))
        return hits[i:j].tolist(), pairs[i:j].tolist()

    # A claim that its family's template agrees more with comes first: parts of a notice may read like another one.
    confirmed, left = [], []
    for x, y, k, s in zip(a.tolist(), b.tolist(), family.tolist(), score.tolist(), strict=True):
        f, room = model.families[k], max(y - x, SIZES[0])
        agreed, first, last = agreement(*near(max(low, x - room), min(high, y + room)), f)
        if f != UNKNOWN and agreed >= CONFIRM:
            confirmed.append((-agreed, -s, first, last + 1, f))
        left.append((x, y, s))
    for agreed, s, first, last, f in sorted(confirmed):
        if free(first, last):
            bisect.insort(taken, (first, last))
            out.append((first, last, f, -s, -agreed))
    runs: list[list] = []
    for x, y, s in sorted(r for r in left if free(r[0], r[1])):
        if runs and x < runs[-1][1]:
            runs[-1][1], runs[-1][2] = max(runs[-1][1], y), max(runs[-1][2], s)
        else:
            runs.append([x, y, s])
    for x, y, s in runs:
        agreed, first, last = agreement(*near(x, y))
        if agreed >= UNSURE:
            out.append((first, last + 1, UNKNOWN, s, agreed))
        elif named(x, y):
            out.append((x, y, UNKNOWN, s, agreed))
    return sorted(out)


def findings(model: Model, texts: list[str]) -> list[list[tuple]]:
    """For each text its notices: first line, lines, line span, family, score, agreement and own span, in code points."""
    lists = [t.split("\n") for t in texts]
    flat = [plain(x) for xs in lists for x in xs]
    word, of_line = word_hashes(flat)
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(word):
        return out
    n = np.diff(of_line)
    off = offsets([len(xs) for xs in lists])
    text_of = np.repeat(np.arange(len(lists)), np.diff(off))
    edge = (n == 0) | (np.diff(text_of, prepend=-1) != 0)
    of = np.r_[np.unique(of_line[:-1][edge]), len(word)]
    of = np.unique(np.r_[0, of])
    claimed = claims(model, word, of)
    if not len(claimed[0]):
        return out
    hits, pairs = pair_hits(word)
    inner = np.searchsorted(of, hits, "right") == np.searchsorted(of, hits + 1, "right")
    hits, pairs = hits[inner], pairs[inner]
    part = np.searchsorted(of, claimed[0], "right") - 1
    line_of = np.repeat(np.arange(len(flat)), n)
    spans: dict[int, tuple[list[tuple[int, int]], np.ndarray]] = {}

    def line_words(i: int) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The bytes of each of the line's words, and the code points before each of its bytes."""
        if i not in spans:
            begun = np.frombuffer(lists[text_of[i]][i - off[text_of[i]]].encode("utf-8", "surrogatepass"), np.uint8) & 0xC0 != 0x80
            spans[i] = ([m.span() for m in WORD.finditer(flat[i])], offsets(begun))
        return spans[i]

    def named(x: int, y: int) -> bool:
        held = []
        for i in range(line_of[x], line_of[y - 1] + 1):
            own = line_words(i)[0][max(0, x - of_line[i]) : max(0, y - of_line[i])]
            held += [flat[i][p:q] for p, q in own]
        return NAMES_ONE.search(b" ".join(held)) is not None

    bounds = np.flatnonzero(np.diff(part, prepend=-1))
    for low, high in zip(bounds, [*bounds[1:], len(part)], strict=True):
        k = part[low]
        for x, y, family, score, agreed in _decided(model, tuple(c[low:high] for c in claimed), hits, pairs, (int(of[k]), int(of[k + 1])), named):
            i, j = int(line_of[x]), int(line_of[y - 1])
            (at, before), (end_at, end_before) = line_words(i), line_words(j)
            first, last = int(before[at[x - of_line[i]][0]]), int(end_before[end_at[y - 1 - of_line[j]][1]])
            d = int(text_of[i])
            out[d].append((int(i - off[d]), int(j - off[d]), family, score, agreed, first, last))
    for d, rows in enumerate(out):
        if rows:
            starts = offsets([len(x) + 1 for x in lists[d]])
            out[d] = [
                (i, j - i + 1, int(starts[i]), int(starts[j] + len(lists[d][j])), family, score, agreed, int(starts[i] + first), int(starts[j] + last))
                for i, j, family, score, agreed, first, last in sorted(rows)
            ]
    return out


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each finding: its lines and their code points, family and scores, and the notice's own code points."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = [f.split(" ")[0] for f in FOUND.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in text_chunks(texts, 1 << 20):
                rows += [(ids[a + d], *r) for d, found in enumerate(findings(m, texts[a:b])) for r in found]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def licenses(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scan(docs, fit(docs, sample))
