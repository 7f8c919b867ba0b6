"""Licence scans: a trained paragraph classifier, confirmed by templates.

Every line of a text is a paragraph.  A multinomial logistic regression over
sparse word 1- and 2-grams gives each licence family and "unknown" a
probability.  It is trained on the templates, whole and with words left out,
against paragraphs that are no licence and notices of licences that are not
listed; probabilities are calibrated by a temperature that is fitted on
templates, sentences and unlisted notices that took no part in the training.  A
predicted family counts only if the paragraph also resembles one of its
templates (shared word 2-grams) and has a 2-gram of no other family.  Besides the whole paragraph, every stretch of it that resembles a
template is classified alone, so words around a notice don't hide it, and a
paragraph can hold notices of several families.

Null and empty texts have no paragraph.  Paragraphs without a known word are
unknown.  Null ids stay; rows that repeat an id are scanned one by one; an
empty table gives no rows; other columns are ignored, whatever their names.  Of
stretches that overlap and resemble their templates equally the shorter counts,
then the first.  A text of over 1 MB is a chunk of its own.  Words are told by
64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyrook.llm import base, textvec

UNKNOWN = "unknown"

# Short notices by which public licences are declared.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Public-Domain": ["This work is in the public domain.", "This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright, all rights reserved. Unauthorized copying is strictly prohibited."],
}

# Registered short identifiers by family, and the word before them.
IDENTIFIERS = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "LGPL": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later", "AGPL": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later",
    "BSD": "BSD-2-Clause BSD-3-Clause", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "CC-BY": "CC-BY-4.0", "CC-BY-SA": "CC-BY-SA-4.0", "CC-BY-NC": "CC-BY-NC-4.0",
    "CC0": "CC0-1.0", "Public-Domain": "Unlicense",
}
for _name, _ids in IDENTIFIERS.items():
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {i}" for i in _ids.split()]

# Notices of licences that are not listed.
UNLISTED = [
    "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the European Union Public Licence, version 1.2.", "Distributed under the Boost Software License, Version 1.0.",
    "Released under the zlib License.", "Licensed under the Artistic License, version 2.0.", "This work is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Common Development and Distribution License, version 1.0.", "Released under the Python Software Foundation License, version 2.", "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the Open Software License, version 3.0.", "This file is subject to the terms of the Microsoft Public License.", "Released under the PostgreSQL License.", "SPDX-License-Identifier: Zlib",
]

# Sentences that share words with licences but are none.
PLAIN = [
    "The driver showed the licence to the officer and went on.", "Version 2.0 of the report was released in May.", "The public was free to copy the work of the school.",
    "A general permission is needed to use the hall.", "The software is under construction in this version.", "International attribution of the work is open.",
    "The terms of the contract were granted by the person.", "This is a source of binary data and other forms.", "Common creative work is done in the lab.",
    "That and the of to in is it was for with by on be are as at this from a", "Copies of this file are kept for any purpose.", "The foundation published free books.",
    "He was licensed to drive under the law.", "All reserved seats are on the right.", "The license plate was 4.0 inches wide.",
]

GAP = np.ones(256, bool)
GAP[0x30:0x3A] = False
GAP[0x61:0x7B] = False
GAP[0x80:] = False
GAP[0x2D] = False  # a hyphen joins
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
#: Share of a paragraph's or template's 2-grams that must be common.
CONFIRM = 0.6
#: A template's words may spread over so many times its length.
STRETCH = 1.5
#: Calibrated probability of a family, also above that of unknown, from which a
#: paragraph is predicted to be of it.
SURE = 0.3


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\-\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    starts, ends, _ = textvec.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), textvec.SPACE)
    with np.errstate(over="ignore"):
        return textvec.span_hashes(np.frombuffer(data, np.uint8), starts, ends)


@dataclass
class Model:
    names: list[str]  # the last is UNKNOWN
    unigrams: textvec.Lookup
    features: textvec.Lookup
    weights: np.ndarray  # feature, class
    bias: np.ndarray
    temperature: float
    template_grams: list[list[np.ndarray]]
    grams: textvec.Lookup  # of all templates
    templates: list[tuple[int, int, np.ndarray]]  # family, words, whether each of `grams` is in it
    special: np.ndarray  # the family that alone has a gram, -1 where several do


def _features(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([h, textvec.window_hashes(h, 2)])


def _examples(seed: int) -> list[tuple[list[str], str, int]]:
    """(words, class, source); examples of one source stem from one text."""
    rng = np.random.default_rng(seed)
    out: list[tuple[list[str], str, int]] = []
    texts = [(n, t) for n, own in TEMPLATES.items() for t in own] + [(UNKNOWN, t) for t in PLAIN + UNLISTED]
    for source, (name, t) in enumerate(texts):
        words = _words(t)
        out.append((words, name, source))
        for _ in range(16):
            keep = [w for w in words if rng.random() > 0.12]
            if len(keep) >= max(2, len(words) // 2):
                out.append((keep, name, source))
    everything = sorted({w for n, t in texts if n != UNKNOWN for w in _words(t)})
    for k in range(400):  # template words in no order
        out.append(([everything[i] for i in rng.integers(0, len(everything), rng.integers(1, 12))], UNKNOWN, len(texts) + k))
    return out


#: Parts that the sources are dealt to for calibration.
PARTS = 3


def _fitted(rows: np.ndarray, columns: np.ndarray, n: int, y: np.ndarray, n_features: int, n_classes: int, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a logistic regression over sparse rows, by gradient
    steps with momentum; only a row's own features are touched."""
    w, b = np.zeros((n_features, n_classes)), np.zeros(n_classes)
    vw, vb, target = np.zeros_like(w), np.zeros_like(b), np.eye(n_classes)[y]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    has = rows[first]
    by = np.argsort(columns, kind="stable")
    start = np.flatnonzero(np.diff(columns[by], prepend=-1))
    used = columns[by][start]
    for _ in range(steps):
        z = np.tile(b, (n, 1))
        z[has] += np.add.reduceat(w[columns], first)
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - target) / n
        vw *= 0.9
        vw[used] -= np.add.reduceat(g[rows[by]], start)
        vw -= ridge * w
        vb = 0.9 * vb - g.sum(0)
        w += vw
        b += vb
    return w, b


@lru_cache(maxsize=2)
def train(seed: int = 17, steps: int = 150, ridge: float = 2e-4) -> Model:
    names = [*TEMPLATES, UNKNOWN]
    examples = _examples(seed)
    grams = [np.unique(_features(_hashes(w))) for w, _, _ in examples]
    y = np.array([names.index(n) for _, n, _ in examples])
    part = np.array([s for _, _, s in examples]) % PARTS
    features = textvec.Lookup(np.concatenate(grams))
    unigrams = textvec.Lookup(np.concatenate([_hashes(w) for w, _, _ in examples]))
    index = [features(g) for g in grams]

    def fitted(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = np.flatnonzero(use)
        sizes = [len(index[k]) for k in chosen]
        return _fitted(np.repeat(np.arange(len(chosen)), sizes), np.concatenate([index[k] for k in chosen]), len(chosen), y[chosen], len(features.keys), len(names), steps, ridge)

    held_z, held_y = [], []
    for k in range(PARTS):  # calibration on sources that took no part in the fit
        w, b = fitted(part != k)
        for i in np.flatnonzero(part == k).tolist():
            held_z.append(w[index[i]].sum(0) + b)
            held_y.append(y[i])
    z, own = np.array(held_z), np.array(held_y)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.2, 8.0, 50):
        q = z / t
        loss = -(q[np.arange(len(q)), own] - np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) - q.max(1)).mean()
        if loss < best:
            best, temperature = loss, float(t)
    w, b = fitted(part >= 0)
    with np.errstate(over="ignore"):
        templates = [[np.unique(textvec.window_hashes(_hashes(_words(t)), 2)) for t in TEMPLATES[n]] for n in names[:-1]]
    all_grams = textvec.Lookup(np.concatenate([g for mine in templates for g in mine]))
    flat = [(k, len(_words(t)), g) for k, n in enumerate(names[:-1]) for t, g in zip(TEMPLATES[n], templates[k], strict=True)]
    member = [(k, words, np.isin(np.arange(len(all_grams.keys)), all_grams(g))) for k, words, g in flat]
    families = np.array([np.any([m for f, _, m in member if f == k], axis=0) for k in range(len(names) - 1)])
    special = np.where(families.sum(0) == 1, families.argmax(0), -1)
    return Model(names, unigrams, features, w.astype(np.float32), b.astype(np.float32), temperature, templates, all_grams, member, special)


def _probabilities(row: np.ndarray, feature: np.ndarray, n: int, m: Model) -> np.ndarray:
    """Class probabilities of n rows that have the given features, or -1 for one unknown."""
    found = feature >= 0
    key = np.unique(row[found].astype(np.int64) * len(m.features.keys) + feature[found])
    row, column = key // len(m.features.keys), key % len(m.features.keys)
    z = np.tile(m.bias, (n, 1))
    np.add.at(z, row, m.weights[column])
    z = z / m.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _stretches(h: np.ndarray, line: np.ndarray, pair: np.ndarray, inside: np.ndarray, m: Model) -> list[tuple[int, int, int, float]]:
    """(first word, end, family, probability) of stretches inside a line that
    share enough 2-grams with a template of the family they are classified as;
    of those that overlap, the one with the largest share of its template."""
    gram = np.where(inside, m.grams(pair), -1)
    at = np.flatnonzero(gram >= 0)
    gram = gram[at]
    spans: dict[tuple[int, int, int], float] = {}  # to the share of the template
    for family, words, member in m.templates:
        mine = member[gram]
        pos, own = at[mine], gram[mine]
        need = int(np.ceil(CONFIRM * member.sum() - 1e-9))
        # a line's words are consecutive, so its end bounds a stretch too
        last = np.minimum(pos + int(words * STRETCH), np.searchsorted(line, line[pos], "right"))
        stop = np.searchsorted(pos + 1, last, "left")
        for i in np.flatnonzero(stop - np.arange(len(pos)) >= need).tolist():
            j = int(stop[i])
            new = np.unique(own[i:j], return_index=True)[1]  # a repeated 2-gram adds nothing
            if len(new) >= need:
                key = int(pos[i]), int(pos[i + new.max()]) + 2, family
                spans[key] = max(spans.get(key, 0.0), len(new) / int(member.sum()))
    if not spans:
        return []
    found = np.array(sorted(spans), np.int64)
    begin, n = found[:, 0], found[:, 1] - found[:, 0]
    row = np.repeat(np.arange(len(n)), n)
    word = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
    first = word[1:][row[1:] == row[:-1]] - 1
    p = _probabilities(np.concatenate([row, row[1:][row[1:] == row[:-1]]]), np.concatenate([m.features(h[word]), m.features(pair[first])]), len(n), m)
    p = np.where(p[np.arange(len(n)), found[:, 2]] > p[:, -1], p[np.arange(len(n)), found[:, 2]], 0.0)
    out: list[tuple[int, int, int, float]] = []
    sure = [(a, b, f, q) for (a, b, f), q in zip(found.tolist(), p.tolist(), strict=True) if q >= SURE]
    group: list[tuple[int, int, int, float]] = []
    reach = 0
    for s in [*sure, (len(h) + 1, len(h) + 1, -1, 0.0)]:
        if group and s[0] >= reach:
            taken: list[tuple[int, int, int, float]] = []
            for g in sorted(group, key=lambda g: (-spans[g[:3]], g[1] - g[0], g[0])):
                if all(g[1] <= t[0] or g[0] >= t[1] for t in taken):
                    taken.append(g)
            out += sorted(taken)
            group = []
        group.append(s)
        reach = max(reach, s[1])
    return out


def scan_chunk(data: np.ndarray, offsets: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs per document, and of each licence family of a paragraph: its
    document, the paragraph's number in it, the family and its probability."""
    n = len(offsets) - 1
    low = textvec.lower_ascii(data)
    begin, _, first_line = textvec.words(low, offsets, _LINE)
    starts, ends, first = textvec.words(low, offsets, GAP)
    count = np.diff(first_line)
    nothing = np.zeros(0, np.int64)
    if not len(starts):
        return count, nothing, nothing, nothing, np.zeros(0, np.float32)
    h = textvec.span_hashes(low, starts, ends)
    line = np.searchsorted(begin, starts, "right") - 1
    known = m.unigrams(h) >= 0
    hits = np.bincount(line[known], minlength=len(begin))
    # a template's 2-gram has two known words
    use = hits >= 2
    keep = use[line]
    h, line = h[keep], line[keep]
    if not len(h):
        return count, nothing, nothing, nothing, np.zeros(0, np.float32)
    pair = textvec.window_hashes(h, 2)
    inside = line[1:] == line[:-1]
    feature = np.concatenate([m.features(h), m.features(pair[inside])])
    where = np.concatenate([line, line[1:][inside]])
    lines, at = np.unique(where, return_inverse=True)
    p = _probabilities(at, feature, len(lines), m)
    family = p[:, :-1].argmax(1)
    likely = np.flatnonzero((p.argmax(1) != len(m.names) - 1) & (p[np.arange(len(p)), family] >= SURE))
    stretches = _stretches(h, line, pair, inside, m)
    best = {(int(line[start]), f): q for start, _, f, q in reversed(stretches)}
    free = np.ones(len(pair), bool)  # 2-grams outside all stretches
    for start, end, _, _ in stretches:
        free[start : end - 1] = False
    own, owner, free = pair[inside], at[len(h) :], free[inside]
    order = np.argsort(owner, kind="stable")
    own, owner, free = own[order], owner[order], free[order]
    for k in likely.tolist():
        i, j = np.searchsorted(owner, k), np.searchsorted(owner, k, "right")
        n, grams = len(np.unique(own[i:j])), np.unique(own[i:j][free[i:j]])
        # a family that rests on another one's stretch, or on what others share, doesn't count
        if (m.special[m.grams(grams[m.grams(grams) >= 0])] == family[k]).any() and any(len(np.intersect1d(grams, t, True)) >= CONFIRM * max(1, min(n, len(t))) for t in m.template_grams[family[k]]):
            best.setdefault((int(lines[k]), int(family[k])), float(p[k, family[k]]))
    if not best:
        return count, nothing, nothing, nothing, np.zeros(0, np.float32)
    where, of = np.array(sorted(best), np.int64).T
    doc = np.searchsorted(first_line, where, "right") - 1
    return count, doc, where - first_line[doc], of, np.array([best[k] for k in sorted(best)])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_paragraphs, n_licence (paragraphs of a confirmed family),
    families (their names, sorted, comma-joined) and licences (an array of
    paragraph number, family, probability), for every row."""
    base.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train())
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = textvec.text_buffer(batch.column(1))
                for i, j in textvec.chunks(offsets):
                    count, doc, number, family, p = scan_chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], m)
                    found: list[list[dict]] = [[] for _ in range(j - i)]
                    for d, k, f, q in zip(doc.tolist(), number.tolist(), family.tolist(), p.tolist(), strict=True):
                        found[d].append({"paragraph": k, "family": m.names[f], "probability": q})
                    names = [",".join(sorted({x["family"] for x in f})) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array([len({x["paragraph"] for x in f}) for f in found], pa.int64()), pa.array(names), pa.array(found, pa.list_(item))],
                        names=[key, "n_paragraphs", "n_licence", "families", "licences"],
                    )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_paragraphs long, n_licence long, families string, licences array<struct<paragraph:bigint,family:string,probability:double>>")
