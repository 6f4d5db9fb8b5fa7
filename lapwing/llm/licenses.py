"""Licence scan: paragraphs classified by a sparse word n-gram logistic regression.

Softmax regression over word 1- to 3-grams tells licence families apart, with a class of its own
for text under no licence. Its probabilities are calibrated by a temperature on templates that the
calibrated fit has not seen and on licences of no listed family; below a threshold the answer is
"unknown". A prediction counts once the paragraph holds enough of the word pairs of one of the
family's templates.

A paragraph is a block of lines up to a blank one, its lines joined, so that wrapped and commented
licences are seen whole (marks of comments are no words). Of a block, only lines that are mostly
n-grams of the model are joined, as statements often stand in the midst of other lines; where lines are
sure licences of different families, each is a paragraph of its own.
"""

from __future__ import annotations

import itertools
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import hashed_sample, runs, table

#: How works commonly state their licence, by family.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "This project is licensed under the terms of the MIT license."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "Licensed under the GNU General Public License, version 2."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3."),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced without permission."),
}
#: Statements of licences that are no listed family; they calibrate what is "unknown".
UNLISTED = (
    "Licensed under the Eclipse Public License, Version 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This program is distributed under the terms of the Artistic License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2 only.",
    "The contents of this file are subject to the Common Development and Distribution License.",
    "Do what you want to public license, everyone is permitted to copy and distribute verbatim copies of this license document.",
)
NONE, UNKNOWN = "none", "unknown"
FAMILIES = (NONE, *TEMPLATES)
#: Lines of a block are joined when so much of their words stand in word pairs of the model.
DENSE = 0.5
#: Paragraphs without a licence that the fit uses; noisy copies of each template.
SAMPLE, COPIES = 2000, 24
#: Least calibrated probability, and least share of a template's word pairs, of a confirmed licence.
SURE, SHARED = 0.5, 0.6

_FOLD = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def grams(found: list[bytes]) -> set[bytes]:
    out = set(found)
    out.update(map(b" ".join, zip(found, found[1:], strict=False)))
    out.update(map(b" ".join, zip(found, found[1:], found[2:], strict=False)))
    return out


@dataclass
class LicenseModel:
    index: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def __post_init__(self):
        self.firsts = frozenset(g.partition(b" ")[0] for g in self.index)  # every n-gram of the model begins with one
        self.pairs = [(FAMILIES.index(f), {p for p in zip(w, w[1:], strict=False)}) for f, ts in TEMPLATES.items() for w in [words(t.encode()) for t in ts]]

    def logits(self, found: list[bytes]) -> np.ndarray | None:
        """Of each class; None without any of the model's n-grams."""
        at = [i for g in grams(found) if (i := self.index.get(g)) is not None]
        return self.bias + self.weights[at].sum(axis=0) / np.sqrt(len(at)) if at else None

    def probabilities(self, found: list[bytes]) -> np.ndarray:
        z = self.logits(found)
        return softmax((self.bias if z is None else z)[None] / self.temperature)[0]

    def density(self, found: list[bytes]) -> float:
        """The share of words that stand in a word pair of the model."""
        hits = [b" ".join(p) in self.index for p in zip(found, found[1:], strict=False)]
        return sum(map(max, zip([*hits, False], [False, *hits], strict=True))) / max(1, len(found))

    def template_share(self, found: list[bytes], family: int) -> float:
        """The largest share of a template's word pairs, in a family, that the paragraph holds."""
        own = set(zip(found, found[1:], strict=False))
        return max((len(own & pairs) / len(pairs) for f, pairs in self.pairs if f == family), default=0.0)

    def judged(self, found: list[bytes]) -> tuple[str, float, float, bool] | None:
        """(family or "unknown", probability, template share, confirmed) of a paragraph, None under no licence."""
        if self.firsts.isdisjoint(found) or (z := self.logits(found)) is None:
            return None
        p = softmax(z[None] / self.temperature)[0]
        if p[0] >= 0.5:
            return None
        best = int(p[1:].argmax()) + 1
        share, sure = self.template_share(found, best), p[best] >= SURE
        return FAMILIES[best] if sure else UNKNOWN, round(float(p[best]), 6), round(share, 6), bool(sure and share >= SHARED)

    def paragraphs(self, text: bytes):
        """(line, start, verdict...) of what is under a licence in a text."""
        if self.firsts.isdisjoint(text.translate(_FOLD).split()):
            return
        start, block = 0, []
        for k, line in enumerate(text.split(b"\n")):
            if found := words(line):
                block.append((k, start, found))
            elif block:
                yield from self._block(block)
                block = []
            start += len(line) + 1
        yield from self._block(block)

    def _block(self, block: list):
        if self.firsts.isdisjoint(w for _, _, found in block for w in found):
            return
        block = [(k, start, found, self.judged(found)) for k, start, found in block]
        parts = [block]
        if len({v[0] for *_, v in block if v and v[-1]}) > 1:  # statements of their own: each a part, and what lies between them
            parts = [list(g) for _, g in itertools.groupby(block, lambda r: r[0] if r[3] and r[3][-1] else -1)]
        for part in parts:
            held = [r for r in part if self.density(r[2]) >= DENSE]
            joined = self.judged([w for r in held for w in r[2]]) if len(held) > 1 else None
            if joined and joined[-1]:
                yield *held[0][:2], *joined
            else:
                yield from ((*r[:2], *r[3]) for r in part if r[3])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _noisy(rng: random.Random, template: list[bytes], filler: list[bytes]) -> list[bytes]:
    """A template with words lost and added, and other text before or after."""
    out = [w for w in template if rng.random() > 0.04]
    for _ in range(rng.randint(0, 2)):
        out.insert(rng.randint(0, len(out)), rng.choice(filler))
    before = [rng.choice(filler) for _ in range(rng.choice([0, 0, 3, 12]))]
    after = [rng.choice(filler) for _ in range(rng.choice([0, 0, 3, 12]))]
    return before + out + after


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    m, v = np.zeros((x.shape[1] + 1, classes)), np.zeros((x.shape[1] + 1, classes))
    weight = (1 / np.bincount(y, minlength=classes).clip(1))[y]
    weight[y == 0] *= 8  # most text is under no licence
    weight /= weight.sum()
    for i in range(1, rounds + 1):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        g = np.vstack([x.T @ p + l2 * w, p.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> LicenseModel:
    """Fits on noisy copies of the templates and on the lines of at most ``sample`` / 4 different documents, chosen by hash.

    A first fit leaves out the last template of each family that has several; the temperature is that at which it
    is least surprised by the templates left out, by held-out lines of no licence, and by unlisted
    licences being of no family. The model itself is fitted on all templates.
    """
    rng = random.Random(5)
    shared = [{p for p in zip(w, w[1:], strict=False)} for ts in TEMPLATES.values() for w in [words(t.encode()) for t in ts]]
    other = [w for t in hashed_sample(docs, text_col, sample // 4) for line in t.encode().split(b"\n") if (w := words(line))]
    other = [w for w in other if all(len(s & set(zip(w, w[1:], strict=False))) < 0.5 * len(s) for s in shared)]
    rng.shuffle(other)
    other, held_out = other[:sample], other[sample : sample + sample // 4] or other[: sample // 4]
    filler = [x for w in other for x in w] or [b"and", b"the", b"of"]
    legal = [w for ts in TEMPLATES.values() for t in ts for w in words(t.encode())]
    none = other + [[rng.choice(legal) for _ in range(rng.randint(2, 12))] for _ in range(200)]  # legal words in no order are no licence
    lines = Counter(g for w in other for g in set(w))
    known = set().union(*[grams(words(t.encode())) for ts in TEMPLATES.values() for t in ts])
    index = {g: i for i, g in enumerate(sorted(g for g in known if b" " in g or lines[g] <= 0.01 * len(other)))}
    copies = lambda t: [t, *[_noisy(rng, t, filler) for _ in range(COPIES)]]
    by_template = [(k, j == len(ts) - 1 and j > 0, copies(words(t.encode()))) for k, ts in enumerate(TEMPLATES.values(), 1) for j, t in enumerate(ts)]

    def fitted(left_out: bool) -> LicenseModel:
        rows = [(w, k) for k, last, ws in by_template if not (last and left_out) for w in ws] + [(w, 0) for w in none]
        x = np.zeros((len(rows), len(index)))
        for i, (w, _) in enumerate(rows):
            at = [index[g] for g in grams(w) if g in index]
            x[i, at] = 1 / np.sqrt(max(1, len(at)))
        return LicenseModel(index, *_softmax_fit(x, np.array([k for _, k in rows]), len(FAMILIES)), 1.0)

    trial = fitted(True)
    logits = lambda ws: np.array([trial.bias if (z := trial.logits(w)) is None else z for w in ws]).reshape(-1, len(FAMILIES))
    unseen = [(k, logits(ws)) for k, last, ws in by_template if last]
    strange, plain = logits([w for t in UNLISTED for w in copies(words(t.encode()))]), logits(held_out)

    def surprise(temperature: float) -> float:
        seen = [-np.log(softmax(z / temperature)[:, k] + 1e-12).mean() for k, z in unseen]
        doubt = -np.log(1 - softmax(strange / temperature)[:, 1:].max(axis=1) + 1e-12).mean()
        calm = -np.log(softmax(plain / temperature)[:, 0] + 1e-12).mean() if len(plain) else 0.0
        return float(np.mean(seen) + doubt + calm)

    model = fitted(False)
    model.temperature = min(np.geomspace(0.05, 5, 40).tolist(), key=surprise)
    return model


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph that the model sees under a licence or cannot place:
    ``id_col``, paragraph, start (byte), family, probability, template_share, confirmed.

    ``paragraph`` is the number of the line that it begins with. ``family`` is "unknown" where
    a licence is likelier than none but no family is sure enough. Every line of every text is looked
    at. Null and empty texts give no rows, repeated rows repeat theirs, null ids are kept, extra
    columns are ignored, an empty table gives no rows.
    """

    def find(batches):
        for batch in batches:
            rows: list[tuple] = []
            for at, texts in runs(batch.column(1)):
                rows += [(i, *found) for i, text in enumerate(texts, at) for found in model.paragraphs(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]], names=["id", "paragraph", "start", "family", "probability", "template_share", "confirmed"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, paragraph int, start long, family string, probability double, template_share double, confirmed boolean")
    return out.withColumnRenamed("id", id_col)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
