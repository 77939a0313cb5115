r"""Licence scans: a trained paragraph classifier with template confirmation.

Paragraphs (maximal runs of non-empty lines) and each of their lines become sparse vectors over the
word 1- to 3-grams of the training notices; words are lower-case runs of letters, digits and dots.
Multinomial logistic regression, trained here on variants of the notices and on paragraphs without
licences, predicts a family, ``unknown`` or ``none``. ``unknown`` is a class of its own: it learns
from notices of other licences and from notices whose name is made up. Probabilities are calibrated
by a temperature fitted on held-out variants. Units that are a licence with less than ``least`` are
passed over, and a family below ``least`` counts as ``unknown``. A prediction is confirmed where the share of its best template's n-grams that the paragraph holds, in
any order, reaches ``overlap``.

Every paragraph and line of every text is scored, a batch at a time: words outside the vocabulary
end n-grams, the others' numbers make up the keys of n-grams, and each unit's weights are summed.

Edge cases: null and empty texts have no finding; repeated rows have equal results; an empty table
gives an empty result; a text of one long line is one unit of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import arrow_batch, map_texts, text_slices, with_fields

#: Public notices of licence families, fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License 2.0",
        "Available under the terms of the Apache 2.0 license.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "BSD License",
    ],
    "CC-BY": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "CC BY 4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "CC BY-NC 4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "CC BY-SA 4.0",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "Distributed under the GNU GPL v3.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the GNU LGPL.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without written permission of the copyright holder.",
    ],
}
#: Public notices of other licences, fixed values: examples of ``unknown``.
OTHERS = [
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the EUPL.",
    "ISC License",
    "Distributed under the Boost Software License, Version 1.0.",
    "This file is in the public domain.",
    "Released under the terms of the Eclipse Public License v2.0.",
    "Released under the zlib License.",
    "This is free and unencumbered software released into the public domain.",
    "Licensed under the Artistic License 2.0.",
    "Licensed under the Common Development and Distribution License.",
]
#: Forms of a notice whose name is made up, fixed values.
FORMS = [
    "Licensed under the {} License.",
    "Licensed under the {} License, version {}.",
    "Released under the {} License.",
    "Distributed under the terms of the {} Public License, version {}.",
    "Available under the {} license.",
    "{} License",
    "Licensed under {} {}.",
]
#: Plain sentences that share words with the notices but grant nothing, fixed values.
BACKGROUND = [
    "He was granted permission to use the source of the river for any purpose.",
    "The general public may not use this file or copy a part of the work.",
    "A driver needs a license to drive, and a version of the rules applies.",
    "The software is free and open, and the library is open to the public in general.",
    "Under the terms of the contract any person may modify the conditions of use.",
    "The Apache people lived in the south. The MIT campus is in Cambridge.",
    "Any later version of the story was published by the common press.",
    "It is the work of a creative person with a common attribution to the foundation.",
    "What is the warranty for this program and who published the new version?",
    "The binary source was released under pressure, without restriction or notice.",
]
_word = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def grams(text: str) -> set[str]:
    w = _word.findall(text.lower())
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def units_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each non-empty line, and of each paragraph of several lines."""
    out, at, start, lines = [], 0, 0, 0
    for line in [*text.split("\n"), ""]:
        if line:
            start = start if lines else at
            out.append((at, at + len(line)))
            lines += 1
        else:
            if lines > 1:
                out.append((start, at - 1))
            lines = 0
        at += len(line) + 1
    return out


class Model:
    """Weights over the notices' n-grams."""

    def __init__(self, seed: int = 5, variants: int = 30, rounds: int = 300, penalty: float = 1e-3, leave: str | None = None):
        """``leave`` is a family that is left out of training, to see what becomes of its notices."""
        rng = np.random.default_rng(seed)
        own = {f: TEMPLATES[f] for f in sorted(TEMPLATES) if f != leave}
        self.families = ["none", "unknown", *own]
        self.templates = [(f, grams(t)) for f, texts in own.items() for t in texts]
        notices = [*[g for _, g in self.templates], *[grams(t) for t in OTHERS], *[grams(f.replace("{}", ".")) for f in FORMS]]
        self.words = {w: i for i, w in enumerate(sorted({w for g in notices for x in g for w in x.split()}))}
        keyed = sorted((len(x.split()), self._key(x.split())) for x in set().union(*notices))
        self.keys = [np.array([k for n, k in keyed if n == m], dtype=np.int64) for m in (1, 2, 3)]
        self.starts = np.cumsum([0, *[len(k) for k in self.keys]])
        texts, labels = [], []
        plain = [w for t in BACKGROUND for w in t.split()]
        made_up = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))

        def add(text: str, family: str) -> None:
            around = list(rng.choice(plain, rng.integers(0, 12)))
            cut = int(rng.integers(0, len(around) + 1))
            texts.append(" ".join([*around[:cut], text, *around[cut:]]))
            labels.append(self.families.index(family))

        for f, notices in [*own.items(), ("unknown", OTHERS)]:
            for t in notices:
                for _ in range(variants):
                    w = t.split()
                    add(" ".join(x for x in w if len(w) < 6 or rng.random() > 0.08), f)
        for form in FORMS:
            for _ in range(2 * variants):
                add(form.format(made_up(), rng.choice(["1.0", "2", made_up()])), "unknown")
        pool = plain + [w for ts in own.values() for t in ts for w in t.split()]
        for _ in range(variants * 24):
            texts.append(" ".join(rng.choice(pool if rng.random() < 0.3 else plain, rng.integers(1, 40))))
            labels.append(0)
        alone = [w for w in self.words for _ in range(4)]  # a notice's word by itself says nothing
        texts += [*BACKGROUND * 5, *alone]
        labels += [0] * (5 * len(BACKGROUND) + len(alone))
        x, y = np.array([self.vector(t) for t in texts]), np.array(labels)
        held = np.arange(len(y)) % 5 == 0
        self.weights, self.bias = np.zeros((x.shape[1], len(self.families))), np.zeros(len(self.families))
        self.temperature = 1.0
        hot, m, v = np.eye(len(self.families))[y], 0.0, 0.0
        for k in range(1, rounds + 1):
            error = (self.probabilities(x[~held]) - hot[~held]) / (~held).sum()
            g = np.vstack([x[~held].T @ error + penalty * self.weights, error.sum(axis=0)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
            self.weights, self.bias = self.weights - move[:-1], self.bias - move[-1]
        losses = {}
        for t in np.geomspace(0.05, 8, 45):
            self.temperature = float(t)
            losses[self.temperature] = -np.log(self.probabilities(x[held])[np.arange(held.sum()), y[held]] + 1e-12).mean()
        self.temperature = min(losses, key=losses.get)
        p = self.probabilities(x[held])
        sure, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        bins = np.minimum((sure * 10).astype(int), 9)
        #: Mean gap of confidence and accuracy over ten bins of the held-out variants.
        self.calibration_error = float(sum(abs(sure[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in set(bins)))

    def _key(self, words: list[str]) -> int:
        out = 0
        for w in words:
            out = out * len(self.words) + self.words[w]
        return out

    def vector(self, text: str) -> np.ndarray:
        """The text's n-grams of the vocabulary, scaled to length 1."""
        out = np.zeros(self.starts[-1])
        for g in grams(text):
            w = g.split()
            if all(x in self.words for x in w):
                key, own = self._key(w), self.keys[len(w) - 1]
                at = int(np.searchsorted(own, key))
                if at < len(own) and own[at] == key:
                    out[self.starts[len(w) - 1] + at] = 1.0
        n = np.sqrt(out.sum())
        return out / n if n else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(x @ self.weights + self.bias)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _scores(self, texts: list[str], units: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (over all texts) of the units with some n-gram of the vocabulary, and their probabilities."""
        ids, owner, known, number = [], [], self.words, 0
        for text, spans in zip(texts, units, strict=True):
            for a, b in spans:
                found = [known.get(w, -1) for w in _word.findall(text[a:b].lower())]
                ids += found
                owner += [number] * len(found)
                number += 1
        word, unit = np.array(ids, dtype=np.int64), np.array(owner, dtype=np.int64)
        pairs, key, ok = [], word, word >= 0
        for n, keys in enumerate(self.keys):
            if n:
                key = key[:-1] * len(known) + word[n:]
                ok = ok[:-1] & (word[n:] >= 0) & (unit[: len(word) - n] == unit[n:])
            own, of = key[ok], unit[: len(word) - n][ok]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            pairs.append(of[hit] * self.starts[-1] + self.starts[n] + at[hit])
        both = np.unique(np.concatenate(pairs))
        of, feature = both // self.starts[-1], both % self.starts[-1]
        named, first, count = np.unique(of, return_index=True, return_counts=True)
        if not len(named):
            return named, np.zeros((0, len(self.families)))
        sums = np.add.reduceat(self.weights[feature], first, axis=0)
        return named, self._softmax(sums / np.sqrt(count)[:, None] + self.bias)

    def findings(self, texts: list[str], least: float, overlap: float) -> list[list[dict]]:
        """The findings of each text."""
        units = [units_of(t) for t in texts]
        named, p = self._scores(texts, units)
        ends = np.cumsum([len(u) for u in units])
        out: list[list[dict]] = [[] for _ in texts]
        best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=int)
        for i in np.flatnonzero((best > 0) & (1 - p[:, 0] >= least)) if len(p) else ():
            t = int(np.searchsorted(ends, named[i], side="right"))
            start, end = units[t][int(named[i] - (ends[t] - len(units[t])))]
            out[t].append(self._finding(texts[t], start, end, int(best[i]), float(p[i, best[i]]), least, overlap))
        # a paragraph gives way to a line of it that says the same
        inside = lambda f, g: g is not f and g["family"] == f["family"] and f["start"] <= g["start"] and g["end"] <= f["end"]
        return [sorted((f for f in own if not any(inside(f, g) for g in own)), key=lambda f: (f["start"], f["end"])) for own in out]

    def _finding(self, text: str, start: int, end: int, best: int, p: float, least: float, overlap: float) -> dict:
        family = self.families[best] if p >= least else "unknown"
        own = grams(text[start:end])
        share = max((len(t & own) / len(t) for f, t in self.templates if f == family), default=0.0)
        return {"family": family, "start": start, "end": end, "probability": round(p, 6), "confirmed": share >= overlap}


def scan(docs: DataFrame, keep: list[str], text: str = "text", least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """``keep`` and ``findings``: family, start and end in code points, probability, confirmed."""
    sent = docs.sparkSession.sparkContext.broadcast(Model())
    kind = "array<struct<family:string,start:int,end:int,probability:double,confirmed:boolean>>"
    schema = with_fields(docs, keep, findings=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))
        for batch in batches:
            for part in text_slices(batch, text):
                found = sent.value.findings([x or "" for x in part.column(text).to_pylist()], least, overlap)
                yield arrow_batch(part, keep, findings=pa.array(found, t))

    return map_texts(docs.select(*dict.fromkeys([*keep, text])), run, schema)


def op5_licences(spark, sf_dir: str) -> DataFrame:
    """Per document its findings and the families that a template confirms."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select(
        "doc_id",
        F.size("findings").alias("n_findings"),
        F.expr("array_join(array_sort(array_distinct(transform(filter(findings, x -> x.confirmed), x -> x.family))), ',')").alias("licences"),
        F.expr("array_join(transform(findings, x -> concat(x.family, ':', x.start, ':', x.end)), ',')").alias("spans"),
    )
