"""Licence scans by a trained paragraph classifier.

Lines (long ones in overlapping windows) are counted as paragraphs; notices wrapped over the lines of a block, which
blank lines end, and several notices of a line are found as spans that share half of a template's trigrams. An entry
belongs to the line it begins in; only overlapping entries of one family are merged. Windows and spans are told apart by a multinomial logistic regression over word
1- to 3-grams of the licence notices that it knows. It is trained on those notices, varied with fixed seeds, against
ordinary sentences and notices of no known family. A prediction needs a probability over a calibrated threshold, or
the paragraph's class is unknown; and a template of the predicted family must confirm it by shared trigrams. The threshold
is the one that best parts what the classifier gives to right families from what it gives to notices of families that it was
trained without, over ``FOLDS`` folds of the families. What is no known notice is of an unknown one, or is ordinary text, by a
second threshold on the probability of ordinary text, calibrated over the same folds; and a notice speaks of licence or
copyright, as by the threshold alone 52 windows of ten thousand ordinary texts would be unknown notices.

Null and empty texts have no paragraph. Ties go to the family first in the list; repeated rows scan alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, STRIDE, CONFIRM, FOLDS, ORDINARY = 64, 32, 0.5, 3, 50
#: Notices of each family, as publicly used; fixed values.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under MIT.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under Apache 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "under the GPL version 3 or (at your option) any later version.", "Licensed under GPLv3.", "Licensed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "under the GPL version 2 or (at your option) any later version.", "Licensed under GPLv2.", "Licensed under the GPL v2.", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the LGPL v2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC0": ["Released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."],
}
FAMILIES = list(TEMPLATES)
NONE, UNKNOWN = "none", "unknown"
#: Notices of families that aren't known.
STRANGE = ["Licensed under the Foo Public License, version 7.", "This work is licensed under the Open Widget License 1.1.", "Released under the Sample Community License.", "Subject to the terms of the Example Shared Source Agreement, revision B.", "SPDX-License-Identifier: Zorp-1.0", "Licensed under Frobnicate 3."]
_PLAIN = "the of and to in a is that it was for on are as with his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find free work public version general program software under terms license source code".split()


_APART = str.maketrans({c: " " for c in ".,;:()[]{}<>\"'`!?*#$%&|/\\=+~^@"})


def words_of(text: str) -> list[str]:
    """Lower-cased words; the head of a short identifier line is three of them."""
    return text.lower().replace("spdx-license-identifier", "spdx license identifier").translate(_APART).split()


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def _trigrams(words: list[str]) -> set[str]:
    n = min(3, len(words))
    return {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


@dataclass
class Scanner:
    vocabulary: dict[str, int]
    known: set[str]
    weights: np.ndarray
    threshold: float
    #: Below this probability of ordinary text, what is no known notice is an unknown one.
    doubt: float
    templates: dict[str, list[set[str]]]

    def __post_init__(self):
        #: The templates, as family and number, that have a trigram.
        self.places: dict[str, list[tuple[str, int]]] = {}
        for family, sets in self.templates.items():
            for i, grams_of in enumerate(sets):
                for g in grams_of:
                    self.places.setdefault(g, []).append((family, i))

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in set(grams(words)) if g in self.vocabulary]
        z = self.weights[-1].copy()
        if at:
            z += self.weights[at].sum(axis=0) / len(at) ** 0.5
        z = np.exp(z - z.max())
        return z / z.sum()

    def classify(self, words: list[str]) -> tuple[str, float]:
        """Family, ``unknown`` or ``none``, and its probability."""
        if len(words) < 3 or sum(w in self.known for w in words) < 3:
            return NONE, 1.0
        p = self.probabilities(words)
        k = int(p.argmax())
        if k == len(FAMILIES):
            return NONE, float(p[k])
        own = _trigrams(words)
        if k < len(FAMILIES) and p[k] >= self.threshold and any(len(t & own) >= CONFIRM * len(t) for t in self.templates[FAMILIES[k]]):
            return FAMILIES[k], float(p[k])
        mentions = any(w.startswith(("licens", "licenc", "copyright")) for w in words)
        return (UNKNOWN, float(p[k])) if mentions and p[len(FAMILIES)] < self.doubt else (NONE, float(p[len(FAMILIES)]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, float]]]:
        """How many paragraphs, and (paragraph, class, probability) of each notice."""
        found, n, block = [], 0, []
        for k, line in enumerate([*(text or "").split("\n"), ""]):
            if words := words_of(line):
                n += 1
                block.append((k, words))
            if not line.strip() and block:
                found += self._scan_block(block)
                block = []
        return n, found

    def _scan_block(self, lines: list[tuple[int, list[str]]]) -> list[tuple[int, str, float]]:
        words = [w for _, ws in lines for w in ws]
        flags = [w in self.known for w in words]
        spans = self._spans(words, flags)
        out, base = [], 0
        starts = []
        for _, ws in lines:
            starts.append(base)
            end = base + len(ws)
            hits = []
            for a in [base] if len(ws) <= WINDOW else range(base, end - WINDOW + STRIDE, STRIDE):
                z = min(a + WINDOW, end)
                if sum(flags[a:z]) >= 3:
                    hits.append((a, z, *self.classify(words[a:z])))
            # a span tells more than a window that it lies in
            sure = [h for h in hits if h[2] not in (NONE, UNKNOWN) and not self._other(h, spans)]
            near = any(a < end and base < z for a, z, *_ in spans)
            out += sure or ([] if near else sorted((h for h in hits if h[2] == UNKNOWN), key=lambda h: -h[3])[:1])
            base = end
        merged: list[list] = []
        for a, z, c, p in sorted(out + spans, key=lambda h: h[:2]):
            last = next((m for m in reversed(merged) if m[2] == c and a < m[1]), None) if c != UNKNOWN else None
            if last:
                last[1], last[3] = max(last[1], z), max(last[3], p)
            else:
                merged.append([a, z, c, p])
        at = np.searchsorted(starts, [m[0] for m in merged], side="right") - 1
        return [(lines[k][0], c, p) for k, (_, _, c, p) in zip(at, merged, strict=True)]

    @staticmethod
    def _other(hit: tuple, spans: list[tuple]) -> bool:
        own = [s for s in spans if s[0] < hit[1] and hit[0] < s[1]]
        return bool(own) and all(s[2] != hit[2] for s in own)

    def _spans(self, words: list[str], flags: list[bool]) -> list[tuple[int, int, str, float]]:
        """(start, end, family, probability) of spans that share half of a template's trigrams; the fullest of those that overlap."""
        at: dict[tuple[str, int], list[int]] = {}
        for k in range(len(words) - 2):
            if flags[k] and flags[k + 1] and flags[k + 2]:
                for t in self.places.get(" ".join(words[k : k + 3]), ()):
                    at.setdefault(t, []).append(k)
        tried = []
        for (family, i), ks in at.items():
            size = len(self.templates[family][i])
            if len(ks) < CONFIRM * size:
                continue
            groups = [[ks[0]]]
            for k in ks[1:]:
                # a new group at a gap, and where the template starts anew
                if k - groups[-1][-1] > size + 2 or k - groups[-1][0] > 2 * (size + 2):
                    groups.append([])
                groups[-1].append(k)
            for g in groups:
                shared = len({" ".join(words[k : k + 3]) for k in g})
                if shared >= CONFIRM * size:
                    tried.append((shared, shared / size, g[0], g[-1] + 3, family))
        kept: list[tuple[int, int, str, float]] = []
        for _, _, a, z, family in sorted(tried, key=lambda t: (-t[0], -t[1], t[2], FAMILIES.index(t[4]))):
            if all(z <= b or y <= a for b, y, *_ in kept):
                c, p = self.classify(words[a:z])
                if c == family:
                    kept.append((a, z, c, p))
        return sorted(kept)


def _varied(rng: random.Random, notice: str) -> list[str]:
    words = words_of(notice)
    words = [w for w in words if rng.random() > 0.04] or words
    head = [rng.choice(_PLAIN) for _ in range(rng.choice((0, 0, 0, 3, 8)))]
    tail = [rng.choice(_PLAIN) for _ in range(rng.choice((0, 0, 0, 3, 8)))]
    return head + words + tail


def train(seed: int = 11, each: int = 60, rounds: int = 300) -> Scanner:
    """The classifier, its threshold calibrated on variations that it wasn't trained on."""
    rng = random.Random(seed)
    vocabulary: dict[str, int] = {}
    for notices in TEMPLATES.values():
        for t in notices:
            for g in grams(words_of(t)):
                vocabulary.setdefault(g, len(vocabulary))
    known = {g for g in vocabulary if " " not in g}

    def examples(n: int) -> list[tuple[list[str], int]]:
        out = [(_varied(rng, rng.choice(TEMPLATES[f])), k) for k, f in enumerate(FAMILIES) for _ in range(n * max(4, len(TEMPLATES[f])) // 4)]
        out += [([rng.choice(_PLAIN) for _ in range(rng.randrange(3, 40))], len(FAMILIES)) for _ in range(6 * n)]
        mixed = sorted(known)
        out += [([rng.choice(mixed) for _ in range(rng.randrange(3, 14))], len(FAMILIES)) for _ in range(3 * n)]
        return out + [(_varied(rng, rng.choice(STRANGE)), len(FAMILIES) + 1) for _ in range(2 * n)]

    def sparse(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of each gram of the vocabulary, and of the constant."""
        at = [sorted({vocabulary[g] for g in grams(words) if g in vocabulary}) for words, _ in rows]
        row = np.repeat(np.arange(len(rows)), [len(a) + 1 for a in at])
        column = np.concatenate([[*a, len(vocabulary)] for a in at]).astype(np.int64)
        value = np.concatenate([[1 / max(1, len(a)) ** 0.5] * len(a) + [1.0] for a in at])
        return row, column, value

    classes = len(FAMILIES) + 2

    def fitted(rows: list[tuple[list[str], int]]) -> Scanner:
        row, column, value = sparse(rows)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        back = np.argsort(column, kind="stable")
        seen = column[back]
        heads = np.flatnonzero(np.diff(seen, prepend=-1))
        hot = np.eye(classes)[[k for _, k in rows]]
        w, speed = np.zeros((len(vocabulary) + 1, classes)), np.zeros((len(vocabulary) + 1, classes))
        for _ in range(rounds):  # gradient descent with momentum on the ridge-penalized likelihood
            z = np.add.reduceat(w[column] * value[:, None], starts)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = np.zeros_like(w)
            slope[seen[heads]] = np.add.reduceat((hot - p)[row[back]] * value[back, None], heads)
            speed = 0.9 * speed + slope / len(rows) - 1e-4 * w
            w += 2.0 * speed
        return Scanner(vocabulary, known, w, 0.0, 0.0, {f: [_trigrams(words_of(t)) for t in notices] for f, notices in TEMPLATES.items()})

    scanner = fitted(examples(each))
    right, wrong, plain, odd = [], [], [], []
    for fold in range(FOLDS):
        strange = lambda k: k % FOLDS == fold and k != len(FAMILIES)  # noqa: B023, E731
        part = fitted([x for x in examples(each // 2) if not strange(x[1])])
        for words, k in examples(each // 4):
            p = part.probabilities(words)
            (plain if k == len(FAMILIES) else odd).append(float(p[len(FAMILIES)]))
            if k == len(FAMILIES):
                continue
            p = p[: len(FAMILIES)]
            if strange(k):
                wrong.append(float(p.max()))
            elif k < len(FAMILIES) and p.argmax() == k:
                right.append(float(p[k]))
    steps = np.unique(np.round([*right, *wrong], 3))
    right, wrong = np.array(right), np.array(wrong)
    scanner.threshold = float(max(steps, key=lambda x: (right >= x).mean() - (wrong >= x).mean()))
    # ordinary text is nearly all there is, so one of it that is called a notice weighs as many notices that are missed
    plain, odd = np.array(plain), np.array(odd)
    scanner.doubt = float(max(np.unique(np.round([*plain, *odd], 3)), key=lambda x: (odd < x).mean() - ORDINARY * (plain < x).mean()))
    return scanner


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, n_unknown, families and spans (paragraph:class) of every whole text."""
    scanner = scanner or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for x in part.column(1):
                    n, found = scanner.scan(x.as_py())
                    families = sorted({c for _, c, _ in found if c != UNKNOWN})
                    out.append((n, sum(c != UNKNOWN for _, c, _ in found), sum(c == UNKNOWN for _, c, _ in found), ",".join(families), ",".join(f"{k}:{c}" for k, c, _ in found)))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_paragraphs", "n_licensed", "n_unknown", "families", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_paragraphs long, n_licensed long, n_unknown long, families string, spans string")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
