"""Licence notices by a paragraph classifier over sparse word n-grams, confirmed by templates."""

from __future__ import annotations

import re
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.sample import least_by_hash

UNKNOWN = "unknown"
#: Wording of the notices of public licence families.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL v3.",
        "Licensed under the GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is available under the terms of the Creative Commons Attribution License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
        "Copyright 2020 Example Corporation. All rights reserved.",
    ],
}
#: Sentences near the subject that are no licence.
OTHERS = [
    "You need a driver's license to rent a car in this country.", "The city may revoke the license of a restaurant after an inspection.",
    "He asked for permission to leave the room and the teacher agreed.", "The warranty of this device covers two years.",
    "Copyright law has changed many times in the last century.", "The general public was not admitted to the court.",
    "An apache helicopter landed near the village.", "Students at MIT built a small satellite.",
    "The version 2.0 of the report was released on Monday.", "The article describes licensed nurses and their work.",
    "All rights of way are marked on the map.", "The foundation published a free cookbook.",
    "She works under the terms of her contract with the library.", "Use of this path is permitted in summer.",
]
#: A paragraph is looked at only if it holds one of these.
CUE = re.compile(r"licen[sc]|copyright|\(c\)|©|all rights|permission|warrant|redistribut|public domain|spdx|creative commons|\bcc[ -]?(?:by|0)|\bgpl|\bgnu\b|proprietary|waived", re.I)
_TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(])")
#: Longer paragraphs are cut at sentence ends.
PARAGRAPH_WORDS = 80
NEGATIVES = 3_000
EPOCHS, RATE, DECAY = 150, 1.0, 1e-5
#: Share of other paragraphs that must come out unknown, which calibrates the threshold.
SPECIFICITY = 0.999
#: Share of the shorter side's word trigrams that a paragraph and its template must have in common.
CONFIRM = 0.5


def grams(text: str, most: int = 3) -> set[str]:
    """Word n-grams up to ``most`` words, lower-cased; versions and hyphenated names are single words."""
    words = _TOKEN.findall(text.lower())
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def _trigrams(text: str) -> set[tuple[str, ...]]:
    words = _TOKEN.findall(text.lower())
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def paragraphs(text: str):
    """(start, end) of the lines that are not blank, long ones cut at sentence ends."""
    at = 0
    for line in text.split("\n"):
        if line.strip():
            if line.count(" ") < PARAGRAPH_WORDS:
                yield at, at + len(line)
            else:
                begin = words = last = 0
                for cut in [*(m.end() for m in _SENTENCE.finditer(line)), len(line)]:
                    size = line.count(" ", last, cut)
                    if words and words + size > PARAGRAPH_WORDS:
                        yield at + begin, at + last
                        begin, words = last, 0
                    words, last = words + size, cut
                if begin < len(line):
                    yield at + begin, at + len(line)
        at += len(line) + 1


class Classifier:
    """Softmax regression over template n-grams, with a threshold below which a paragraph is unknown."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: np.ndarray, threshold: float):
        self.index, self.weights, self.bias, self.threshold = index, weights, bias, threshold
        self.families = [*TEMPLATES, UNKNOWN]
        self._templates = {family: [_trigrams(t) for t in texts] for family, texts in TEMPLATES.items()}

    def probabilities(self, text: str) -> np.ndarray:
        found = [self.index[g] for g in grams(text) if g in self.index]
        scores = self.bias + self.weights[found].sum(axis=0) / np.sqrt(max(len(found), 1))
        raised = np.exp(scores - scores.max())
        return raised / raised.sum()

    def likeness(self, text: str, family: str) -> float:
        """Largest share of common trigrams with a template of the family, of the shorter side."""
        own = _trigrams(text)
        if not own:
            return 0.0
        return max(len(own & t) / min(len(own), len(t)) for t in self._templates[family])

    def classify(self, text: str) -> tuple[str, float]:
        """Family and its probability; unknown unless likely enough and confirmed by a template."""
        share = self.probabilities(text)
        best = int(share.argmax())
        family, chance = self.families[best], float(share[best])
        if family == UNKNOWN or chance < self.threshold or self.likeness(text, family) < CONFIRM:
            return UNKNOWN, chance
        return family, chance

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(family, start, end, probability) of every licence paragraph of a whole text."""
        if not text or not CUE.search(text):
            return []
        out = []
        for start, end in paragraphs(text):
            part = text[start:end]
            if CUE.search(part):
                family, chance = self.classify(part)
                if family != UNKNOWN:
                    out.append((family, start, end, chance))
        return out


def _varied(text: str, rng: Random) -> str:
    """A template as it may be met: other years and versions, a word lost, words around it."""
    words = re.sub(r"\b(?:19|20)\d\d\b", str(rng.randint(1990, 2030)), text).split()
    if len(words) > 6 and rng.random() < 0.5:
        del words[rng.randrange(len(words))]
    if rng.random() < 0.3:
        words = rng.choice(["Note:", "Notice.", "The text below:", "Unless stated otherwise:"]).split() + words
    if rng.random() < 0.3:
        words += rng.choice(["See the file for details.", "Thank you.", "Contact the author with questions."]).split()
    return " ".join(words)


def train(others: list[str], seed: int = 0) -> Classifier:
    """Fit to varied templates against ``others`` and the sentences near the subject; half calibrate the threshold."""
    rng = Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    rows = [(_varied(text, rng), at) for at, family in enumerate(TEMPLATES) for text in TEMPLATES[family] for _ in range(12)]
    rows += [(_varied(text, rng), len(TEMPLATES)) for text in OTHERS for _ in range(12)]
    rows += [(text, len(TEMPLATES)) for text in others]
    index = {g: i for i, g in enumerate(sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(t)} | {g for t in OTHERS for g in grams(t)}))}
    wide = np.zeros((len(rows), len(index)), dtype=np.float32)
    for at, (text, _) in enumerate(rows):
        found = [index[g] for g in grams(text) if g in index]
        wide[at, found] = 1 / np.sqrt(max(len(found), 1))
    labels = np.array([label for _, label in rows])
    held = np.arange(len(rows)) % 2 == 1
    weights, bias = np.zeros((len(index), len(families))), np.zeros(len(families))
    x, wanted = wide[~held], np.eye(len(families))[labels[~held]]
    balance = 1 / np.maximum(wanted.sum(axis=0), 1)
    each = (wanted @ balance)[:, None] / len(families)
    seen_w, seen_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)

    def chances(x: np.ndarray) -> np.ndarray:
        scores = x @ weights + bias
        raised = np.exp(scores - scores.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)

    for _ in range(EPOCHS):
        error = (chances(x) - wanted) * each
        slope, base = x.T @ error + DECAY * weights / len(families), error.sum(axis=0)
        seen_w, seen_b = seen_w + slope**2, seen_b + base**2
        weights -= RATE * slope / np.sqrt(seen_w)
        bias -= RATE * base / np.sqrt(seen_b)
    claims = chances(wide[held & (labels == len(TEMPLATES))])[:, :-1].max(axis=1)
    threshold = max(0.5, float(np.quantile(claims, SPECIFICITY)) if len(claims) else 0.5)
    return Classifier(index, weights, bias, min(threshold, 0.9))


def fit(docs: DataFrame, text_col: str = "text") -> Classifier:
    """A classifier whose other paragraphs are a bounded sample of lines of ``docs``, by hash.

    Lines with a licence cue stay out of the sample, as they may be notices.
    """
    lines = docs.select(F.xxhash64(*docs.columns).alias("document"), F.posexplode(F.split(F.col(text_col), "\n")).alias("place", "line"))
    lines = lines.where(F.length("line").between(10, 2_000) & ~F.col("line").rlike(f"(?i){CUE.pattern}"))
    rows = least_by_hash(lines.withColumn("kind", F.lit(UNKNOWN)), NEGATIVES, "kind").collect()
    return train(sorted(r["line"] for r in rows))


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: the licence paragraphs of the whole text.

    ``spans`` is an array of (family, start, end, score), in code points, end
    exclusive, in text order.  Null and empty texts have none; repeated rows
    are kept and other columns ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [
                [{"family": f, "start": s, "end": e, "score": p} for f, s, e, p in model.scan(batch.column(1)[i].as_py())]
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["id", "spans"])

    made = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, spans array<struct<family:string,start:int,end:int,score:double>>"
    )
    return made.withColumnRenamed("id", id_col)
