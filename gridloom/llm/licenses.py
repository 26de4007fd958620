"""Licence scans: a trained paragraph classifier whose finds are held against templates.

A paragraph is a line; long ones are cut into overlapping windows of words. Features are hashed word n-grams, the model
is a multinomial logistic regression over licence families and an unknown class. It is trained here on templates, cut
and embedded in many ways, against paragraphs of the corpus, notices of other licences, sentences that say that a licence
doesn't hold, and sentences that only sound like licences. Its confidence is calibrated on held-out examples; a find counts
if the family's templates confirm it by word pairs that no other licence has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bounded_batches, documents
from gridloom.llm.words import NOT_ALNUM, Reader, mixed

BITS = 18
WINDOW, STRIDE = 80, 40
#: Paragraphs of the corpus that train the unknown class, about: drawn by a hash of the document's id.
UNKNOWN_DOCUMENTS = 400
UNKNOWN_PARAGRAPHS = 2000
#: Of a paragraph that trains, a window of WINDOW words by a hash, each cut to so many characters.
WORD_CHARS = 64
#: Share of held-out unknown examples that may pass to the templates; least share of word pairs that a template confirms,
#: and for a sentence the least number.
LET_THROUGH = 0.02
CONFIRM, CONFIRM_PAIRS = 0.6, 8
ROUNDS, RATE, PENALTY = 120, 0.05, 1e-5
UNKNOWN = "unknown"
SEED = 7

#: Families: names as notices use them, and well-known sentences of the public licence texts. Fixed values.
FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    "MIT": (["MIT License", "MIT licence", "Expat License", "X11 License"], [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License"], [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."]),
    "GPL": (["GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL version 3", "GPLv3", "GPLv2", "GNU General Public License"], [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."]),
    "LGPL": (["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU LGPL version 2.1", "LGPLv3"], [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."]),
    "AGPL": (["GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL version 3", "AGPLv3"], [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]),
    "BSD": (["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-style license"], [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]),
    "MPL-2.0": (["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"], [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."]),
    "ISC": (["ISC License"], [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]),
    "Unlicense": (["Unlicense"], [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    "CC0": (["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0", "Creative Commons CC0 public domain dedication"], [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."]),
    "CC-BY": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"], []),
    "CC-BY-SA": (["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], []),
    "CC-BY-NC": (["CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], []),
    "CC-BY-ND": (["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], []),
    "Proprietary": (["terms of the end user license agreement", "All rights reserved"], [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."]),
}
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This project is distributed under the terms of the {}.", "Available under the {}; see LICENSE for details.", "SPDX-License-Identifier: {}", "Code in this repository is provided under the {}.")
#: Sentences that only sound like licences: for the unknown class.
SOUNDS_ALIKE = (
    "The driver showed a license and the officer granted permission to go on.",
    "The court ruled that the copyright notice was valid in all copies of the work.",
    "A fishing license is required by law and may be obtained at the office for a small fee.",
    "The general public is free to use the library at any time.",
    "Students study at MIT and other universities and released the results under review.",
    "The Apache people lived in the southwest; version two of the story is told by the elders.",
    "This work is under construction and released next week.",
    "Use of this product without a license plate is not permitted on public roads.",
    "The warranty covers the software and the binary forms of payment.",
    "Licensed under the Brewers and Taverns Act to sell beer.",
    "Creative writing is common in this course and attribution of quotes is expected.",
)
#: Licences outside the families, and what denies a licence: for the unknown class.
OTHERS = ("Boost Software License, Version 1.0", "Eclipse Public License 2.0", "Artistic License 2.0", "Microsoft Public License", "zlib License", "European Union Public Licence 1.2", "Academic Free License v3.0", "SIL Open Font License 1.1", "Common Development and Distribution License", "PostgreSQL License", "Python Software Foundation License", "Open Database License", "Server Side Public License", "Zope Public License 2.1", "W3C Software Notice and License")
#: A denial is one of the first, one of the second and a name; or the name in one of the third.
NEGATIONS = ("This is not", "It is not", "This was never", "This is no longer", "This isn't", "It wasn't", "The code can't be", "Nothing is", "None of this is", "The files have not been", "It will never be", "This hasn't been")
GRANTS = ("licensed under the", "covered by the", "available under the", "released under the", "distributed under the", "published under the", "used under the", "granted under the")
DENIED = ("The {} does not apply to this work.", "The {} doesn't apply.", "The {} never applied here.", "Neither the {} nor any other licence covers this work.", "No rights are granted under the {}.", "Without the {} nothing may be copied.", "You can't use this file under the {}.")
#: More ways to name a licence, around which text stands in training.
MENTIONS = ("{}", "({})", "License: {}", "covered by the {}", "under the {}", "see the {}", "the {} applies", "{}, see the file", "data and code: {}", "published under {}", "subject to the {}")
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, start, end) in words: whole paragraphs, long ones in windows that overlap."""
    size = np.diff(first)
    count = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, (size > 0).astype(np.int64))
    which = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[which] + nth * STRIDE
    return which, start, np.minimum(start + WINDOW, first[which + 1])


class Model:
    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.families, self.weights, self.bias, self.temperature, self.least = families, weights, bias, temperature, least

    def logits(self, slab, windows) -> np.ndarray:
        """Sums of weights of the words and word pairs inside each window."""
        which, start, end = windows
        if not len(which):
            return np.zeros((0, len(self.families)))
        one, two = buckets_of(slab.hash)
        sums = []
        for bucket, last in ((one, end), (two, np.maximum(end - 1, start))):
            total = np.concatenate([self.weights[bucket], np.zeros((1, self.weights.shape[1]), np.float32)])
            edges = np.minimum(np.stack([start, last], axis=1).reshape(-1), len(bucket))
            part = np.add.reduceat(total, edges, axis=0, dtype=np.float64)[::2]
            part[last <= start] = 0
            sums.append(part)
        return sums[0] + sums[1] + self.bias


def buckets_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITS)
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) else hashes
    return (hashes >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(corpus: list[str]) -> tuple[list[str], list[int]]:
    """Texts and classes: templates whole, cut, and with text of the corpus around them; for the unknown class (the
    last) paragraphs of the corpus and sentences that sound alike."""
    rng, texts, classes = np.random.default_rng(SEED), [], []
    around = [w for t in corpus[:200] for w in t.split()[:60]] or ["lorem", "ipsum"]

    def add(text, label):
        texts.append(text)
        classes.append(label)

    for label, (names, sentences) in enumerate(FAMILIES.values()):
        whole = [n.format(x) for n in (*NOTICES, *MENTIONS) for x in names] + sentences * 4
        for text in whole:
            add(text, label)
            part = text.split()
            for _ in range(4):
                before, after = (" ".join(rng.choice(around, rng.integers(0, 40))) for _ in range(2))
                add(f"{before} {text} {after}", label)
            if len(part) > 12:
                for _ in range(6):
                    size = rng.integers(10, len(part) + 1)
                    at = rng.integers(0, len(part) - size + 1)
                    add(" ".join(part[at : at + size]), label)
    unknown = len(FAMILIES)
    for text in corpus:
        add(text, unknown)
    for text in SOUNDS_ALIKE:
        for _ in range(20):
            add(" ".join([*rng.choice(around, rng.integers(0, 20)), text]), unknown)
    denied = [f"{a} {b} {x}" for names, _ in FAMILIES.values() for x in names for a in NEGATIONS for b in rng.choice(GRANTS, 2, replace=False)]
    denied += [d.format(x) for names, _ in FAMILIES.values() for x in names for d in DENIED]
    for text in [n.format(x) for x in OTHERS for n in (*NOTICES, *MENTIONS)] + denied:
        for _ in range(2):
            add(" ".join([*rng.choice(around, rng.integers(0, 20)), text, *rng.choice(around, rng.integers(0, 20))]), unknown)
    return texts, classes


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The unknown class sees paragraphs of about UNKNOWN_DOCUMENTS documents, UNKNOWN_PARAGRAPHS at most, that no template
    confirms, whatever words they have. A table without text trains on the templates and the sentences of this module."""
    there = docs.count()
    share = min(1.0, UNKNOWN_DOCUMENTS / max(1, there))
    some = docs.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000)))
    lines = some.select(F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line")).withColumn("h", F.xxhash64("line"))
    words = F.split("line", " ")
    first = (F.pmod(F.col("h"), F.greatest(F.size(words) - WINDOW, F.lit(0)) + 1) + 1).cast("int")
    drawn = lines.withColumn("line", F.array_join(F.transform(F.slice(words, first, WINDOW), lambda w: F.left(w, F.lit(WORD_CHARS))), " "))
    # At most UNKNOWN_PARAGRAPHS rows of WINDOW words of WORD_CHARS characters.
    found, pairs = [r["line"] for r in drawn.orderBy("h", "line").limit(UNKNOWN_PARAGRAPHS).collect()], templates()
    texts, classes = examples([x for x in found if not any(confirmed(x, own) for own in pairs.values())])
    return fit(texts, np.array(classes))


def fit(texts: list[str], classes: np.ndarray) -> Model:
    families = [*FAMILIES, UNKNOWN]
    rows, features = _features(texts)
    # Only what templates and sentences that sound alike have can tell: the rest of the corpus is noise here.
    known = np.zeros(1 << BITS, bool)
    known[_features([x.format(n) for names, _ in FAMILIES.values() for n in names for x in (*NOTICES, *MENTIONS)] + [t for _, sentences in FAMILIES.values() for t in sentences] + list(SOUNDS_ALIKE) + [n.format(x) for x in OTHERS for n in (*NOTICES, *MENTIONS)] + [*NEGATIONS, *GRANTS, *DENIED])[1]] = True
    rows, features = rows[known[features]], features[known[features]]
    held = np.random.default_rng(SEED).random(len(texts)) < 0.2
    used, at = np.unique(features, return_inverse=True)
    target = np.eye(len(families))[classes]
    order = np.argsort(rows, kind="stable")
    rows, at = rows[order], at[order]
    starts = np.searchsorted(rows, np.arange(len(texts)))
    full = np.diff(np.r_[starts, len(rows)]) > 0
    fit_on = (~held)[rows]
    back = np.argsort(at[fit_on], kind="stable")
    back_rows, back_at = rows[fit_on][back], at[fit_on][back]
    back_starts = np.flatnonzero(np.r_[True, back_at[1:] != back_at[:-1]])
    w, b = np.zeros((len(used), len(families))), np.zeros(len(families))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)

    def scores():
        out = np.tile(b, (len(texts), 1))
        out[full] += np.add.reduceat(w[at], starts[full], axis=0)
        return out

    for k in range(1, ROUNDS + 1):
        miss = (softmax(scores()) - target) * (~held)[:, None] / (~held).sum()
        grad = PENALTY * w
        grad[back_at[back_starts]] += np.add.reduceat(miss[back_rows], back_starts, axis=0)
        gb = miss.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        b -= RATE * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-9)
    # Calibration on held-out examples: the temperature that explains them best, then the least confidence to pass: even
    # odds, or more if more than LET_THROUGH of the unknown would pass.
    out, seen = scores()[held], classes[held]
    loss = {t: -np.log(np.clip(softmax(out / t)[np.arange(len(seen)), seen], 1e-12, 1)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    temperature = min(loss, key=loss.get)
    wrong = np.sort(softmax(out / temperature)[seen == len(families) - 1][:, :-1].max(axis=1))
    least = float(wrong[min(len(wrong) - 1, int(np.ceil(len(wrong) * (1 - LET_THROUGH))))]) if len(wrong) else 0.5
    weights = np.zeros((1 << BITS, len(families)), np.float32)
    weights[used] = w
    return Model(families, weights, b, temperature, max(0.5, least))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of each pair of words next to each other in a text."""
    array = pa.array([" ".join(t.split()) for t in texts], pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[: len(array) + 1]
    slab = Reader(NOT_ALNUM, True)._lines(np.frombuffer(array.buffers()[2], np.uint8), offsets, 0)
    one, two = buckets_of(slab.hash)
    row = np.repeat(slab.doc, np.diff(slab.word))
    inside = row[1:] == row[:-1]
    return np.concatenate([row, row[:-1][inside]]), np.concatenate([one, two[inside]])


Pairs = set[tuple[str, ...]]


def pairs_of(text: str) -> Pairs:
    """Pairs of words next to each other; of a single word, the word."""
    words = words_of(text)
    return set(zip(words, words[1:])) if len(words) != 1 else {(words[0],)}


@dataclass(frozen=True)
class Templates:
    """Of a family: for each name its own pairs, which no other licence's name and no wording of notices has; for each
    sentence all pairs, and those that no sentence of another family has."""

    names: list[Pairs]
    sentences: list[tuple[Pairs, Pairs]]


def templates() -> dict[str, Templates]:
    wording = set().union(*[pairs_of(n.format("")) for n in NOTICES])
    named = {k: set().union(*map(pairs_of, names)) for k, (names, _) in FAMILIES.items()}
    other = set().union(wording, *map(pairs_of, OTHERS))
    said = {k: set().union(*map(pairs_of, sentences)) for k, (_, sentences) in FAMILIES.items()}
    out = {}
    for k, (names, sentences) in FAMILIES.items():
        rest = other.union(*[v for f, v in named.items() if f != k])
        unsaid = set().union(*[v for f, v in said.items() if f != k])
        out[k] = Templates([own for n in names if (own := pairs_of(n) - rest)], [(pairs_of(t), pairs_of(t) - unsaid) for t in sentences])
    return out


def confirmed(text: str, own: Templates) -> float:
    """The largest share that the text has of a name's own pairs; or, for a sentence, of the smaller side's pairs if
    CONFIRM_PAIRS of them are there, one of which is the family's own. 0 below CONFIRM."""
    words = words_of(text)
    there = set(zip(words, words[1:])) | {(w,) for w in words}
    size = max(1, len(there) - len(set(words)))
    shares = [len(name & there) / len(name) for name in own.names]
    for every, mine in own.sentences:
        both = every & there
        if len(both) >= min(CONFIRM_PAIRS, len(every)) and mine & there:
            shares.append(len(both) / min(len(every), size))
    best = max(shares, default=0.0)
    return min(best, 1.0) if best >= CONFIRM else 0.0


def confirmed_families(text: str, scores: dict[str, float], pairs: dict[str, Templates]) -> list[tuple[str, float, float]]:
    """(family, score, share) of each family that its templates confirm, the likeliest first."""
    found = [(family, score, confirmed(text, pairs[family])) for family, score in scores.items()]
    return sorted([x for x in found if x[2]], key=lambda x: -x[1])


FOUND = T.ArrayType(T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confirmed", T.DoubleType())]))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, paragraphs, found: for each paragraph and each licence that was found in it, its
    number from 0, the family, the calibrated probability and the template's share; of several windows the likeliest.

    Null texts count as empty: one paragraph, nothing found. Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.families, model.weights, model.bias, model.temperature, model.least))

    def run(batches):
        model, pairs, reader = Model(*shared.value), templates(), Reader(NOT_ALNUM, True)
        unknown = len(model.families) - 1
        for batch in batches:
            paragraphs, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for slab in reader.slabs(batch["text"]):
                np.add.at(paragraphs, slab.doc, 1)
                windows = _windows(slab.word)
                logits = model.logits(slab, windows)
                hits = np.flatnonzero(logits.argmax(axis=1) != unknown) if len(logits) else []
                chance = softmax(logits[hits] / model.temperature) if len(hits) else np.zeros((0, unknown + 1))
                best: dict[int, dict[str, float]] = {}
                # Each family is held against the unknown class alone: those of one window share its probability.
                for k, p in zip(hits, chance, strict=True):
                    for family in np.flatnonzero(p[:unknown] >= model.least * (p[:unknown] + p[unknown])):
                        own = best.setdefault(int(windows[0][k]), {})
                        own[model.families[family]] = max(float(p[family]), own.get(model.families[family], 0.0))
                for line, scores in sorted(best.items()):
                    text = slab.data[slab.start[line] : slab.end[line]].tobytes().decode("utf-8", "replace")
                    for family, p, share in confirmed_families(text, scores, pairs):
                        found[slab.doc[line]].append({"paragraph": int(slab.number[line]), "family": family, "score": p, "confirmed": share})
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(paragraphs, pa.int32()), pa.array(found, kind)], ["id", "paragraphs", "found"])

    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("confirmed", pa.float64())]))
    fed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bounded_batches(spark)
    return fed.mapInArrow(run, T.StructType([fed.schema["id"], T.StructField("paragraphs", T.IntegerType()), T.StructField("found", FOUND)]))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its paragraphs, how many name a licence, the families in order, and the first find."""
    docs = documents(spark, sf_dir)
    found = scan(docs, train(docs))
    first = F.get("found", F.lit(0))
    return found.select(
        F.col("id").alias("doc_id"), "paragraphs", F.size(F.array_distinct(F.transform("found", lambda x: x["paragraph"]))).alias("license_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
        first["paragraph"].alias("first_paragraph"), F.coalesce(first["family"], F.lit(UNKNOWN)).alias("first_family"), F.coalesce(first["score"], F.lit(0.0)).alias("first_score"),
    )
