"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph ends at a blank line or at a line that ends a sentence, so a notice that is wrapped over lines is one paragraph. Its
words lose case and its numbers their value; words that no licence template holds become gaps, and the word n-grams (one to
three words) of what lies between gaps are the features. A logistic regression over licence families and "unknown" is fitted
here on the templates, cut and mixed with other prose, and its probabilities are calibrated on paragraphs of templates
and prose that the fit did not see (by cross-validation over templates). A prediction counts once a template of the family
confirms it by the share of its n-grams that the paragraph holds. Fitting reads no table: it depends on the templates and
the seed alone.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prediction needs this calibrated probability, and this share of a template's n-grams.
PROBABILITY, CONFIRMED = 0.5, 0.6
UNKNOWN = "unknown"
SEED = 17
#: Parts of the templates, each left out once for calibration.
PARTS = 4

# How the licence families are named and declared.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", "License: MIT"),
    ("MIT", "This code is available under the MIT license, see the file LICENSE."),
    ("MIT", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache", "Apache License Version 2.0, January 2004"),
    ("Apache", "License: Apache 2.0"),
    ("Apache", "This project is released under the Apache 2.0 license."),
    ("Apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "Released under the GNU GPL v3 or later."),
    ("GPL", "GNU General Public License"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it"),
    ("GPL", "Licensed under GPLv3."),
    ("GPL", "License: GNU GPL v3"),
    ("GPL", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL", "GNU Lesser General Public License"),
    ("LGPL", "Released under the GNU LGPL v3."),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL", "GNU Affero General Public License"),
    ("AGPL", "Released under the GNU AGPL v3."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "Licensed under the BSD license."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL", "Licensed under the Mozilla Public License 2.0."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Licensed under the ISC License."),
    ("BSL", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL", "SPDX-License-Identifier: BSL-1.0"),
    ("BSL", "Boost Software License, Version 1.0"),
    ("EPL", "Licensed under the Eclipse Public License 2.0."),
    ("EPL", "SPDX-License-Identifier: EPL-2.0"),
    ("EPL", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("EUPL", "Licensed under the EUPL, Version 1.2."),
    ("EUPL", "SPDX-License-Identifier: EUPL-1.2"),
    ("EUPL", "European Union Public Licence"),
    ("EUPL", "Licensed under the EUPL v1.2"),
    ("Zlib", "Released under the zlib license."),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("OFL", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("OFL", "SPDX-License-Identifier: OFL-1.1"),
    ("Artistic", "Licensed under the Artistic License 2.0."),
    ("Artistic", "SPDX-License-Identifier: Artistic-2.0"),
    ("ODbL", "This database is made available under the Open Database License."),
    ("ODbL", "SPDX-License-Identifier: ODbL-1.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-ND", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("Public-Domain", "Released under CC0 1.0."),
    ("Public-Domain", "SPDX-License-Identifier: CC0-1.0"),
    ("Public-Domain", "SPDX-License-Identifier: Unlicense"),
    ("Public-Domain", "This work is in the public domain."),
    ("Public-Domain", "The text is in the public domain."),
    ("Public-Domain", "This is free and unencumbered software released into the public domain."),
    ("Public-Domain", "The author has dedicated this work to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright 2020. All rights reserved."),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("Proprietary", "Proprietary and confidential."),
    ("Proprietary", "No part of this publication may be reproduced without the prior written permission of the publisher."),
]
# Prose with the templates' words that declares nothing.
OTHER = [
    "The driver was told to show a valid license and the license plate number.",
    "She was granted permission to use the public library of the university.",
    "Students at MIT released a new version of the software this week.",
    "The Apache helicopter was released from the hangar under the terms of the agreement.",
    "The general public is required by law to obtain a copy of the form.",
    "The Mozilla browser and the BSD family of systems have a long history.",
    "Free software is a matter of liberty, not price, said the foundation.",
    "A gnu is a large animal that lives on the plains of Africa.",
    "Terms and conditions apply to any use of this file.",
    "The creative team received no commercial attribution for the work.",
    "The court met to decide the rights of the author under the law.",
    "You may not use this door except in an emergency.",
    "The source of the river and its two forms are subject to change.",
    "In the domain of public health the conditions are met.",
    "All the copies of the book were included with a notice of the publisher.",
    "All seats were reserved, and she knew her rights.",
    "The table was reserved for all of them by right.",
    "An eclipse of the sun gave the morning a boost.",
    "The artistic director asked for an open font and an open database of names.",
    "The European Union agreed on a public programme this year.",
    "He compressed the file with zlib before the release.",
    "The confidential letter was never sent to the press.",
    "Copying by hand is slow, and it was prohibited in the hall.",
    "The union of writers reads the general news in public.",
    "A driving license must be shown under the terms of the contract.",
    "Their children may be held liable for any damages in the house.",
    "This program was made available on the radio at no charge.",
]

_NUMBER, _WORD = r"[0-9]+(\.[0-9]+)*", r"[a-z0-9]+"


def words_of(text: str) -> list[str]:
    lower = "".join(c.lower() if c.isascii() else " " for c in text)
    return re.findall(_WORD, re.sub(_NUMBER, "0", lower))


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """classes, bias per class, weights per n-gram, the n-grams that confirm each template, and the vocabulary."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        told = [(family, words_of(text)) for family, text in TEMPLATES]
        other = [words_of(x) for x in OTHER]
        self.classes = [UNKNOWN, *dict.fromkeys(f for f, _ in told)]
        counts: dict[str, int] = {}
        for w in [*(x for _, x in told), *other]:
            for g in set(w):
                counts[g] = counts.get(g, 0) + 1
        # a single word tells something if few templates and no other prose hold it; longer n-grams always do
        common = {w for x in other for w in x} | {w for w, n in counts.items() if n > 8 or len(w) < 2}
        self.telling = sorted({w for _, x in told for w in x} - common)
        self.words = sorted({w for _, x in told for w in x})
        self.grams = sorted({g for _, x in told for g in grams_of(x) if " " in g or g in set(self.telling)})
        place = {g: k for k, g in enumerate(self.grams)}

        def examples(told, other):
            paragraphs, marks = self._paragraphs(rng, told, other)
            x = np.zeros((len(paragraphs), len(self.grams)), "f4")
            for row, p in zip(x, paragraphs, strict=True):
                row[[place[g] for g in grams_of(p) if g in place]] = 1
            return x, np.eye(len(self.classes), dtype="f4")[marks]

        # calibration: the temperature at which paragraphs of templates and prose that a fit did not see are likeliest
        logits, truth = [], []
        for part in range(PARTS):
            cut = lambda xs, held: [x for k, x in enumerate(xs) if (k % PARTS == part) == held]  # noqa: B023, E731
            weights, bias = self._fit(*examples(cut(told, False), cut(other, False)), rounds=150)
            x, y = examples(cut(told, True), cut(other, True))
            logits.append(x @ weights + bias)
            truth.append(y)
        logits, truth = np.concatenate(logits), np.concatenate(truth)
        heats = np.linspace(0.2, 4, 77)
        losses = [-np.log(_softmax(logits / t)[truth == 1] + 1e-12).mean() for t in heats]
        self.heat = float(heats[int(np.argmin(losses))])
        self.accuracy = float((logits.argmax(axis=1) == truth.argmax(axis=1)).mean())
        weights, bias = self._fit(*examples(told, other))
        self.weights, self.bias = weights / self.heat, bias / self.heat
        self.templates = [(family, sorted(g for g in grams_of(w) if g in place)) for family, w in told]

    def _paragraphs(self, rng, told, other):
        """Templates whole, cut and within other prose; other prose alone, with shuffled template words, and short ones."""
        out, marks = [], []
        pool = [w for x in other for w in x]
        for _ in range(6):
            for family, w in told:
                cut = int(rng.integers(0, max(1, len(w) // 4)))
                part = w[cut:] if rng.random() < 0.5 else w[: len(w) - cut]
                if rng.random() < 0.5:
                    around = [str(x) for x in rng.choice(pool, int(rng.integers(1, 20)))]
                    part = around[: len(around) // 2] + part + around[len(around) // 2 :]
                out.append(part)
                marks.append(self.classes.index(family))
                mixed = [str(x) for x in rng.permutation(w)][: max(2, len(w) // 2)]
                # words of a short template say much the same in any order: those are no counterexample
                if len(grams_of(mixed) & grams_of(w)) < 0.25 * len(grams_of(w)):
                    out.append(mixed)
                    marks.append(0)
            for w in other:
                out.append(w if rng.random() < 0.5 else w[: len(w) // 2])
                marks.append(0)
            for _ in range(20):
                out.append([str(x) for x in rng.choice(self.words, int(rng.integers(0, 12)))])
                marks.append(0)
        return out, np.array(marks)

    def _fit(self, x, y, ridge: float = 2e-4, rounds: int = 300, rate: float = 0.5):
        """Multinomial logistic regression by accelerated gradient steps."""
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):
            e = (_softmax(x @ w + b) - y) / len(x)
            vw, vb = 0.9 * vw - rate * (x.T @ e + ridge * w), 0.9 * vb - rate * e.sum(axis=0)
            w, b = w + vw, b + vb
        return w, b


@cache
def model(seed: int = SEED) -> Model:
    return Model(seed)


def _paragraph_grams(line: Column, m: Model) -> Column:
    """The vocabulary's n-grams that a paragraph holds, each once."""
    # ASCII alone has case here: other letters are breaks, as in words_of
    lower = F.lower(F.regexp_replace(line, r"[^\x00-\x7F]", " "))
    words = F.regexp_extract_all(F.regexp_replace(lower, _NUMBER, "0"), F.lit(f"({_WORD})"), F.lit(1))
    masked = F.array_join(F.transform(words, lambda w: F.when(w.isin(m.words), w).otherwise(F.lit(""))), " ")
    runs = F.filter(
        F.transform(F.split(masked, "  +"), lambda r: F.trim(r)), lambda r: r.contains(" ") | r.isin(m.telling)
    )

    def grams(r: Column) -> Column:
        w = F.split(r, " ")
        pairs = F.transform(w, lambda a, i: F.concat_ws(" ", a, F.get(w, i + 1)))
        triples = F.transform(w, lambda a, i: F.concat_ws(" ", a, F.get(w, i + 1), F.get(w, i + 2)))
        return F.concat(w, pairs, triples)

    return F.array_distinct(F.filter(F.flatten(F.transform(runs, grams)), lambda g: g.isin(m.grams)))


#: Between paragraphs: line ends after the end of a sentence, and blank lines.
_PARAGRAPH = r"(?<=[.!?:;])[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*|\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"


def split_paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _PARAGRAPH)


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs with an n-gram of the vocabulary: doc_id, version (hash of the text), paragraph (from 0), grams (distinct).

    Repeated rows, and rows that share a null id and a text, are combined before the one shuffle, by document and paragraph, that
    serves all that follows.
    """
    m = model()
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), F.posexplode(split_paragraphs(F.col("text"))).alias("paragraph", "part")
    )
    found = each.select("doc_id", "version", "paragraph", _paragraph_grams(F.col("part"), m).alias("grams")).filter(F.size("grams") > 0)
    # equal texts have equal n-grams; unlike first(), max() lets Spark use the shuffle twice
    return found.groupBy("doc_id", "version", "paragraph").agg(F.max("grams").alias("grams"))


def find_licenses(docs: DataFrame, probability: float = PROBABILITY, confirmed: float = CONFIRMED) -> DataFrame:
    """Declared licences: doc_id, version, paragraph, family, probability, template (its number), share.

    One row per paragraph whose likeliest family reaches ``probability`` and is confirmed by a template; of equal shares the
    first template's, of equal probabilities the first class's. Documents as in scan_licenses().
    """
    m, spark = model(), docs.sparkSession

    def rows(values: list[dict], schema: str) -> DataFrame:
        """A small fixed table, as an SQL literal."""
        return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>"))))

    weights = rows([{"gram": g, "w": [round(float(x), 6) for x in w]} for g, w in zip(m.grams, m.weights, strict=True)], "gram: string, w: array<double>")
    members = rows(
        [{"gram": g, "template": k, "of": f, "size": len(gs)} for k, (f, gs) in enumerate(m.templates) for g in gs],
        "gram: string, template: int, of: string, size: int",
    )
    key = ["doc_id", "version", "paragraph"]
    grams = paragraphs(docs).select(*key, F.explode("grams").alias("gram"))
    n = len(m.classes)
    sums = grams.join(weights, "gram").groupBy(*key).agg(*(F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(n)))
    logits = F.array(*(F.col(f"w{k}") + float(b) for k, b in enumerate(m.bias)))
    # probabilities relative to the likeliest class
    best = sums.select(*key, logits.alias("x")).select(
        *key, (1 / F.aggregate(F.transform("x", lambda v: F.exp(v - F.array_max("x"))), F.lit(0.0), lambda a, v: a + v)).alias("probability"),
        F.element_at(F.array(*map(F.lit, m.classes)), F.array_position("x", F.array_max("x")).cast("int")).alias("family"),
    )
    best = best.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= probability))
    shares = grams.join(members, "gram").groupBy(*key, "of", "template", "size").agg(F.count(F.lit(1)).alias("n"))
    shares = shares.withColumn("share", F.col("n") / F.col("size")).filter(F.col("share") >= confirmed)
    near = shares.groupBy(*key, "of").agg(F.max(F.struct("share", (-F.col("template")).alias("t"))).alias("near"))
    same = [best[c].eqNullSafe(near[c]) for c in key] + [best["family"] == near["of"]]
    found = best.join(near, [*same])
    return found.select(*(best[c] for c in key), "family", "probability", (-F.col("near.t")).alias("template"), F.col("near.share").alias("share"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_paragraphs, n_licenses, family (of the first declaration; null if none), families
    (distinct, sorted, joined by a comma; empty if none), paragraph (its number, from 0), probability, share.

    Null and empty texts have one empty paragraph and no licence; texts of any length are read whole; repeated rows give the
    same row each; a null doc_id is a document like any other; an empty table gives an empty result. Other columns are
    ignored.
    """
    found = find_licenses(docs).groupBy("doc_id", "version").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("paragraph", "family", "probability", "share")).alias("first"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
    )
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("v"), F.size(split_paragraphs(F.col("text"))).cast("long").alias("n_paragraphs")
    )
    found = found.withColumnRenamed("doc_id", "d")
    return own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("v") == F.col("version")), "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).alias("n_licenses"), F.col("first.family").alias("family"),
        F.coalesce("families", F.lit("")).alias("families"), F.col("first.paragraph").cast("long").alias("paragraph"),
        F.round("first.probability", 6).alias("probability"), F.round("first.share", 6).alias("share"),
    )


op10_licenses = scan_licenses
