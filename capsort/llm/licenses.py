"""License scans by a trained paragraph classifier, scored with DataFrame functions only.

Texts are cut at blank lines into paragraphs; a paragraph of several lines is scored as a whole (a wrapped notice) and
line by line (a notice among other lines). Each is the set of its words and word pairs. A sparse logistic regression over the
licence families gives each family its odds against no licence. The model is trained on the driver from notices
written here (fixed values) with words dropped and added, against texts of no family that use the same words. Grams made of
words that the texts of no family use too, or of common words, are no features, so a text without a vocabulary word has the intercept's
score, under which no family can be found: it is not scored further, and nothing is lost by that (``train`` checks it).

The unknown class is calibrated: texts of no family and each family in turn are left out of training, and the threshold is the
lowest probability at which at most ``MISS`` of what the model has not seen passes as a family that the template
comparison confirms. That comparison needs ``SHARE`` of the words of one of the family's notices, or as large a share of the
paragraph's own words in one, and a phrase that tells the family from its relatives (``TELLING``). What is likelier a licence than
none but is confirmed for no family is an unknown licence.

All is row-local: no shuffle, no explode, no Python. Result per document: doc_id, n_paragraphs (not blank), n_notices
(paragraphs that state a licence, unknown ones too), families (sorted, comma-joined, confirmed only; a paragraph can
state several), top_family (most probable confirmed one; ties to the first in order), score (its probability),
n_unknown (paragraphs that state an unknown licence only).

Defined cases: a null or empty text has no paragraphs and null top_family, score 0. Repeated rows give repeated results. Long texts
are read whole. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which documents state their licence, by family.
NOTICES = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-or-later", "Released under the AGPL v3",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Distributed under the terms of the Apache 2.0 license", "Available under the Apache 2.0 terms", "MIT OR Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. Apache"],
    "BSD": ["Released under the BSD License", "This code is licensed under the 3-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0", "Text is available under CC BY 4.0", "Lizenziert unter CC BY 4.0", "Publicado bajo licencia CC BY 4.0", "Sous licence CC BY 4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0", "Text is available under CC BY-NC 4.0", "Lizenziert unter CC BY-NC 4.0", "Publicado bajo licencia CC BY-NC 4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under CC BY-SA 4.0", "Lizenziert unter CC BY-SA 4.0", "Publicado bajo licencia CC BY-SA 4.0"],
    "CC0": ["Licensed under CC0 1.0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work under CC0", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "EPL": ["Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL v2 or later", "Released under GPLv3",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "ISC": ["Released under the ISC License", "SPDX-License-Identifier: ISC", "Licensed under the ISC license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the LGPL",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "MIT OR Apache-2.0", "Dual licensed under MIT or another license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Public-Domain": ["This work is in the public domain", "Released into the public domain", "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense", "Placed in the public domain by its author"],
}
#: Phrases that tell a family from its relatives: any of these, and none of those.
TELLING = {
    "AGPL": (["agpl", "affero general public"], []), "Apache-2.0": (["apache license", "apache 2.0"], []), "BSD": (["bsd license", "bsd style", "clause bsd", "identifier bsd", "redistribution and use in source", "neither the name of the"], []),
    "CC-BY": (["cc by", "creative commons attribution"], ["by nc", "by sa", "by nd", "attribution noncommercial", "attribution sharealike", "attribution noderivatives"]), "CC-BY-NC": (["cc by nc", "creative commons attribution noncommercial"], []),
    "CC-BY-ND": (["cc by nd", "creative commons attribution noderivatives"], []), "CC-BY-SA": (["cc by sa", "creative commons attribution sharealike"], []), "CC0": (["under cc0", "cc0 1.0", "identifier cc0"], []), "EPL": (["eclipse public license", "identifier epl"], []),
    "GPL": (["gpl", "gplv3", "gplv2", "gnu general public license"], []), "ISC": (["isc license", "identifier isc", "for any purpose with or without fee"], []), "LGPL": (["lgpl", "lesser general public license"], []),
    "MIT": (["mit license", "mit licence", "identifier mit", "under mit", "mit or", "or mit", "mit apache", "permission is hereby granted free of charge", "this permission notice shall be included"], []),
    "MPL": (["mpl", "mozilla public license", "mpl 2.0"], []), "Public-Domain": (["in the public domain", "into the public domain", "identifier unlicense"], ["not in the public domain"]),
}
#: Common words; they, pairs of them, and words of one or two letters by themselves are no features.
COMMON = """a an and any are as at be but by can for from had has have he if in into is it its may no not of on only or other that the their there these they this to was we were will with without you your
all also both either later more most now out over some such than then up when where which who whom whose
der die das und oder unter mit von zu ein eine ist nicht el la los las de del en y o con por para un una es no le les et ou sous avec par des du dans est""".split()
#: Texts that speak of licences, or share their words, but state none of these families.
OTHERS = [
    "All rights reserved. No license is granted", "This software is proprietary and its license is not transferable", "The dog slept under the table", "The report was released and published at last, available in all shops",
    "Copyright of the respective owners", "A driving license is needed for this job", "The license fee is due each year", "Please read the license agreement before use",
    "Version 1 of the identifier", "The committee gave permission to build", "Licensed by the state in which they work", "Permission to enter is given at the gate",
    "The public library is open", "Version 2.0 of the general report", "Creative work by the common people", "Copyright 2020 by the authors", "Contact us about a license",
    "The eclipse of the sun was seen in public", "Neighboring rights of the land and the domain name", "Students at MIT use the software for any purpose", "They may modify the notice and publish it, with or without a fee",
    "Free of charge for all persons, including children", "The source of the river and its forms", "International conditions of the market are met", "Products derived from milk are distributed in the file of shops",
    "You can obtain a copy of the work at the desk", "The following names are permitted, either now or later", "The author placed the materials in the library",
    # Licences of other families, and ways to say that there is none.
    "Licensed under the European Union Public Licence 1.2", "Licensed under the terms of a commercial agreement", "Released under a custom license, version 1", "Licensed under the Foo License", "Licensed under the Artistic License, Version 2.0", "Released under the zlib License", "SPDX-License-Identifier: WTFPL", "Licensed under the Open Software License 3.0",
    "This file is under the Academic Free License version 3.0", "Licensed under the Business Source License 1.1", "SPDX-License-Identifier: BUSL-1.1", "Released under the Microsoft Public License",
]
#: Of ``OTHERS``, those from here on state a licence that is no family: likelier a licence than none is right for them.
FOREIGN = OTHERS.index("Licensed under the European Union Public Licence 1.2")
TOKEN = r"[a-z0-9.]*[a-z0-9]"
COPIES, ROUNDS, MISS, SHARE = 10, 300, 0.02, 0.6


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _examples(rng: np.random.Generator) -> list[tuple[set[str], int, int]]:
    """(grams, class, text number); class 0 is none, the last one a licence of another family."""
    out = []
    other = len(NOTICES) + 1
    texts = [(t, 0 if n < FOREIGN else other) for n, t in enumerate(OTHERS)] + [(t, k + 1) for k, f in enumerate(NOTICES) for t in NOTICES[f]]
    filler = sorted({w for t in OTHERS for w in tokens(t)})
    for number, (text, k) in enumerate(texts):
        words = tokens(text)
        for copy in range(COPIES):
            own = [w for w in words if copy == 0 or rng.random() > 0.1]
            extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))] if copy else []
            out.append((grams(extra[:3] + own + extra[3:]), k, number))
    return out


def _solve(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Multinomial logistic regression with a little ridge, by full gradient steps."""
    w, onehot = np.zeros((x.shape[1], classes)), np.eye(classes)[y]
    for _ in range(ROUNDS):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 4.0 * (x.T @ (p - onehot) / len(y) + 1e-4 * w)
    return w


def telling(family: str, words: list[str]) -> bool:
    some, none = TELLING[family]
    text = f" {' '.join(words)} "
    return any(f" {t} " in text for t in some) and not any(f" {t} " in text for t in none)


def confirmed(family: str, words: list[str]) -> bool:
    """The template comparison, in Python: see ``scan_licenses`` for the same in DataFrame functions."""
    own = set(words)
    return telling(family, words) and any(len(own & n) >= SHARE * min(len(n), len(own)) for n in (set(tokens(t)) for t in NOTICES[family]))


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probability of each class but none against none."""
    z = x @ w
    return 1 / (1 + np.exp(z[:, :1] - z[:, 1:]))


def train(seed: int = 5) -> dict:
    """Weights per gram (the empty gram is the intercept), families, and the calibrated threshold."""
    examples = _examples(np.random.default_rng(seed))
    plain = {w for t in OTHERS[:FOREIGN] for w in tokens(t)}
    stated = {g for t in [t for f in NOTICES.values() for t in f] + OTHERS[FOREIGN:] for g in grams(tokens(t))}
    # A pair is a feature if one of its words is not a plain one, or if no plain text has the pair.
    used = {g for t in OTHERS[:FOREIGN] for g in grams(tokens(t))}
    dull = lambda g: all(w in COMMON for w in g.split()) or " " not in g and len(g) < 3
    vocabulary = sorted(g for g in stated if g not in used and not dull(g))
    place = {g: i + 1 for i, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary) + 1))
    x[:, 0] = 1
    for r, (s, _, _) in enumerate(examples):
        x[r, [place[g] for g in s if g in place]] = 1
    x /= np.sqrt(x.sum(1, keepdims=True))
    y, number = np.array([k for _, k, _ in examples]), np.array([n for _, _, n in examples])
    families = [*NOTICES]
    classes = len(families) + 2
    passed: list[float] = []
    texts = OTHERS + [t for f in NOTICES for t in NOTICES[f]]
    label = [0] * len(OTHERS) + [k + 1 for k, f in enumerate(NOTICES) for _ in NOTICES[f]]
    folds = [(y == 0) & (number % 4 == fold) for fold in range(4)] + [y == k for k in range(1, classes)]
    for out in folds:  # scored by models that have not seen it
        p = odds(x[out], _solve(x[~out], y[~out], classes))
        for row, n in zip(p, number[out], strict=True):
            words = tokens(texts[n])
            passed.append(max((row[k] for k, f in enumerate(families) if k + 1 != label[n] and confirmed(f, words)), default=0.0))
    w = _solve(x, y, classes)
    if odds(np.eye(1, x.shape[1]), w).max() >= 0.5:
        raise ValueError("a text without a vocabulary word must not look like a licence")
    return {"families": families, "vocabulary": ["", *vocabulary], "weights": w, "threshold": min(0.9, max(0.5, float(np.quantile(passed, 1 - MISS)))), "plain": sorted(plain)}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _literal(value: object, schema: str) -> Column:
    """One literal: thousands of literal nodes would make the plan slow to analyse."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def scan_licenses(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per document: see the module's text."""
    model = model or train()
    families, weights = model["families"], model["weights"]
    table = _literal(dict(zip(model["vocabulary"], weights.tolist(), strict=True)), "map<string,array<double>>")
    vocabulary = _literal(model["vocabulary"][1:], "array<string>")
    # Of each feature a word that is no common one: a text without any of these words has no feature.
    needed = _literal(sorted({max((w for w in g.split() if w not in COMMON), key=len) for g in model["vocabulary"][1:]}), "array<string>")
    add = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)

    def grams_of(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))

    def probabilities(known: Column) -> Column:
        """Of each class against none, from the features of a paragraph."""
        z = F.aggregate(known, _vector(weights[0]), lambda sums, g: add(sums, F.element_at(table, g)))
        return _let(F.sqrt(F.size(known) + F.lit(1.0)), lambda size: _let(z, lambda zs: F.transform(F.slice(zs, 2, len(families) + 1), lambda v: 1 / (1 + F.exp((F.element_at(zs, 1) - v) / size)))))

    def covers(family: str, words: Column) -> Column:
        notices = _literal([sorted(set(tokens(t))) for t in NOTICES[family]], "array<array<string>>")
        return F.exists(notices, lambda n: F.size(F.array_intersect(n, words)) >= F.lit(SHARE) * F.least(F.size(n), F.size(words)))

    def tells(family: str, line: Column) -> Column:
        some, none = ([line.contains(F.lit(f" {t} ")) for t in phrases] for phrases in TELLING[family])
        return reduce(Column.__or__, some) & ~reduce(Column.__or__, none, F.lit(False))

    def verdict(unit: Column) -> Column:
        """Confirmed families with their probabilities, and whether a licence is likelier than none."""
        fits = F.filter(F.array(*[F.when(tells(f, unit["line"]) & covers(f, unit["own"]), F.lit(k)) for k, f in enumerate(families)]), lambda k: k.isNotNull())
        return _let(probabilities(unit["known"]), lambda p: F.struct(
            F.filter(F.transform(fits, lambda k: F.struct(F.element_at(p, k + 1).alias("p"), F.element_at(F.array(*map(F.lit, families)), k + 1).alias("family"))), lambda x: x["p"] >= model["threshold"]).alias("sure"),
            (F.array_max(p) > 0.5).alias("stated")))

    words_of = lambda text: F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))

    def unit_of(text: Column) -> Column:
        return _let(words_of(text), lambda own: F.when(F.arrays_overlap(needed, own), F.struct(F.array_distinct(own).alias("own"), F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")).alias("line"), F.array_intersect(vocabulary, grams_of(own)).alias("known"))))

    def units(paragraph: Column) -> Column:
        lines = F.split(paragraph, "\n")
        each = F.concat(F.array(paragraph), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))
        return F.filter(F.transform(each, unit_of), lambda u: u.isNotNull() & (F.size(u["known"]) > 0))

    text = F.coalesce(F.col("text"), F.lit(""))
    blank = lambda t: F.btrim(t, F.lit(" \t\r\n\f\x0b")) == ""
    paragraphs = F.filter(F.split(text, "\n[ \\t\\r\\f\\x0b]*\n"), lambda t: ~blank(t))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), paragraphs.alias("paragraphs"), F.arrays_overlap(needed, words_of(text)).alias("some"))
    parts = cut.select("doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.filter(F.transform(F.when(F.col("some"), F.col("paragraphs")).otherwise(F.array().cast("array<string>")), units), lambda u: F.size(u) > 0).alias("u"))
    judged = parts.select("doc_id", "n_paragraphs", F.transform("u", lambda own: F.transform(own, verdict)).alias("v"))
    found = judged.select("doc_id", "n_paragraphs", F.transform("v", lambda own: F.struct(F.flatten(F.transform(own, lambda x: x["sure"])).alias("sure"), F.exists(own, lambda x: x["stated"]).alias("stated"))).alias("d"))
    sure = F.flatten(F.transform("d", lambda d: d["sure"]))
    best = F.array_max(F.transform(sure, lambda x: x["p"]))
    top = F.array_min(F.transform(F.filter(sure, lambda x: x["p"] == best), lambda x: x["family"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    unknown = F.size(F.filter("d", lambda d: d["stated"] & (F.size(d["sure"]) == 0))).cast("long")
    stated = F.size(F.filter("d", lambda d: F.size(d["sure"]) > 0)).cast("long")
    return found.select("doc_id", "n_paragraphs", (stated + unknown).alias("n_notices"), names.alias("families"), top.alias("top_family"), F.coalesce(best, F.lit(0.0)).alias("score"), unknown.alias("n_unknown"))
