"""Licence scans: a trained classifier of paragraph windows whose predictions are confirmed by comparison with templates.

A paragraph is what stands between blank lines; its words run across line breaks, comment marks and punctuation. Around
every word a short and a long window is judged by a multinomial logistic regression over the words and word pairs that
are present: weights are added, so what else stands in the paragraph doesn't dilute a notice. `unknown` is the class of
all else. Temperature and offset of the families are fitted on phrasings that the weights never saw.

The whole judgement is one expression of built-in functions over a row: no text is shuffled, joined or exploded. Windows
are passed over only if they can't be confirmed, or say what the window before them says: those without a key pair (of
each template, the word pairs beside its keys are less than LEAST_OVERLAP of it), and those with the known words and
pairs of the window one word before.
"""

from __future__ import annotations

import json
import random
import re
import struct
from collections import Counter, defaultdict
from functools import reduce
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Bounds of the corpus sample that stands for ordinary text in training: documents, and windows of them.
SAMPLED_DOCUMENTS, NEGATIVES = 200, 400
#: Words on both sides of a legal term that a window takes in.
RADII = (10, 40)
#: Least probability of a family, and least share of a template that a window must hold.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.5, 0.5
#: Weights nearer to zero than this are zero in the model.
PRUNE = 0.02
#: Windows stand around words that hold one of these: around every word.
TERMS = ("",)
#: Texts that hold one of these aren't taken for ordinary text in training.
LEGAL = ("licen", "copyright", "redistribut", "warrant", "permission", "liab", "cc0", "gpl", "unencumber")

# Names, SPDX identifiers and clauses of the licences' own texts.
FAMILIES = {
    "agpl": (["GNU Affero General Public License", "AGPL", "AGPL version 3"], ["AGPL-3.0-only", "AGPL-3.0-or-later"], ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "See the GNU Affero General Public License for more details"]),
    "apache": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"], ["Apache-2.0"], ["you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "See the License for the specific language governing permissions and limitations under the License"]),
    "bsd": (["BSD License", "3-Clause BSD License", "2-Clause BSD License"], ["BSD-3-Clause", "BSD-2-Clause"], ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"]),
    "boost": (["Boost Software License", "Boost Software License, Version 1.0"], ["BSL-1.0"], ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"]),
    "cc-by": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY 3.0 license"], ["CC-BY-4.0"], []),
    "cc-by-nc": (["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC license"], ["CC-BY-NC-4.0"], []),
    "cc-by-sa": (["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA license"], ["CC-BY-SA-4.0"], []),
    "cc0": (["CC0 1.0 Universal license", "CC0 1.0 Universal Public Domain Dedication license", "CC0 license"], ["CC0-1.0"], ["CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"]),
    "epl": (["Eclipse Public License", "Eclipse Public License 2.0"], ["EPL-2.0"], ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution"]),
    "gpl": (["GNU General Public License", "GNU General Public License, version 3", "GPL", "GPL version 2 or later", "GPLv3"], ["GPL-2.0-only", "GPL-3.0-or-later"], ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", "You should have received a copy of the GNU General Public License along with this program"]),
    "isc": (["ISC License"], ["ISC"], ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"]),
    "lgpl": (["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPL version 3"], ["LGPL-2.1-only", "LGPL-3.0-or-later"], ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", "See the GNU Lesser General Public License for more details"]),
    "mit": (["MIT License", "MIT"], ["MIT"], ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"]),
    "mpl": (["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL 2.0"], ["MPL-2.0"], ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"]),
    "unlicense": (["Unlicense"], ["Unlicense"], ["This is free and unencumbered software released into the public domain"]),
    "zlib": (["zlib License"], ["Zlib"], ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"]),
}
SAYS = ["Licensed under the {}", "Licensed under {}", "Released under the {}", "This work is licensed under the {}", "This software is {} licensed", "distributed under the terms of the {}", "is free software licensed under the {}", "License: {}"]
IDENTIFIED = "SPDX-License-Identifier: {}"
DENIALS = ["is not licensed under the {}", "was not released under the {}", "They did not release the code under the {}", "was never licensed under the {}", "is no longer distributed under the {}", "did not publish it under {}", "has not been licensed under {}", "not {} licensed", "The company did not release its software under the {}", "will not be released under the {}", "A comparison of the {} with other licenses", "an essay on the history of the {}"]
LOOKALIKES = [
    "He lost his driving license and the copy of it", "the license plate of the car was copied without permission", "All rights reserved", "the license fee is due in March", "a licensed plumber must sign the form", "the board revoked her medical license",
    "Copyright 2019 by the author. All rights reserved", "no part of this book may be reproduced without written permission", "the warranty period of the washing machine is two years", "this warranty does not cover water damage", "he asked his mother for permission", "permission to enter was granted",
    "the general public was under the terms of a new law", "copyright law protects authors", "a notice of copyright infringement was sent", "the company is liable for the damage", "limited liability company", "redistribution of wealth was debated", "planning permission for the house is not needed", "the restaurant is licensed to sell wine",
    "This software is licensed, not sold, to you by the vendor", "proprietary and confidential, use is subject to license terms", "you may not copy, resell or reverse engineer the software", "the warrant was signed by the judge", "poetic license", "the software was released last year under a new name and a new license policy", "contact us to obtain a commercial license", "the press published the license agreement in full", "Licensed under the Artistic License 2.0", "Released under the Academic Free License", "see the license file for the text", "released under a license of its own",
]
#: Phrasings kept from the weights, on which temperature and offset are fitted.
HELD_SAYS = ["This package is made available under the {}", "The code is covered by the {}, see LICENSE", "It has been licensed under the {}"]
HELD_DENIALS = ["The author did not release this under the {}", "we never licensed it under the {}", "is not distributed under the {}"]
HELD_LOOKALIKES = ["the fishing license costs ten dollars", "he was granted permission to leave", "the product comes with a limited warranty", "she holds the copyright of the song", "unlicensed use is forbidden by copyright law", "a license to kill", "the insurer denied all liability", "license and registration please"]

_GAP = r"[^0-9a-z]+"
_BLANK = r"\n[ \t\r]*\n\s*"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_GAP, text.lower()) if w]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(words: list[str]) -> tuple[list[int], list[int]]:
    """Hashes of the words and of the word pairs, as Spark's xxhash64 chains them; unsigned."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    one = [xxhash.xxh64_intdigest(struct.pack("<Q", x), 42) for x in h]
    return one, [xxhash.xxh64_intdigest(struct.pack("<Q", y), seed=x) for x, y in zip(one, h[1:])]


def features(words: list[str]) -> set[int]:
    one, two = _chain(words)
    return {_signed(x) for x in one + two}


def templates() -> dict[str, list[str]]:
    """Per family the notices by which a prediction is confirmed: names and identifiers in every phrasing, and the clauses."""
    return {k: [s.format(n) for n in names for s in SAYS] + [IDENTIFIED.format(i) for i in ids] + clauses for k, (names, ids, clauses) in FAMILIES.items()}


class Model(NamedTuple):
    families: list[str]
    weights: dict[int, np.ndarray]
    biases: np.ndarray

    def logits(self, words: list[str]) -> np.ndarray:
        """Of the families, relative to `unknown`."""
        return self.biases + sum((self.weights[f] for f in features(words) if f in self.weights), np.zeros(len(self.families)))

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Of `unknown` and the families."""
        z = np.append(0.0, self.logits(words))
        e = np.exp(z - z.max())
        return e / e.sum()


def _rows(phrases: list[tuple[str, int]], fill: list[str], copies: int, rng: random.Random) -> list[tuple[list[str], int]]:
    """Each phrase as it is, and copies with other words around and a few words lost."""
    out = []
    for phrase, k in phrases:
        ws = words_of(phrase)
        out.append((ws, k))
        for _ in range(copies):
            cut = [w for w in ws if rng.random() > 0.04] if len(ws) > 10 else ws
            before, after = (fill[i : i + rng.randrange(20)] for i in (rng.randrange(len(fill)), rng.randrange(len(fill))))
            out.append(([*before, *cut, *after], k))
    return out


def _phrases(says: list[str], denials: list[str], lookalikes: list[str], classes: list[str], clauses: bool) -> list[tuple[str, int]]:
    out = [(x, 0) for x in lookalikes]
    for k, family in enumerate(classes[1:], 1):
        names, ids, texts = FAMILIES[family]
        out += [(s.format(n), k) for n in names for s in says] + [(s.format(n), 0) for n in names for s in denials]
        if clauses:
            out += [(x, k) for x in [*texts, *(IDENTIFIED.format(i) for i in ids)]]
    return out


def train(negatives: list[list[str]], seed: int = 7, rounds: int = 100) -> Model:
    """The model, from the phrasings above and negatives (windows of ordinary words, at most NEGATIVES of them)."""
    rng = random.Random(seed)
    classes = [UNKNOWN, *sorted(FAMILIES)]
    own = [w for x in LOOKALIKES for w in words_of(x) if not any(t in w for t in LEGAL)]
    fill = [*own, *(w for ws in negatives for w in ws)][:20_000]
    split = len(negatives) * 4 // 5
    fit = _rows(_phrases(SAYS, DENIALS, LOOKALIKES, classes, True), fill, 2, rng) + [(ws, 0) for ws in negatives[:split]]
    held = _rows(_phrases(HELD_SAYS, HELD_DENIALS, HELD_LOOKALIKES, classes, False), fill, 1, rng) + [(ws, 0) for ws in negatives[split:]]

    # Only what phrases hold is a feature; ordinary text tells how little common words say.
    known = Counter(f for ws, _ in _rows(_phrases(SAYS, DENIALS, LOOKALIKES, classes, True), fill, 0, rng) for f in features(ws))
    index = {f: i for i, f in enumerate(sorted(known))}
    entries = [(r, index[f]) for r, (ws, _) in enumerate(fit) for f in features(ws) if f in index]
    row, col = (np.array(x) for x in zip(*sorted(entries)))
    by_col = np.argsort(col, kind="stable")
    r_at, r_start = np.unique(row, return_index=True)
    c_at, c_start = np.unique(col[by_col], return_index=True)
    k = len(classes) - 1
    target = np.zeros((len(fit), k), np.float32)
    for r, (_, y) in enumerate(fit):
        if y:
            target[r, y - 1] = 1
    w, b = np.zeros((len(index), k), np.float32), np.full(k, -3.0, np.float32)
    square = np.full(w.shape, 1e-3, np.float32)
    for _ in range(rounds):  # AdaGrad over all rows; `unknown` has logit zero
        z = np.tile(b, (len(fit), 1))
        z[r_at] += np.add.reduceat(w[col], r_start)
        top = np.maximum(z.max(1, keepdims=True), 0)
        e = np.exp(z - top)
        gap = e / (e.sum(1, keepdims=True) + np.exp(-top)) - target
        g = np.zeros_like(w)
        g[c_at] = np.add.reduceat(gap[row[by_col]], c_start)
        g += 0.005 * w
        square += g * g
        w -= 0.5 * g / np.sqrt(square)
        b = np.minimum(b - 0.002 * gap.sum(0), -2.0)  # without evidence no family beats `unknown`
    w[np.abs(w) < PRUNE] = 0
    raw = Model(classes[1:], {f: w[i].astype(float) for f, i in index.items() if w[i].any()}, b.astype(float))
    z, y = np.array([raw.logits(ws) for ws, _ in held]), np.array([c for _, c in held])
    heat, offset = min(((t, o) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for o in (-4.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0)), key=lambda p: _loss((z + p[1]) / p[0], y))
    return Model(raw.families, {f: np.round(x / heat, 4) for f, x in raw.weights.items()}, np.round((raw.biases + offset) / heat, 4))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    full = np.concatenate([np.zeros((len(z), 1)), z], axis=1)
    top = full.max(1)
    return float((top + np.log(np.exp(full - top[:, None]).sum(1)) - full[np.arange(len(y)), y]).mean())


# Spark -----------------------------------------------------------------------------------------------------------------


def _any(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in LEGAL))


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fixed(value, kind: str) -> Column:
    """A constant; folded into one literal by the optimiser."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def _table(keys: list[int]) -> tuple[int, list[int], list[int]]:
    """A hash table of two places a bucket: buckets, key and row by place (row -1: empty)."""
    buckets = 1 << 12
    while max(Counter(f % buckets for f in keys).values(), default=0) > 2:
        buckets *= 2
    key, row, held = [0] * (2 * buckets), [-1] * (2 * buckets), Counter()
    for r, f in enumerate(keys):
        place = 2 * (f % buckets) + held[f % buckets]
        held[f % buckets] += 1
        key[place], row[place] = f, r
    return buckets, key, row


def _comparison(model: Model) -> tuple[list[list[int]], list[list[float]], list[list[int]]]:
    """Word pairs of the templates, their shares (they add up to 1), and the templates of each family.

    A pair counts the less, the more families' templates hold it: what all notices say confirms none.
    """
    own = templates()
    pairs = {k: [{_signed(x) for x in _chain(words_of(t))[1]} for t in own[k]] for k in model.families}
    holders = Counter(p for ts in pairs.values() for p in set().union(*ts))
    hashes, shares, of = [], [], []
    for k in model.families:
        of.append([])
        for t in pairs[k]:
            if t:
                each = sorted(t)
                weight = [1 / holders[p] for p in each]
                of[-1].append(len(hashes))
                hashes.append(each)
                shares.append([x / sum(weight) for x in weight])
    return hashes, shares, of


def _keys(hashes: list[list[int]], shares: list[list[float]]) -> set[int]:
    """Word pairs of which any LEAST_OVERLAP of a template holds one: the other pairs of each template are less. Rare ones first."""
    out: set[int] = set()
    for each, share in zip(hashes, shares):
        left = sum(x for h, x in zip(each, share) if h not in out)
        for x, h in sorted(((x, h) for h, x in zip(each, share) if h not in out), reverse=True):
            if left < LEAST_OVERLAP - 1e-9:
                break
            out.add(h)
            left -= x
    return out


def found(text: Column, model: Model) -> Column:
    """The confirmed notices of a text: array of (n: paragraph from 0, family, probability, overlap), one for a paragraph and family."""
    k = len(model.families)
    hashes, shares, of = _comparison(model)
    own = _keys(hashes, shares)
    known = sorted(own) + sorted({*model.weights, *(h for each in hashes for h in each)} - own)
    number = {f: r for r, f in enumerate(known)}
    buckets, key, row = _table(known)
    keys, rows_, own_ = _fixed(key, "array<bigint>"), _fixed(row, "array<int>"), _fixed(sorted(own), "array<bigint>")
    weights = _fixed([float(x) for f in known for x in model.weights.get(f, np.zeros(k))], "array<double>")
    biases = _fixed([float(x) for x in model.biases], "array<double>")
    names = _fixed(model.families, "array<string>")
    t_row = _fixed([[number[h] for h in each] for each in hashes], "array<array<int>>")
    t_share, t_of = _fixed(shares, "array<array<double>>"), _fixed(of, "array<array<int>>")

    def row_of(f: Column) -> Column:
        place = (2 * F.pmod(f, F.lit(buckets))).cast("int")
        return F.when(_at(keys, place) == f, _at(rows_, place)).when(_at(keys, place + 1) == f, _at(rows_, place + 1)).otherwise(F.lit(-1))

    def pairs_of(x: Column) -> Column:
        pair = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.xxhash64(F.element_at(x, i), F.element_at(x, i + 1)))
        return F.when(F.size(x) > 1, pair).otherwise(F.array().cast("array<bigint>"))

    def overlap(rows: Column, t: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(_at(t_row, t)) - 1)
        return F.aggregate(every, F.lit(0.0), lambda a, j: a + F.when(F.array_contains(rows, _at(_at(t_row, t), j)), _at(_at(t_share, t), j)).otherwise(F.lit(0.0)))

    def judged(rows: Column) -> Column:
        """A window (rows of its known words and pairs) to (family's number, probability, overlap); number -1 if `unknown` is likelier."""
        score = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.aggregate(rows, _at(biases, c), lambda a, r: a + _at(weights, r * k + c)))

        def top(z: Column) -> Column:
            most = F.array_max(z)
            total = F.aggregate(z, F.exp(-most), lambda a, v: a + F.exp(v - most))
            return F.struct(F.when((most > 0) & (1 / total >= LEAST_PROBABILITY), F.array_position(z, most).cast("int") - 1).otherwise(F.lit(-1)).alias("c"), (1 / total).alias("probability"))

        best = lambda j: F.when(j["c"] >= 0, F.array_max(F.transform(_at(t_of, j["c"]), lambda t: overlap(rows, t)))).otherwise(F.lit(0.0))
        return _let(_let(score, top), lambda j: F.struct(j["c"].alias("c"), j["probability"].alias("probability"), best(j).alias("overlap")))

    def windows(one: Column, two: Column, r: int) -> Column:
        """The windows of radius r that hold a key pair, judged; one and two are the rows of the words and of the pairs."""
        n = F.size(one)
        at = F.filter(F.sequence(F.lit(1), F.size(two)), lambda i: (F.element_at(two, i) >= 0) & (F.element_at(two, i) < len(own)))

        def around(a: Column) -> Column:
            """The middles of windows that hold both words of a key pair, each once."""
            first = lambda p, i: F.greatest(p + 1 - r, F.lit(1), F.when(i > 0, F.get(a, i - 1) + r + 1).otherwise(F.lit(1)))
            return F.flatten(F.transform(a, lambda p, i: F.when(first(p, i) <= F.least(p + r, n), F.sequence(first(p, i), F.least(p + r, n))).otherwise(F.array().cast("array<int>"))))

        def changes(i: Column) -> Column:
            """Does a known word or pair come in or go out between the windows around i - 1 and i?"""
            known_at = lambda x, j: F.coalesce(F.get(x, j - 1) >= 0, F.lit(False))
            return (i == 1) | known_at(one, i + r) | known_at(two, i + r - 1) | known_at(one, i - 1 - r) | known_at(two, i - 1 - r)

        def rows(i: Column) -> Column:
            a, b = F.greatest(i - r, F.lit(1)), F.least(i + r, n)
            return F.array_distinct(F.filter(F.concat(F.slice(one, a, b - a + 1), F.slice(two, a, b - a)), lambda x: x >= 0))

        return F.transform(F.filter(_let(at, around), changes), lambda i: _let(rows(i), judged))

    def notices(h: Column, pairs: Column, n: Column) -> Column:
        seen = _let(F.transform(h, lambda x: row_of(F.xxhash64(x))), lambda one: _let(F.transform(pairs, row_of), lambda two: F.concat(*[windows(one, two, r) for r in RADII])))
        good = F.filter(seen, lambda x: (x["c"] >= 0) & (x["overlap"] >= LEAST_OVERLAP))
        most = lambda g, c, x: F.array_max(F.transform(F.filter(g, lambda y: y["c"] == c), lambda y: y[x]))
        each = lambda g: F.transform(F.array_sort(F.array_distinct(F.transform(g, lambda x: x["c"]))), lambda c: F.struct(n.alias("n"), _at(names, c).alias("family"), most(g, c, "probability").alias("probability"), most(g, c, "overlap").alias("overlap")))
        return _let(good, each)

    none = F.array().cast("array<struct<n:int,family:string,probability:double,overlap:double>>")
    in_words = lambda h, n: _let(pairs_of(h), lambda pairs: F.when(F.arrays_overlap(pairs, own_), notices(h, pairs, n)).otherwise(none))
    in_paragraph = lambda p, n: _let(F.transform(F.array_remove(F.split(p, _GAP), ""), lambda x: F.xxhash64(x)), lambda h: in_words(h, n))
    return F.coalesce(F.flatten(F.transform(F.split(F.lower(text), _BLANK), in_paragraph)), none)


def sample_negatives(documents: DataFrame, n_documents: int = SAMPLED_DOCUMENTS, bound: int = NEGATIVES) -> list[list[str]]:
    """Windows of ordinary words, at most `bound`, from at most n_documents distinct texts without a legal term: the same in any order of rows."""
    d = documents.select("text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull() & ~_let(F.lower("text"), _any))
    last = d.select("h").distinct().orderBy("h").limit(n_documents).agg(F.max("h").alias("h")).first().h
    if last is None:
        return []
    w = F.array_remove(F.split(F.lower("text"), _GAP), "")
    d = d.where(F.col("h") <= last).select(w.alias("w")).where(F.size("w") > 0)
    size = 2 * RADII[-1] + 1
    d = d.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(size)), lambda i: F.slice("w", i, size))).alias("w")).distinct()
    return [r.w for r in d.orderBy(F.xxhash64("w"), "w").limit(bound).collect()]


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Confirmed notices: doc_id, n (paragraph from 0), family, probability and overlap (the largest of its windows).

    Each row is judged by itself, repeated rows alike. Null, empty and blank texts have none. Ties between families go to
    the first by name. An empty table gives an empty result; other columns are ignored.
    """
    model = model or train(sample_negatives(documents))
    return documents.select("doc_id", F.explode(found(F.col("text"), model)).alias("x")).select("doc_id", "x.*")


def scan_documents(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, n_paragraphs, n_licensed (longs), families (sorted, comma-joined), probability (largest, or null).

    Every input row gets one row, repeated rows the same one. A null text has no paragraphs; an empty or blank one has
    one, without a notice.
    """
    model = model or train(sample_negatives(documents))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", _BLANK))).cast("long")
    d = documents.select("doc_id", n.alias("n_paragraphs"), F.explode(F.array(found(F.col("text"), model))).alias("found"))
    return d.select(
        "doc_id", "n_paragraphs", F.size(F.array_distinct("found.n")).cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct("found.family")), ",").alias("families"), F.round(F.array_max("found.probability"), 6).alias("probability"),
    )
