"""Licence scans: the native judgement against plain Python, whole notices, and phrasings that the model never saw."""

import re
import textwrap

import numpy as np
import pytest

from phenoquarry.llm import licences as L

# Notices of the sample tables, and the MIT text.
NOTICES = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


@pytest.fixture(scope="module")
def model(documents):
    return L.train(L.sample_negatives(documents))


def plain(text, model):
    """{(n, family): (probability, overlap)} by loops over windows."""
    out = {}
    hashes, shares, of = L._comparison(model)
    for n, p in enumerate(re.split(L._BLANK, (text or "").lower())):
        ws = L.words_of(p)
        for i, w in enumerate(ws):
            if any(t in w for t in L.TERMS):
                for r in L.RADII:
                    window = ws[max(0, i - r) : i + r + 1]
                    p = model.probabilities(window)
                    k = int(np.argmax(p)) - 1
                    if k < 0 or p[k + 1] < L.LEAST_PROBABILITY:
                        continue
                    pairs = {L._signed(x) for x in L._chain(window)[1]}
                    overlap = max(sum(s for h, s in zip(hashes[t], shares[t]) if h in pairs) for t in of[k])
                    if overlap >= L.LEAST_OVERLAP:
                        was = out.get((n, model.families[k]), (0, 0))
                        out[(n, model.families[k])] = (max(was[0], p[k + 1]), max(was[1], overlap))
    return out


def families(spark, model, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.families for r in L.scan_documents(d, model).orderBy("doc_id").collect()]


def test_scan_equals_loops(rows, documents, model):
    got = {}
    for r in L.scan(documents, model).collect():
        assert got.setdefault((r.doc_id, r.n, r.family), (r.probability, r.overlap)) == (r.probability, r.overlap)
    want = {(i, n, f): x for i, t, _ in rows for (n, f), x in plain(t, model).items()}
    assert got.keys() == want.keys() and len(got) > 3
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=1e-9)


def test_documents(rows, documents, model):
    got = L.scan_documents(documents, model).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _ in rows:
        by.setdefault(i, t)
    for r in got:
        if r.doc_id is None:  # two rows
            continue
        text = by[r.doc_id]
        assert r.n_paragraphs == (0 if text is None else len(re.split(L._BLANK, text)))
        if r.doc_id < 9000:
            assert r.families == ",".join(sorted({v for k, v in NOTICES.items() if k in text.split("\n")}))
            assert (r.n_licensed > 0) == (r.probability is not None) == bool(r.families)
    assert {r.doc_id: r.families for r in got}[9008] == "apache,mit"
    assert L.scan_documents(documents.limit(0)).count() == 0 and L.sample_negatives(documents.limit(0)) == []


def test_whole_notices_however_they_stand(spark, model):
    noise = "anat with by of nteres atre are thnt eringing onheed " * 500
    wrapped = "\n".join("# " + x for part in MIT.split("\n\n") for x in [*textwrap.wrap(part, 76), ""])
    warranty = "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    got = families(spark, model, MIT, wrapped, noise + "Released under the MIT License. " + noise, noise + MIT.replace("\n\n", " ") + noise, warranty, "This software is MIT licensed.", "// SPDX-License-Identifier: MIT\n", "This tool and its data are distributed under the Apache License 2.0 by the authors")
    assert got == ["mit", "mit", "mit", "mit", "gpl", "mit", "mit", "apache"]
    assert L.scan(spark.createDataFrame([(1, MIT)], "doc_id int, text string"), model).count() == 3


def test_what_is_no_notice(spark, model):
    texts = ["The author did not release this under the MIT License.", "He lost his dog license and the permission to hunt.", "Copyright 2020 Foo. All rights reserved.", "the warranty of the car", "a licensed driver under the bridge", "we never licensed it under the ISC License"]
    assert families(spark, model, *texts) == [""] * len(texts)


def test_every_clause_has_a_legal_term():
    own = L.templates()
    assert all(x in own[k] for k, (_, _, clauses) in L.FAMILIES.items() for x in clauses)


def test_calibration_on_unseen_phrasings(model):
    """Phrasings of neither the weights nor the temperature: accuracy, and how far probabilities are from it."""
    rows = [(f"You may use this under the {n}", k) for k, (names, _, _) in L.FAMILIES.items() for n in names] + [(f"the code will not be released to anyone under the {n}", L.UNKNOWN) for names, _, _ in L.FAMILIES.values() for n in names[:1]]
    rows += [(x, L.UNKNOWN) for x in ("his fishing license expired", "a warrant for his arrest", "copyright lawyers met in Paris", "the press asked permission to film", "product liability insurance")]
    p = [model.probabilities(L.words_of(t)) for t, _ in rows]
    names = [L.UNKNOWN, *model.families]
    right = [names[int(np.argmax(x))] == k for x, (_, k) in zip(p, rows)]
    sure = [float(x.max()) for x in p]
    assert np.mean(right) > 0.75 and abs(np.mean(sure) - np.mean(right)) < 0.2


def test_parts_of_notices_without_a_legal_term(spark, model):
    """Every word has its windows: parts of notices that hold no legal term, alone and inside other words."""
    noise = "anat with by of nteres atre are thnt eringing onheed " * 40
    parts = {
        "shall be included in all copies or substantial portions of the Software": "mit", "copies of the Software, and to permit persons to whom the Software is furnished to do so": "mit",
        "with or without modification, are permitted provided that the following conditions are met": "bsd", "Released under CC BY 4.0.": "cc-by", "released under the MIT": "mit", "You should have received a copy of the GNU General Public": "gpl",
    }
    assert not any(t in x.lower() for x in parts for t in L.LEGAL)
    assert families(spark, model, *parts) == list(parts.values())
    assert families(spark, model, *(noise + x + " " + noise for x in parts)) == list(parts.values())
    assert families(spark, model, "researchers from MIT and Stanford", "shall be included in the price", "published by the Free Software Foundation", noise) == [""] * 4


def test_key_pairs_are_in_whatever_may_be_confirmed(model):
    hashes, shares, _ = L._comparison(model)
    keys = L._keys(hashes, shares)
    assert all(sum(x for h, x in zip(*t) if h not in keys) < L.LEAST_OVERLAP for t in zip(hashes, shares))
    assert len(keys) < len({h for t in hashes for h in t})


def test_dense_text_equals_loops(spark, model):
    """All clauses in one paragraph, in order and shuffled: windows with many known words, at both ends, and ones that share key pairs."""
    clauses = [x for _, _, own in L.FAMILIES.values() for x in own]
    words = " ".join(clauses).split()
    texts = [" ".join(clauses), " ".join(clauses[::-1]), " filler words here ".join(clauses), " ".join(words[::-1]), "MIT license", "license", "MIT", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.n, r.family): (r.probability, r.overlap) for r in L.scan(d, model).collect()}
    want = {(i, n, f): x for i, t in enumerate(texts) for (n, f), x in plain(t, model).items()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k] == pytest.approx(x, abs=1e-9) for k, x in want.items())
