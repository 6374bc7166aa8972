import math
import re

import numpy as np
import pytest

from loam.llm import licenses as l

from .conftest import edge_rows, prose

#: Lines of no phrasing that was trained on, and their families.
HELD_OUT = {
    "Licensed under the Eclipse Public License v2.0": "epl", "Copyright law has changed and all rights of tenants are affected": "", "a new licence to trade under the General Public transport scheme": "",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc", "THE SOFTWARE IS PROVIDED AS IS, IN NO EVENT SHALL THE AUTHORS BE LIABLE": "mit",
    "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium": "apache", "This file is part of Foo, which is free software; you may redistribute it under the GNU GPL, version 2 or later": "gpl",
    "Covered by the Mozilla Public License 2.0, a copy of which is in LICENSE": "mpl", "Code in this repository is MIT licensed": "mit", "Dual-licensed: you can choose the Apache License 2.0": "apache",
    "Fonts come with the SIL Open Font License": "ofl", "This package is under a BSD-style license that can be found in the LICENSE file.": "bsd", "Text is under Creative Commons Attribution-ShareAlike 3.0 unless stated": "cc-by-sa",
    "Photos: CC BY-NC 3.0": "cc-by-nc", "The Frobnicate License applies to all files": "unknown", "Copyright 2003 Jane Roe": "unknown", "He was granted a license to practise medicine in the state": "",
    "The court held that the software patent was invalid and liable": "", "You need the permission of the owner to copy the key": "", "All rights are reserved by law to the crown in such cases of land": "",
    "All rights reserved by the publisher.": "proprietary", "Free software is a matter of liberty, not price.": "", "This is in the public domain in the United States": "public-domain",
    "We use cookies; by using this site you accept the terms and conditions": "", "The warranty covers parts and labour for two years": "", "licensed under lgpl 3": "lgpl", "AGPL-3.0 licensed server": "agpl", "license: Boost Software License 1.0": "boost",
}


@pytest.fixture(scope="module")
def model():
    import random

    rng = random.Random(2)
    return l.train([prose(rng, 30) for _ in range(100)])


def brute(line, model):
    """Family and whether confirmed, or None."""
    words = [w.strip(".") for w in re.findall("[a-z0-9.]+", line.lower()) if w.strip(".")]
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    known = sorted(g for g in grams if g in model.weight)
    if not known:
        return None
    z = [round((b + math.fsum(model.weight[g][k] for g in known) / math.sqrt(len(known))) / model.temperature, 9) for k, b in enumerate(model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    p = [v / sum(e) for v in e]
    k = z.index(max(z))
    if k == len(z) - 1 or p[-1] >= 0.5 or p[k] < l.NOTICE:
        return None
    if k >= len(l.FAMILIES) or p[k] < l.SURE:
        return l.UNKNOWN, False
    family = list(l.FAMILIES)[k]
    two = {g for g in grams if g.count(" ") == 1}
    held = [" ".join(re.findall("[a-z0-9.]+", t.lower())) for t in l.templates()[family]]
    held = [" " + " ".join(w.strip(".") for w in t.split() if w.strip(".")) + " " for t in held]
    found = sum(any(f" {g} " in t for t in held) for g in two)
    return family, bool(two) and found / len(two) >= l.CONFIRMED


def test_against_brute_force(spark, model):
    notices = [t for ts in l.templates().values() for t in ts][::3] + l.UNKNOWN_NOTICES + l.OTHER + list(HELD_OUT)
    lines = [*notices, "plain words and nothing else", "", "LICENSE", "(c)", "..license.. mit.", "Keep the LICENſE", "a warranty", "mit " * 3000]
    rows = [(i, x if i % 3 else f"some first line of prose here\n{x}\nand a last one") for i, x in enumerate(lines)]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, rows[4]]], "doc_id long, text string, families string").repartition(3)
    want = {(i, n): v for i, t in rows for n, x in enumerate(t.split("\n")) if (v := brute(x, model))}
    got = {(r._id, r.line): (r.family, r.confirmed) for r in l.license_paragraphs(df, model).collect()}
    assert got == want and len(want) > 50


def test_scan_counts_paragraphs(spark):
    rows = [(1, "x\nReleased under the MIT License.\n\nAll rights reserved.\nReleased under the MIT License."), (1, "Released under the MIT License."), (2, "no notice\nat all"), (3, None)]
    got = sorted(map(tuple, l.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, 1, 1, "mit"), (1, 5, 3, 3, "mit,proprietary"), (2, 2, 0, 0, ""), (3, 1, 0, 0, "")]


def test_held_out_phrasing(model):
    trained = {t for ts in l.templates().values() for t in ts} | {p.format(n) for p in l.HELD_PHRASES for ns, _, _ in l.FAMILIES.values() for n in ns}
    assert not trained & set(HELD_OUT)
    got = {x: (v or ("",))[0] for x in HELD_OUT for v in [brute(x, model)]}
    right = sum(got[x] == f for x, f in HELD_OUT.items())
    notices = [x for x, f in HELD_OUT.items() if f]
    found = sum(bool(got[x]) for x in notices)
    wrong = sum(bool(got[x]) for x, f in HELD_OUT.items() if not f)
    assert right >= 0.85 * len(HELD_OUT) and found >= 0.85 * len(notices) and wrong <= 2, (right, found, wrong)


def test_nothing_is_left_out_by_the_first_pass(model):
    assert all(model.bias[-1] > b for b in model.bias[:-1])
    gate = re.compile(l.pattern_of(sorted(model.vocabulary)))
    for g in model.weight:
        assert gate.search(g), g
    words = sorted(model.vocabulary)
    assert all(gate.search(f"x {w}") and gate.search(f".{w}.") for w in words)
    assert np.argmax(l.logits(model, {"nothing known"})) == len(model.classes) - 1
    assert not re.search(l.pattern_of([]), "a b c")


def test_edges(edge, none):
    got = l.license_scan(edge).collect()
    texts = {r[0]: r[1] for r in edge_rows() if r[0] is not None}
    assert len(got) == len(edge_rows())
    assert all(r.n_paragraphs == (texts[r.doc_id] or "").count("\n") + 1 for r in got if r.doc_id is not None)
    assert l.license_scan(none).count() == 0
