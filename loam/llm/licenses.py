"""Licence families of paragraphs, by a trained classifier (operator 5).

DataFrame operations only on the rows. A paragraph is a line. Its features are the word
1- to 3-grams that hold a word of the licence vocabulary: the words of the training
notices that are not frequent in other training texts. A multinomial logistic regression,
trained here on clauses, on notices put together from names and phrases, and on a bounded
sample of other paragraphs, weighs them. A line without any vocabulary word has no
feature and so is "none", whose bias is the largest: the first pass, one regular
expression over the lower-cased text, leaves out only such lines. A temperature fitted on
notices of other phrasing than the training ones calibrates the probabilities; what is a
licence notice but of no family with enough probability is "unknown". A prediction is
confirmed if enough of the paragraph's bigrams occur in a template of its family.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
#: Paragraphs of the corpus to learn "none" from, about, and characters of each; training settings.
SAMPLE, SAMPLE_CHARS, ROUNDS, SEED = 400, 2000, 120, 11
#: Least calibrated probability of a family, and of the best class for a notice at all; least share of bigrams found in a template.
SURE, NOTICE, CONFIRMED = 0.6, 0.2, 0.5
#: By family: names, identifiers, and sentences of the licence text.
FAMILIES = {
    "mit": (["MIT License", "MIT Licence", "Expat License"], ["MIT"], [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ]),
    "apache": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License", "Apache License"], ["Apache-2.0", "Apache-1.1"], [
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions.",
        "If the Work includes a NOTICE text file as part of its distribution, then any Derivative Works that You distribute must include a readable copy of the attribution notices contained within such NOTICE file.",
    ]),
    "gpl": (["GNU General Public License", "GNU GPL", "GNU General Public License, version 3", "GNU General Public License version 2", "GPLv3", "GPLv2", "GPL"], ["GPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0", "GPL-2.0"], [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, write to the Free Software Foundation.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice.",
        "You must license the entire work, as a whole, under this License to anyone who comes into possession of a copy.",
    ]),
    "lgpl": (["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "GNU Lesser General Public License, version 2.1"], ["LGPL-2.1-or-later", "LGPL-3.0", "LGPL-2.1"], [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "See the GNU Lesser General Public License for more details.",
    ]),
    "agpl": (["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "Affero General Public License"], ["AGPL-3.0", "AGPL-3.0-or-later"], [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ]),
    "bsd": (["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "BSD-style license", "New BSD License", "Simplified BSD License"], ["BSD-3-Clause", "BSD-2-Clause"], [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages, including procurement of substitute goods or services; loss of use, data, or profits; or business interruption, however caused.",
    ]),
    "isc": (["ISC License", "ISC Licence", "Internet Systems Consortium License"], ["ISC"], [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits.",
    ]),
    "mpl": (["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL"], ["MPL-2.0", "MPL-1.1"], [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org MPL 2.0.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
        "Covered Software is provided under this License on an as is basis, without warranty of any kind.",
    ]),
    "epl": (["Eclipse Public License", "Eclipse Public License v2.0", "Eclipse Public License - v 1.0", "EPL 2.0"], ["EPL-2.0", "EPL-1.0"], [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
        "The accompanying program is provided under the terms of this Eclipse Public License; any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.",
    ]),
    "eupl": (["European Union Public Licence", "EUPL", "EUPL v1.2"], ["EUPL-1.2"], [
        "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL.",
        "You may not use this work except in compliance with the Licence of the European Union.",
    ]),
    "cddl": (["Common Development and Distribution License", "CDDL", "CDDL 1.0"], ["CDDL-1.0"], [
        "The contents of this file are subject to the terms of the Common Development and Distribution License.",
        "When distributing Covered Code, include this CDDL HEADER in each file and include the License file.",
    ]),
    "artistic": (["Artistic License", "Artistic License 2.0", "Perl Artistic License"], ["Artistic-2.0"], [
        "You can redistribute it and/or modify it under the same terms as Perl itself.",
        "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package.",
    ]),
    "boost": (["Boost Software License", "Boost Software License, Version 1.0"], ["BSL-1.0"], [
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at boost.org LICENSE_1_0.txt.",
        "Unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ]),
    "zlib": (["zlib License", "zlib/libpng License"], ["Zlib"], [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ]),
    "unlicense": (["Unlicense", "The Unlicense"], ["Unlicense"], [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ]),
    "wtfpl": (["WTFPL", "Do What The Fuck You Want To Public License"], ["WTFPL"], ["You just do what the fuck you want to."]),
    "cc-by": (["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY", "CC BY 3.0"], ["CC-BY-4.0", "CC-BY-3.0"], [
        "You must give appropriate credit, provide a link to the license, and indicate if changes were made, under Creative Commons Attribution.",
    ]),
    "cc-by-sa": (["Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA"], ["CC-BY-SA-4.0"], [
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original, ShareAlike.",
    ]),
    "cc-by-nc": (["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC", "CC BY-NC 2.5"], ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"], [
        "You may not use the material for commercial purposes under Creative Commons NonCommercial.",
    ]),
    "cc-by-nd": (["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND"], ["CC-BY-ND-4.0"], [
        "If you remix, transform, or build upon the material, you may not distribute the modified material, NoDerivatives.",
    ]),
    "public-domain": (["CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero", "CC0"], ["CC0-1.0"], [
        "This work is in the public domain.", "The author has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
        "Released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ]),
    "ofl": (["SIL Open Font License", "SIL Open Font License, Version 1.1", "Open Font License"], ["OFL-1.1"], [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "The Font Software may be sold as part of a larger software package but no copy of one or more of the Original or Modified Versions may be sold by itself.",
    ]),
    "odbl": (["Open Database License", "Open Data Commons Open Database License", "ODbL"], ["ODbL-1.0"], [
        "This database is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License.",
    ]),
    "postgresql": (["PostgreSQL License", "PostgreSQL Licence"], ["PostgreSQL"], [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    ]),
    "python": (["Python Software Foundation License", "PSF License", "Python License"], ["PSF-2.0", "Python-2.0"], [
        "PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version.",
    ]),
    "ms-pl": (["Microsoft Public License", "Ms-PL", "Microsoft Reciprocal License"], ["MS-PL", "MS-RL"], [
        "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",
    ]),
    "proprietary": ([], [], [
        "All rights reserved.", "Copyright (c) 2020 Example Corporation. All rights reserved.", "Copyright 2011 by the publisher. All rights reserved worldwide.",
        "No part of this publication may be reproduced, stored in a retrieval system or transmitted in any form or by any means without the prior written permission of the copyright holder.",
        "This document contains confidential and proprietary information and may not be disclosed without written consent.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ]),
}
#: How notices name a licence: to learn from, and to calibrate on.
PHRASES = [
    "Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "The code is available under the {}.",
    "{}", "License: {}", "This software is released under the {} and may be used freely.", "See the {} for details.",
]
HELD_PHRASES = ["All files here are covered by the {}.", "Published under {} terms.", "Its source is offered to you under the {}, see LICENSE.", "Use is governed by the {}."]
ID_PHRASES = ["SPDX-License-Identifier: {}", "license = {}"]
UNKNOWN_NAMES = [
    "Community License", "Acme Software License", "Example Open License", "Research License Agreement", "University License", "Sample Public License", "Vendor License", "Custom License, Version 1.0",
    "Foo General License", "Partner License", "Evaluation License", "Shared Source License", "Enterprise License Agreement", "Academic Free Software Terms",
]
UNKNOWN_NOTICES = [
    "Licensed under terms that are available on request.", "See the LICENSE file for details.", "Use of this work is subject to the license agreement of its publisher.", "This software is released under its own license.",
    "Copyright 2019 the authors.", "Copyright (c) 2004 John Doe", "Copyright 1999 by J. Smith", "(c) Copyright 2011 Example", "Copyright (c) 2007", "See COPYING for license terms.", "For license information see the file LICENSE in the root directory.",
]
OTHER = [
    "He lost his driving licence and asked for permission to leave.", "The licence plate of the car was found near the house.", "The product comes with a warranty of two years.", "She granted permission to enter the building.",
    "An artist may take poetic license with facts.", "Copyright law has changed and all rights of tenants were discussed in court.", "A new licence to trade under the general public transport scheme was issued.",
    "The software was easy to use and the distribution of copies went well.", "The board of the foundation published a free version of its report.", "His right to use the land was subject to conditions.",
    "The government granted the company a license to drill for oil.", "Her work was published under a new name.", "Members of the public may use the library free of charge.", "The terms of the agreement were made available to the press.",
    "The material was provided by the author for the following purpose.", "All profits were lost because of the damage to the source.", "Any person may apply for a fishing license at the office.", "The original document was modified without notice.",
    "The apache helicopter landed near the eclipse viewing site.", "He studied at MIT and later joined a public company.", "The mozilla browser and the python snake were described in the article.", "Common law and the development of the European union were topics.",
    "The rights of workers were reserved for a later debate.", "A boost of the artistic program under the new director was reported.", "The bank must license its agents.",
]
#: Words too usual to point to a notice.
STOP = frozenset("a an and any are as at be been but by can do for from has have he her his if in into is it its may more most must no not of on one or other our out part she so such that the their them then there these they this to two was we were what when which who will with without you your under over all each either being even just along alone about after before via doe test".split())


def templates() -> dict[str, list[str]]:
    """By family, what a confirmed paragraph's bigrams must come from."""
    return {f: [*(p.format(n) for p in PHRASES for n in names), *(p.format(i) for p in ID_PHRASES for i in ids), *clauses] for f, (names, ids, clauses) in FAMILIES.items()}


def tokens_of(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(line), r"[^a-z0-9.]+"), lambda w: F.btrim(w, F.lit("."))), lambda w: F.length(w) > 0)


def _tokens(line: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(r"[^a-z0-9.]+", line.lower())) if w]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def grams_of(line: Column) -> Column:
    """Distinct word 1- to 3-grams of a line. The words are bound once, not found again for each gram."""
    at = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(tokens_of(line)), lambda w: F.array_distinct(F.concat(w, at(w, 2), at(w, 3)))), 1)


def pattern_of(words: list[str]) -> str:
    """A regular expression that finds any of the words at its start in lower-cased text, as a tree of letters."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        if "" in node:  # the word ends here: whatever follows, it is found
            return ""
        parts = [re.escape(c) + write(n) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return rf"(?<![a-z0-9]){write(tree)}" if words else r"(?!)"


class Model:
    """classes; weight: by gram, one number a class; bias; temperature; vocabulary."""

    def __init__(self, classes: list[str], weight: dict[str, np.ndarray], bias: np.ndarray, temperature: float, vocabulary: set[str]):
        self.classes, self.weight, self.bias, self.temperature, self.vocabulary = classes, weight, bias, temperature, vocabulary


def train(others: list[str]) -> Model:
    """others: paragraphs of the corpus."""
    pick = random.Random(SEED)
    classes = [*FAMILIES, UNKNOWN, NONE]
    notices = [(f, t) for f, ts in templates().items() for t in ts]
    unknown = [(UNKNOWN, t) for t in UNKNOWN_NOTICES] + [(UNKNOWN, p.format(n)) for p in PHRASES for n in UNKNOWN_NAMES]
    pairs = {g for _, t in notices + unknown for g in _grams(_tokens(t)) if g.count(" ") == 1}
    others = [t for t in others if len(pairs & _grams(_tokens(t))) <= 0.25 * len(_tokens(t))]  # these may be notices themselves
    plain = [_tokens(t) for t in [*OTHER, *others]]
    seen = [set(_tokens(t)) for _, t in notices + unknown]
    often = lambda sets, w: sum(w in s for s in sets) / max(1, len(sets))
    elsewhere = [set(w) for w in (_tokens(t) for t in others)]
    vocabulary = {w for w in set().union(*seen) - STOP if (len(w) > 2 or w == "cc") and not w.replace(".", "").isdigit() and often(elsewhere, w) <= 0.1 * max(often(seen, w), 0.02)}
    holds = lambda g: any(w in vocabulary for w in g.split(" "))
    rows: list[tuple[int, list[str], bool]] = []

    def put(c: str, words: list[str], held: bool = False) -> None:
        rows.append((classes.index(c), [g for g in _grams(words) if holds(g)], held))

    for c, t in notices + unknown:
        words = _tokens(t)
        put(c, words)
        if len(words) > 12:  # a clause: parts of it, as lines may be broken anywhere
            for _ in range(6):
                n = pick.randrange(8, max(9, len(words)))
                at = pick.randrange(len(words) - n + 1)
                put(c, words[at : at + n])
        elif others:
            around = _tokens(pick.choice(others))[:8]
            put(c, around[:4] + words + around[4:])
    for phrase in HELD_PHRASES:
        for f, (names, _, _) in FAMILIES.items():
            for n in names:
                put(f, _tokens(phrase.format(n)), True)
        for n in UNKNOWN_NAMES:
            put(UNKNOWN, _tokens(phrase.format(n)), True)
    words = sorted(vocabulary)
    for w in words:  # a word or two of the vocabulary in other prose is no notice
        put(NONE, [w])
        put(NONE, ["the", w, "of", pick.choice(words)])
    for t in plain:
        for part in (t, t[: len(t) // 2], t[len(t) // 2 :]):
            put(NONE, part)
    kept = [r for r in rows if r[1] and not r[2]]
    number = {g: i for i, g in enumerate(sorted({g for _, gs, _ in kept for g in gs}))}
    x = np.zeros((len(kept), len(number)), np.float32)
    for i, (_, gs, _) in enumerate(kept):
        x[i, [number[g] for g in gs]] = 1 / math.sqrt(len(gs))
    y = np.zeros((len(kept), len(classes)), np.float32)
    y[np.arange(len(kept)), [c for c, _, _ in kept]] = 1
    share = 1 / np.sqrt(y.sum(0) + 1)  # classes with few examples count for more
    each = (y @ share)[:, None]
    each /= each.sum()
    w, b = np.zeros((len(number), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[-1] = 1.0  # what has no feature is none
    speed = np.zeros_like(w)
    for _ in range(ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed + x.T @ ((y - p) * each) - 1e-6 * w
        w += 40 * speed
    best = (math.inf, 1.0)
    weight = {g: w[i].astype(float).round(6) for g, i in number.items()}
    model = Model(classes, weight, b.astype(float), 1.0, vocabulary)
    scores = [(c, logits(model, gs)) for c, gs, held in rows if held]
    for temperature in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
        loss = -sum(math.log(max(softmax(z / temperature)[c], 1e-12)) for c, z in scores)
        best = min(best, (loss, temperature))
    model.temperature = best[1]
    return model


def logits(model: Model, grams: list[str] | set[str]) -> np.ndarray:
    """Of a line's grams; those without weight do not count."""
    known = [model.weight[g] for g in sorted(grams) if g in model.weight]
    return model.bias + (sum(known) / math.sqrt(len(known)) if known else 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def sample_of_others(docs: DataFrame) -> list[str]:
    """First lines of texts, about SAMPLE of them, chosen by a threshold on their hash: what
    reaches the driver does not grow with docs."""
    line = F.substring(F.substring_index(F.col("text").cast("string"), "\n", 1), 1, SAMPLE_CHARS)
    first = docs.select(line.alias("line")).where("length(line) > 0")
    n = docs.where(F.col("text").isNotNull()).count()
    part = min(1.0, SAMPLE / max(1, n))
    rows = first.where(F.pmod(F.xxhash64("line"), F.lit(1 << 30)) < int(part * (1 << 30))).distinct().collect()
    return sorted(r.line for r in rows)


def license_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """_id, _th (hash of the text), line (from 0), family, probability, overlap, confirmed: the
    paragraphs that are licence notices, of a family or unknown."""
    spark = docs.sparkSession
    model = model or train(sample_of_others(docs))
    c = len(model.classes)
    two = {f: {g for t in ts for g in _grams(_tokens(t)) if g.count(" ") == 1} for f, ts in templates().items()}
    rows = []
    for g in sorted(set(model.weight) | set().union(*two.values())):
        w = model.weight.get(g)
        rows += [(g, k, float(w[k]) if w is not None else 0.0, w is not None, k < len(FAMILIES) and g in two[model.classes[k]]) for k in range(c) if w is not None or (k < len(FAMILIES) and g in two[model.classes[k]])]
    # bounded by the training texts: their grams, by classes
    table = F.broadcast(spark.createDataFrame(rows, "gram string, k int, w double, counts boolean, template boolean").groupBy("gram").agg(F.max("counts").alias("counts"), F.collect_list(F.struct("k", "w", "template")).alias("ws")))
    text = F.col("text").cast("string")
    gate = pattern_of(sorted(model.vocabulary))
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text")).where(F.lower(text).rlike(gate))
    lines = base.select("_id", F.xxhash64("text").alias("_th"), F.posexplode(F.split("text", "\n", -1)).alias("line", "t")).where(F.lower("t").rlike(gate))
    # dealt by line and in a stated number of partitions, so that few lines with many grams are not one task's
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = lines.repartition(n, "_id", "_th", "line").dropDuplicates(["_id", "_th", "line"]).select("_id", "_th", "line", grams_of(F.col("t")).alias("grams"))
    g = g.withColumn("twos", F.size(F.filter("grams", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) == 1)))  # before the explode, which would have it done for each gram
    hit = g.select("_id", "_th", "line", "twos", F.explode("grams").alias("gram")).join(table, "gram")
    each = hit.select("_id", "_th", "line", "twos", "counts", F.explode("ws").alias("x"))
    by_class = each.groupBy("_id", "_th", "line", "x.k").agg(F.first("twos").alias("twos"), F.sum("x.w").alias("s"), F.count_if("counts").alias("n"), F.count_if("x.template").alias("o"))
    summed = by_class.groupBy("_id", "_th", "line").agg(F.first("twos").alias("twos"), F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("s", "o")))).alias("m"))
    bias = F.array(*[F.lit(float(b)) for b in model.bias])
    z = F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda k: F.round((F.get(F.col("bias"), k) + F.coalesce(F.try_element_at(F.col("m"), k)["s"], F.lit(0.0)) / F.sqrt(F.greatest(F.col("n"), F.lit(1)))) / model.temperature, 9))
    p = summed.withColumn("bias", bias).withColumn("z", z).withColumn("top", F.array_max("z")).withColumn("p", F.expr("transform(z, x -> exp(x - top) / aggregate(z, 0D, (a, y) -> a + exp(y - top)))"))
    ranked = p.withColumn("k", F.array_position("z", F.col("top")).cast("int")).withColumn("none", F.element_at("p", c)).withColumn("best", F.element_at("p", F.col("k")))
    ranked = ranked.where((F.col("k") < c) & (F.col("none") < 0.5) & (F.col("best") >= NOTICE))
    family = F.when((F.col("k") <= len(FAMILIES)) & (F.col("best") >= SURE), F.element_at(F.array(*map(F.lit, model.classes)), F.col("k"))).otherwise(UNKNOWN)
    overlap = F.when(F.col("twos") > 0, F.coalesce(F.try_element_at(F.col("m"), F.col("k") - 1)["o"], F.lit(0)) / F.col("twos")).otherwise(F.lit(0.0))
    out = ranked.select("_id", "_th", "line", family.alias("family"), F.col("best").alias("probability"), overlap.alias("overlap"))
    return out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("overlap") >= CONFIRMED))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_paragraphs, n_notices, n_confirmed, families (distinct
    families of its notices in order, joined by commas; unknown among them; '' without notice).

    docs needs doc_id and text; other columns are left out, whatever their names. Null and
    empty texts have one paragraph and no notice; rows that repeat stay; very long texts are
    taken whole; an empty table gives an empty one."""
    text = F.col("text").cast("string")
    found = license_paragraphs(docs).groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("n_notices"), F.count_if("confirmed").alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_lth"), F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_paragraphs"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_lth") == F.col("_th")), "left")
    return out.select("doc_id", "n_paragraphs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_notices", "n_confirmed")], F.coalesce("families", F.lit("")).alias("families"))
