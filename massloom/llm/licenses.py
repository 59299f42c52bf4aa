"""License scans by a trained paragraph classifier, with an unknown class and template comparison.

Lines that hold a licensing word or name (ANCHORS, which all training notices hold; notices in other languages pass by
such a word or name alone) are scored, comment marks stripped. Notices wrapped over lines are scored as a paragraph as
well: lines with an anchor that stand at most GAP lines apart with no blank line between them, and the line on either
side. A paragraph counts beside its lines only if none of them is confirmed as its family.

The classifier is a multinomial logistic regression over hashed word 1- to 3-grams that occur in its training rows:
notices made from templates, sentences that only sound like notices, sentences about a licence that grant nothing, and
notices of licences that are known but no family of ours (OTHERS); the last three are the unknown class. It is calibrated
by a temperature fitted on held-out rows, and a text whose best family has less than MIN_CHANCE is unknown as well.

The template comparison confirms a predicted family in one of two ways. The text holds one of the family's names, word for
word. Or it has MIN_SHARED of the word pairs of one of the family's sentences, a larger share than of any sentence of
another family, and no other family's name. A header's line that several families have thus confirms none of them.
The BSD texts of two and of three clauses count as one family.

Training reads at most MAX_TRAINING labelled rows on the driver (features are computed by the same expressions that scan
texts). Scanning is DataFrame functions on each row: the weights are one literal array a family, whose size BUCKETS
bounds, so nothing is joined or moved.

Edge cases: null, empty and blank texts have no paragraph and no family; repeated rows are scanned alike; only id and
text are read, so that other columns and their names do not matter; of families with equal scores the first in NAMES is
predicted; an empty table gives an empty result; texts are read whole, in time in proportion to their length.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

UNKNOWN = "unknown"
BUCKETS = 1 << 15
MAX_TRAINING = 20_000
MIN_CHANCE = 0.6
STEPS = 250
#: Share of the word pairs of a template's sentence that a text must have.
MIN_SHARED = 0.5
#: Lines without an anchor that may stand between two lines of one paragraph.
GAP = 2

#: Words and names of licence notices, in lower case.
ANCHORS = ("licen", "copyright", "warrant", "redistribut", "rights reserved", "public domain", "creative commons", "permission", "spdx", "gpl", "bsd", "©", "cc by", "cc-by", "cc0", "apache", "mpl-", "mpl 2", "mpl/", "mozilla public", "free software", "share and adapt", "appropriate credit")
#: Names of so few letters that they are words of other languages in lower case.
CAPITALS = r"\bMIT\b"
#: Marks of comments around a line.
MARKS = r"^[\s#*/;%!<>|-]+|[\s#*/;%!<>|-]+$"

#: Names and characteristic sentences of licence families.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 License", "Apache-2.0", "Apache License v2.0", "Apache License, v2"],
    "mit": ["MIT License", "MIT license", "The MIT License (MIT)", "MIT"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "BSD-3-Clause", "modified BSD license"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2", "GNU General Public License v2.0", "GNU General Public License v2", "GPL version 2", "GPL v2", "GPL-2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3", "GNU General Public License v3.0", "GNU General Public License v3", "GPL version 3", "GPL v3", "GPL-3"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1", "LGPLv3", "GNU LGPL", "GNU Lesser General Public License, version 2.1", "LGPL-3.0", "LGPL version 2.1", "LGPL version 3", "LGPLv2.1"],
    "agpl-3.0": ["GNU Affero General Public License", "AGPL-3.0", "GNU AGPL v3", "GNU Affero General Public License, version 3", "AGPL version 3", "AGPL v3", "AGPLv3"],
    "mpl-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0 public domain dedication", "Unlicense", "public domain"],
    "all-rights-reserved": ["All rights reserved", "all rights reserved"],
}
SENTENCES = {
    "apache-2.0": ["You may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/."],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, provided that you give appropriate credit."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc-by-nc": ["You may not use the material for commercial purposes under the Creative Commons license."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "all-rights-reserved": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential, copyright reserved."],
}
OPENERS = ["Licensed under {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the terms of the {}.", "This software is distributed under the {}, see the LICENSE file.", "SPDX-License-Identifier: {}", "The code in this folder is available under the {}.", "License: {}", "Copyright 2019 the authors. Licensed under {}.", "Published under a {} license.", "All text is made available under {} unless noted otherwise."]
#: Licences that are no family of ours: names and sentences.
OTHERS = ["Eclipse Public License v2.0", "Eclipse Public License, Version 1.0", "EPL-2.0", "ISC License", "ISC", "Boost Software License, Version 1.0", "BSL-1.0", "zlib License", "Zlib", "Artistic License 2.0", "European Union Public Licence v1.2", "Common Development and Distribution License", "CC BY-ND 4.0", "Open Font License", "proprietary license of the vendor", "terms of the agreement"]
OTHER_SENTENCES = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."]
#: Sentences about a licence that grant nothing.
MENTIONS = ["We reviewed the terms of the {} in our law course.", "The {} was discussed at the meeting.", "She wrote an essay about the {}.", "He compared the {} with other texts.", "An article on the history of the {}.", "The court had to interpret the {}.", "Students read the {} in class.", "What does the {} say about patents?", "This talk explains the {}.", "Unlike the {}, this text has no such clause.", "The {} is often confused with others.", "A lawyer explained the {} to the authors."]
#: Sentences that have licensing words and license nothing.
DECOYS = ["His driving licence expires in {}.", "The {} licence office opens at nine.", "A fishing license costs {} a year.", "She asked for permission to leave the {}.", "Copyright law is taught in the {} term.", "The warranty on the {} covers two years.", "They redistribute the {} among the villages.", "The debate about copyright and {} goes on.", "A poetic license with the {} was taken.", "Please renew your {} license before May.", "The licensing of {} was discussed in parliament.", "The warrant was signed in {}.", "Permission slips for the {} are due.", "No licence is needed to sell {}.", "The committee will license new {} in spring.", "Our {} is under warranty.", "Public domain maps of {} are on the wall.", "The museum bought rights to the {}.", "License plates from {} were shown.", "Copyright infringement in {} is rising.", "The {} was licensed to drive buses.", "Redistribution of income in {} was small.", "The licence fee pays for {}.", "Version 3 of the {} licence test is harder.", "The general public of {} has no license.", "MIT students in {} asked for permission.", "He wrote about {} under license from the paper.", "Die Kinder gehen mit {} in die Schule und mit dem Boot.", "MIT DER UND DIE MIT DEM {} VON DEN", "Das ist mit {} nicht zu machen."]
FILLERS = ["spring", "the city", "Paris", "old maps", "music", "the garden", "water", "boats", "teachers", "history", "the north", "paintings", "bread", "radio", "the school", "schools and roads"]


def tokens(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit("[\\p{L}\\p{N}]+(?:[.+][\\p{N}]+)*"), F.lit(0))


def grams(ws: Column, n: int) -> Column:
    """The word n-grams of an array of words, as hashes."""
    count = F.size(ws) - (n - 1)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(ws, i + k) for k in range(n)]))


def features(ws: Column) -> Column:
    """Distinct buckets of the word 1- to 3-grams."""
    every = F.concat(grams(ws, 1), grams(ws, 2), grams(ws, 3))
    return F.array_distinct(F.transform(every, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")))


def training_rows() -> list[dict]:
    """Labelled notices, sentences and decoys; every fifth row of a kind is held out."""
    rows = []
    for family, names in NAMES.items():
        rows += [(family, o.format(n)) for n in names for o in OPENERS]
        rows += [(family, n) for n in names]
        rows += [(family, s) for s in SENTENCES[family] * 3]
        rows += [(family, f"{s} {o.format(n)}") for s in SENTENCES[family] for n in names for o in OPENERS[:3]]
        # a paragraph takes in what stands beside its notice
        plain = [d.format(f) for d, f in zip(DECOYS, FILLERS)]
        rows += [(family, f"{plain[i % len(plain)]} {s} {plain[-1 - i % len(plain)]}") for i, s in enumerate([OPENERS[i % len(OPENERS)].format(n) for i, n in enumerate(names)] + SENTENCES[family])]
    rows += [(UNKNOWN, d.format(f)) for d in DECOYS for f in FILLERS]
    rows += [(UNKNOWN, m.format(n)) for names in NAMES.values() for n in names for m in MENTIONS]
    rows += [(UNKNOWN, o.format(n)) for n in OTHERS for o in OPENERS] + [(UNKNOWN, t) for t in (OTHERS + OTHER_SENTENCES) * 3]
    return [{"family": f, "text": t, "held": i % 5 == 0} for i, (f, t) in enumerate(rows)][:MAX_TRAINING]


def _literal(values: list, kind: str) -> Column:
    """One literal array of many values: constant folding parses it once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


class Model(NamedTuple):
    """What training and templates give."""

    classes: list[str]
    weights: list[list[float]]  # by class and bucket, the bias last
    known: list[bool]  # buckets that training rows have
    temperature: float
    names: dict[str, list[str]]  # by family, words joined by blanks
    sentences: dict[str, list[list[int]]]  # by family, word pairs


@lru_cache(maxsize=4)
def _trained(spark: SparkSession) -> Model:
    import numpy as np

    data = training_rows()
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(data)), "array<struct<family:string,text:string,held:boolean>>")).alias("r"))
    got = table.select("r.family", "r.held", features(tokens(F.col("r.text"))).alias("x")).collect()
    classes = [UNKNOWN, *NAMES]
    used = sorted({i for r in got if not r.held for i in r.x})
    place = {bucket: k for k, bucket in enumerate(used)}
    xs = np.zeros((len(got), len(used) + 1), np.float32)
    for i, r in enumerate(got):
        known = [place[k] for k in r.x if k in place]
        xs[i, known] = 1 / max(1, len(known)) ** 0.5
        xs[i, -1] = 1
    y = np.array([classes.index(r.family) for r in got])
    held = np.array([r.held for r in got])
    hot = np.eye(len(classes), dtype=np.float32)[y]

    def chances(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    train = ~held
    balance = (1 / np.bincount(y[train], minlength=len(classes)))[y[train]][:, None]
    balance = (balance / balance.mean()).astype(np.float32)
    # gradient descent in the dual: the weights stay sums of rows, w = x' a, and products of rows are all it needs
    kernel = xs[train] @ xs[train].T
    a, v = np.zeros((int(train.sum()), len(classes)), np.float32), 0.0
    for _ in range(STEPS):
        v = 0.9 * v + balance * (chances(kernel @ a) - hot[train]) / len(a) + 1e-5 * a
        a -= 4.0 * v
    w = xs[train].T @ a
    temperatures = np.geomspace(0.25, 8, 60)
    losses = [-np.log(chances(xs[held] @ w / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in temperatures]
    full = np.zeros((BUCKETS + 1, len(classes)))
    full[[*used, BUCKETS]] = w
    flat = [{"family": f, "text": t, "name": name} for name, kind in ((True, NAMES), (False, SENTENCES)) for f, ts in kind.items() for t in ts]
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(flat)), "array<struct<family:string,text:string,name:boolean>>")).alias("r"))
    words = tokens(F.col("r.text"))
    names, sentences = {f: [] for f in NAMES}, {f: [] for f in NAMES}
    for r in made.select("r.family", "r.name", F.array_join(words, " ").alias("t"), F.array_distinct(grams(words, 2)).alias("p")).collect():
        (names if r.name else sentences)[r.family].append(r.t if r.name else list(r.p))
    known = [k in place for k in range(BUCKETS)]
    return Model(classes, [[round(float(v), 3) for v in full[:, k]] for k in range(len(classes))], known, float(temperatures[int(np.argmin(losses))]), names, sentences)


def classify(spark: SparkSession, paragraph: Column) -> Column:
    """A struct of family, chance, shared (1 with a name of the family, else the share of its best sentence) and confirmed."""
    m = _trained(spark)
    families = [f for f in m.classes if f != UNKNOWN]

    def of_words(ws: Column) -> Column:
        def of_features(x: Column) -> Column:
            scale = F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double"))
            total = lambda w: F.aggregate(x, F.lit(0.0), lambda s, i: s + F.get(_literal(w[:BUCKETS], "double"), i))
            logits = [total(w) / scale + w[BUCKETS] for w in m.weights]
            return F.transform(F.array(*logits), lambda z: z / F.lit(m.temperature))

        def of_logits(z: Column) -> Column:
            top = F.array_max(z)
            chance = 1 / F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
            k = F.when(chance >= MIN_CHANCE, F.array_position(z, top) - 1).otherwise(0)
            return F.struct(F.get(F.array(*map(F.lit, m.classes)), k.cast("int")).alias("family"), chance.alias("chance"))

        def of_best(best: Column) -> Column:
            pairs, text = F.array_distinct(grams(ws, 2)), F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))

            def named(t: Column, f: str) -> Column:
                long = [n for n in m.names[f] if len(n) > 3]
                out = [F.contains(t, F.lit(f" {n} ")) for n in long]
                return reduce(or_, out + ([F.rlike(paragraph, F.lit(CAPITALS))] if len(long) < len(m.names[f]) else []))

            def share(ps: Column, f: str) -> Column:
                return F.greatest(F.lit(0.0), *[F.size(F.array_intersect(ps, _literal(t, "bigint"))) / F.lit(len(t)) for t in m.sentences[f]])

            names = let(text, lambda t: F.array(*[F.when(named(t, f), F.lit(f)) for f in families]))
            shares = let(pairs, lambda ps: F.array(*[F.struct(share(ps, f).alias("s"), F.lit(f).alias("f")) for f in families]))

            def of_templates(ns: Column, ss: Column) -> Column:
                own = F.array_contains(ns, best["family"])
                mine = F.coalesce(F.get(F.filter(ss, lambda e: e["f"] == best["family"]), 0)["s"], F.lit(0.0))
                rest = F.coalesce(F.array_max(F.filter(ss, lambda e: e["f"] != best["family"]))["s"], F.lit(0.0))
                sentence = (mine >= MIN_SHARED) & (mine > rest) & (F.size(F.filter(ns, lambda n: n.isNotNull())) == 0)
                own = F.coalesce(own, F.lit(False))
                return F.struct(best["family"].alias("family"), best["chance"].alias("chance"), F.when(own, F.lit(1.0)).otherwise(mine).alias("shared"), ((best["family"] != UNKNOWN) & (own | sentence)).alias("confirmed"))

            return let(names, lambda ns: let(shares, lambda ss: of_templates(ns, ss)))

        known = lambda x: F.filter(x, lambda i: F.get(_literal(m.known, "boolean"), i))
        return let(known(features(ws)), lambda x: let(of_features(x), lambda z: let(of_logits(z), of_best)))

    return let(tokens(paragraph), of_words)


def anchored(text: Column) -> Column:
    held = let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(a)) for a in ANCHORS]))
    return F.coalesce(held | F.rlike(text, F.lit(CAPITALS)), F.lit(False))


def paragraphs(text: Column) -> Column:
    """An array of arrays of (line, last, text): the lines of a paragraph that have an anchor, then, if it has more lines, all of it."""

    def of_lines(lines: Column) -> Column:
        blank = lambda i: F.coalesce(F.get(lines, i), F.lit("")) == ""

        def of_hits(hits: Column) -> Column:
            def apart(a: Column, b: Column) -> Column:
                between = reduce(or_, [(a + k < b) & blank(a + k) for k in range(1, GAP + 1)])
                return a.isNull() | b.isNull() | (b - a > GAP + 1) | between

            count = F.size(hits)
            at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
            firsts = F.filter(at, lambda i: apart(F.get(hits, i - 1), F.get(hits, i)))
            lasts = F.filter(at, lambda i: apart(F.get(hits, i), F.get(hits, i + 1)))

            def of_block(b: Column) -> Column:
                own = F.transform(F.slice(hits, b["f"] + 1, b["l"] - b["f"] + 1), lambda h: F.struct(h.alias("line"), h.alias("last"), F.get(lines, h).alias("text")))
                start, end = F.get(hits, b["f"]), F.get(hits, b["l"])
                start, end = F.when(blank(start - 1), start).otherwise(start - 1), F.when(blank(end + 1), end).otherwise(end + 1)
                whole = F.struct(start.alias("line"), end.alias("last"), F.array_join(F.slice(lines, start + 1, end - start + 1), " ").alias("text"))
                return F.when(start < end, F.concat(own, F.array(whole))).otherwise(own)

            return F.transform(F.arrays_zip(firsts.alias("f"), lasts.alias("l")), of_block)

        numbered = F.filter(F.transform(lines, lambda x, i: F.when(anchored(x), i)), lambda i: i.isNotNull())
        return let(numbered, of_hits)

    return let(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, MARKS, "")), of_lines)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, and notices: an array of (line, last, family, chance, shared, confirmed) of the lines with an anchor and of the
    paragraphs that are confirmed as a family that none of their lines is."""
    spark = docs.sparkSession
    none = F.array().cast("array<array<struct<line:int,last:int,text:string>>>")
    found = docs.select(F.col(id_column), F.when(anchored(F.col(text_column)), paragraphs(F.col(text_column))).otherwise(none).alias("lic__found"))

    def of_paragraph(units: Column) -> Column:
        judged = F.transform(units, lambda p: let(classify(spark, p["text"]), lambda c: F.struct(p["line"].alias("line"), p["last"].alias("last"), c["family"].alias("family"), c["chance"].alias("chance"), c["shared"].alias("shared"), c["confirmed"].alias("confirmed"))))
        single = lambda n: n["line"] == n["last"]
        return let(judged, lambda ns: F.filter(ns, lambda n: single(n) | (n["confirmed"] & ~F.exists(ns, lambda o: single(o) & o["confirmed"] & (o["family"] == n["family"])))))

    return found.select(id_column, F.flatten(F.transform("lic__found", of_paragraph)).alias("notices"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sure = F.filter("notices", lambda n: n["confirmed"])
    return out.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda n: n["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda n: F.concat_ws(":", n["line"], n["family"])), ",").alias("notices"),
    )
