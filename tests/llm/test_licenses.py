import json

import pytest
from pyspark.sql import functions as F

from massloom.llm import licenses as lic


@pytest.fixture(scope="module")
def classified(spark):
    def run(texts):
        df = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(texts)), "array<string>")).alias("i", "t"))
        return [r.c for r in df.select("i", lic.classify(spark, F.col("t")).alias("c")).orderBy("i").collect()]

    return run


def test_held_out_accuracy(classified):
    held = [r for r in lic.training_rows() if r["held"]]
    got = classified([r["text"] for r in held])
    right = sum(c.family == r["family"] for c, r in zip(got, held))
    assert right >= 0.97 * len(held) and all(c.confirmed for c, r in zip(got, held) if c.family == r["family"] != lic.UNKNOWN)


def test_new_wordings(classified):
    got = classified(["This project is licensed under the terms of the MIT license.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Our driving licence office opens in spring near the old school.", "He renewed the fishing license for a year without permission of the teachers.", ""])
    assert [c.family for c in got[:3]] == ["mit", "cc-by-nc", "gpl-3.0"] and all(c.confirmed for c in got[:3])
    assert not any(c.confirmed for c in got[3:])


def test_scan_finds_lines_anywhere(spark):
    long = "plain words\n" * 5000 + "Released under the MIT License.\n" + "more\n" * 100
    df = spark.createDataFrame([(1, long), (2, None), (3, "The license plate."), (3, "The license plate.")], "doc_id long, text string")
    got = [(r.doc_id, [(n.line, n.family) for n in r.notices if n.confirmed]) for r in lic.scan(df).collect()]
    assert sorted(got) == [(1, [(5000, "mit")]), (2, []), (3, []), (3, [])]


def test_every_training_notice_is_scored(spark):
    from massloom.llm import licenses

    texts = [r["text"] for r in licenses.training_rows() if r["family"] != licenses.UNKNOWN]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.x for r in df.where(~licenses.anchored(licenses.F.col("x"))).collect()] == []
    named = ["Released under CC BY 4.0.", "Released under the Apache-2.0.", "Distributed under the terms of the MPL-2.0.", "You are free to share and adapt the material for any purpose, even commercially, provided that you give appropriate credit."]
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame(list(enumerate(named)), "doc_id long, text string")).collect()}
    assert [[n.family for n in got[k] if n.confirmed] for k in range(4)] == [["cc-by"], ["apache-2.0"], ["mpl-2.0"], ["cc-by"]]


def test_classify_matches_plain_scoring(spark):
    """Scores, chances, shares and verdicts in numpy, strings and sets, from the trained weights."""
    import re

    import numpy as np

    texts = [r["text"] for r in lic.training_rows()[::9]] + ["", "plain prose of no kind at all", "Licensed under something unheard of.", "MIT", "you may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 today"]
    ws = F.col("ws")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("ws", lic.tokens(F.col("t")))
    rows = df.select("i", "t", "ws", lic.features(ws).alias("x"), lic.grams(ws, 2).alias("g2"), lic.classify(spark, F.col("t")).alias("c")).collect()
    m = lic._trained(spark)
    w, known = np.array(m.weights), np.array(m.known)
    for r in rows:
        x = [k for k in r.x if known[k]]
        z = (w[:, x].sum(1) / max(1, len(x)) ** 0.5 + w[:, lic.BUCKETS]) / m.temperature
        e = np.exp(z - z.max())
        best, chance = int(z.argmax()), float(1 / e.sum() * e.max())
        family = m.classes[best] if chance >= lic.MIN_CHANCE else lic.UNKNOWN
        text = " " + " ".join(r.ws) + " "
        named = {f for f, ns in m.names.items() if any(f" {n} " in text if len(n) > 3 else re.search(lic.CAPITALS, r.t) for n in ns)}
        shares = {f: max(len(set(r.g2) & set(p)) / len(p) for p in ps) for f, ps in m.sentences.items()}
        mine = shares.get(family, 0.0)
        rest = max(v for f, v in shares.items() if f != family)
        assert r.c.family == family and r.c.chance == pytest.approx(chance, abs=1e-6)
        assert r.c.shared == pytest.approx(1.0 if family in named else mine)
        assert r.c.confirmed == (family != lic.UNKNOWN and (family in named or mine >= lic.MIN_SHARED and mine > rest and not named))
    assert {r.c.family for r in rows} == set(m.classes)


#: Headers as files have them, wrapped and marked as comments.
HEADERS = {
    "apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software',
    "gpl-2.0": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.",
    "gpl-3.0": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "mpl-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */",
}


def _families(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted({n.family for n in r.notices if n.confirmed}) for r in lic.scan(df).collect()}
    return [got[k] for k in range(len(texts))]


def test_wrapped_headers_give_one_family_each(spark):
    prose = "The boats left the harbour early.\nNobody saw them.\n\n"
    assert _families(spark, HEADERS.values()) == [[f] for f in HEADERS]
    assert _families(spark, [prose + h + "\n\nint main() {}" for h in HEADERS.values()]) == [[f] for f in HEADERS]
    assert _families(spark, [prose.strip() + "\n" + h + "\nThe end of it." for h in HEADERS.values()]) == [[f] for f in HEADERS]


def test_other_licences_and_mentions_give_none(spark):
    texts = [
        "it under the terms of the GNU General Public License as published by",
        "Eclipse Public License v2.0",
        "Licensed under the Eclipse Public License 2.0.",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
        "We reviewed the terms of the Apache License 2.0 in our law course",
        "Yesterday the class talked about the MIT License for an hour.",
        "DIE KINDER MIT DEM BOOT UND DER SCHULE",
    ]
    assert _families(spark, texts) == [[]] * len(texts)


def test_names_of_all_forms(spark):
    texts = {"Licensed under CC BY-NC-ND 4.0.": "cc-by-nc", "licensed under the AGPL version 3 or later": "agpl-3.0", "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "This project is licensed under the MIT License - see the LICENSE.md file for details": "mit"}
    assert _families(spark, texts) == [[f] for f in texts.values()]


def test_neighbouring_notices_count_apart_and_blank_lines_part(spark):
    texts = ["prose\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.\nmore prose", "Permission is hereby granted, free of charge, to any person\n\nobtaining a copy of this software"]
    assert _families(spark, texts) == [["gpl-3.0", "mit"], []]
    got = lic.scan(spark.createDataFrame([(1, HEADERS["gpl-2.0"])], "doc_id long, text string")).first().notices
    assert [(n.line, n.last) for n in got if n.confirmed] == [(0, 3)]


def test_time_is_linear_in_the_text(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "Released under the MIT License.\n" * n)], "doc_id long, text string")
        began = time.time()
        assert lic.scan(df).selectExpr("size(filter(notices, n -> n.confirmed))").first()[0] == n
        return time.time() - began

    seconds(100)
    short, long = seconds(500), seconds(2000)
    assert long < 8 * short
