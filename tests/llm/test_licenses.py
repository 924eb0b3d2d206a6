"""Licence scans against a plain computation, with inheritance and odd rows."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from mwspark.llm import licenses

SCHEMA = "doc_id long, path string, text string, p int, dir int"
MIT, GPL = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
ROWS = [
    (0, "a/LICENSE", MIT), (1, "a/x.py", "code\n# " + GPL + "\nmore"), (2, "a/y.py", "code"), (3, "a/b/c/z.py", None), (4, "a/b/COPYING", GPL + "\n" + GPL),
    (5, "d/q.py", ""), (6, "top.py", "some licence of ours\n" * 3), (7, None, "released under the mit license"), (8, "a/b/c/w.py", "x" * 50_000), (2, "a/y.py", "code"), (9, "e/LICENSE", MIT),
]


def frame(spark):
    return spark.createDataFrame([(*r, 1, 1) for r in ROWS], SCHEMA)


def test_scan(spark):
    got = sorted(licenses.scan(frame(spark)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    by = {r.doc_id: r for r in got}
    assert by[0].own_license == "MIT" and by[1].own_license == "GPL-3.0" and by[4].n_passages == 2 and by[7].own_license == "MIT"
    assert (by[2].license, by[2].inherited_from) == ("MIT", "a/LICENSE")
    assert (by[3].license, by[3].inherited_from) == ("GPL-3.0", "a/b/COPYING") == (by[8].license, by[8].inherited_from)
    assert by[5].license is None and by[6].license is None
    assert licenses.scan(frame(spark).where("false")).count() == 0


def test_cosines_match_a_plain_computation(spark):
    lines = [x for _, _, t in ROWS for x in (t or "").split("\n") if re.search(licenses.CUE, x)]
    bag = lambda x: Counter(re.findall("[a-z0-9]+", x.lower()))
    df = Counter(w for x in lines for w in bag(x))
    weight = lambda x: {w: n * (math.log((1 + len(lines)) / (1 + df[w])) + 1) for w, n in bag(x).items()}
    cos = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    passages = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(Counter(lines).items())], "p long, line string, n long")
    got = {r.p: (r.name, r.cosine) for r in licenses.best_templates(passages, licenses.TEMPLATES, 0.2).collect()}
    for i, x in enumerate(Counter(lines)):
        best = max((round(cos(weight(x), weight(t)), 9), name) for name, ts in licenses.TEMPLATES.items() for t in [*ts, f"SPDX-License-Identifier: {name}"])
        if best[0] >= 0.2:
            assert got[i][0] == best[1] and abs(got[i][1] - best[0]) < 1e-6


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
APACHE_HEADER = """#!/bin/sh
# Copyright 2020 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
echo done
"""


def test_whole_files_and_headers(spark):
    texts = {
        "mit/LICENSE": "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + MIT_BODY, "mit/a/b.py": "x = 1", "body/COPYING": MIT_BODY, "body/x.c": "int x;", "s/one.py": "# SPDX-License-Identifier: MIT\ncode\n" * 1 + "more\n" * 9,
        "s/two.py": "// SPDX-License-Identifier: Apache-2.0\ncode", "h/run.sh": APACHE_HEADER + "echo more\n" * 30, "h/other.sh": "echo", "n/none.py": "we talk about a license and permission here, at some length, without naming any",
    }
    rows = [(i, p, t, 1, 1) for i, (p, t) in enumerate(texts.items())]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    own = {p: r.own_license for p, r in got.items()}
    assert own == {"mit/LICENSE": "MIT", "mit/a/b.py": None, "body/COPYING": "MIT", "body/x.c": None, "s/one.py": "MIT", "s/two.py": "Apache-2.0", "h/run.sh": "Apache-2.0", "h/other.sh": None, "n/none.py": None}
    assert got["mit/a/b.py"].inherited_from == "mit/LICENSE" and got["body/x.c"].license == "MIT" and got["h/other.sh"].license is None


def test_query_shape(spark):
    out = licenses.op4_license_inheritance(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.count() == docs.count()
    named = docs.where(F.col("text").contains("MIT License")).select("doc_id")
    assert out.join(named, "doc_id").where("own_license IS NULL").isEmpty()
