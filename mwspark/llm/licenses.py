"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame functions only.

A passage is a paragraph of a text (between empty lines, with the marks of comments taken off), and each of its lines as well,
if it holds a cue word or a phrase that opens a known licence. So one-line notices, headers of several lines and the
paragraphs of whole licence files are all compared, each with whole templates: a licence has as templates its usual notice, its
identifier line, its title and the telling paragraphs of its text. Equal passages
are compared once. Words are weighted by tf * idf, idf over all passages of the corpus by the number of their
occurrences; a passage's licence is that of the template of highest cosine, if that is MIN_COSINE or more. A text's own
licence is that of its best passage. A text of which FILE_SHARE of the lines or more stand in licensed passages is a
licence file and speaks for its directory; texts without a licence of their own take that of the nearest ancestor
directory that has one, found by an equi-join over the directory's ancestors. That join is salted, so no directory's files meet in one task.

One row per input row. Null and empty texts hold nothing but may inherit; a null path has no directory. Ties go to the
higher name in order, for directories between files of equal cosine, too. Repeated rows give repeated results; an empty table gives no rows. Very long
texts and lines are ordinary. Only id, path and text are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.common import cut, table

# fixed values: notices, titles and telling paragraphs by which these licences are usually named
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted.",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0, the Creative Commons Attribution License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": [
        "Released under the MIT License.",
        "MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This source code is subject to the terms of the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
CUE = r"(?i)licen[cs]e|copyright|spdx|creative commons|public domain|permission|redistribut|warrant"
MARKS = r"(?m)^[ \t]*(?://+|#+|\*+/?|/\*+|--+|;+|%+|\"{3}|<!--)?[ \t]*"
BREAK = r"\r?\n(?:[ \t]*\r?\n)+"
WORD = "[a-z0-9]+"
MIN_COSINE = 0.75
FILE_SHARE = 0.5
SALTS = 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def best_templates(passages: DataFrame, templates: dict[str, list[str]], min_cosine: float) -> DataFrame:
    """(p, cosine, name) for passages (p, line, n) that are close enough to a template."""
    spark = passages.sparkSession
    named = [(name, x) for name, texts in sorted(templates.items()) for x in [*texts, f"SPDX-License-Identifier: {name}"]]
    known = spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "t int, name string, line string")
    total = passages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    terms = cut(passages.select("p", "n", F.explode(words(F.col("line"))).alias("term")).groupBy("p", "term").agg(F.first("n").alias("n"), F.count("*").alias("tf")))
    idf = F.log((1 + F.lit(float(total))) / (1 + F.coalesce(F.col("df"), F.lit(0)))) + 1
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    weighted = terms.join(df, "term").select("p", "term", (F.col("tf") * idf).alias("w"))
    own = known.select("t", "name", F.explode(words(F.col("line"))).alias("term")).groupBy("t", "name", "term").agg(F.count("*").alias("tf"))
    own = cut(own.join(df, "term", "left").select("t", "name", "term", (F.col("tf") * idf).alias("v")))
    length = own.groupBy("t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("lv"))
    size = weighted.groupBy("p").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("lw"))
    # the templates are a fixed list
    dots = weighted.join(F.broadcast(own), "term").groupBy("p", "t", "name").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("lv") / F.col("lw"), 9)
    scored = dots.join(F.broadcast(length), "t").join(size, "p").select("p", "name", cosine.alias("cosine")).where(F.col("cosine") >= min_cosine)
    return scored.groupBy("p").agg(F.max(F.struct("cosine", "name")).alias("b")).select("p", "b.cosine", "b.name")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """doc_id, path, own_license, cosine, n_passages (lines in licensed passages), license, inherited_from for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cued = lambda x: x.rlike(CUE)
    plain = F.regexp_replace(text, MARKS, "")
    count = lambda x: F.size(F.filter(F.split(x, "\n"), lambda y: F.length(F.trim(y)) > 0))
    # lines of a paragraph are passages too, unless it is one line: (the passage, how many lines, whether it is a part of another)
    parts = lambda x: F.concat(
        F.array(F.struct(F.regexp_replace(F.trim(x), "\n", " ").alias("line"), count(x).alias("k"))),
        F.transform(F.when(count(x) > 1, F.filter(F.split(x, "\n"), cued)).otherwise(F.array().cast("array<string>")), lambda y: F.struct(F.trim(y).alias("line"), F.lit(1).alias("k"))),
    )
    held = F.transform(F.filter(F.split(plain, BREAK), cued), parts)
    rows = files.select(
        F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.xxhash64(text, F.lit(21)).alias("text_key"),
        F.when(text.rlike(CUE), count(text)).alias("n_lines"),
        F.when(text.rlike(CUE), held).alias("parts"),
    )
    rows = cut(rows)
    # what a text holds follows from the text: equal texts are one
    texts = rows.where(F.size("parts") > 0).groupBy("text_key").agg(F.first("n_lines").alias("n_lines"), F.first("parts").alias("parts"), F.count("*").alias("copies"))
    held = cut(texts.select("text_key", "n_lines", "copies", F.posexplode("parts").alias("at", "part")).select("text_key", "n_lines", "copies", "at", F.explode("part").alias("x")))
    held = held.select("text_key", "n_lines", "copies", "at", F.col("x.line").alias("line"), F.col("x.k").alias("k"), F.xxhash64("x.line", F.lit(22)).alias("p"))
    passages = cut(held.groupBy("p").agg(F.first("line").alias("line"), F.sum("copies").alias("n")))
    best = cut(best_templates(passages, templates, min_cosine))
    lines = F.when(F.max("k") > 1, F.max("k")).otherwise(F.sum("k"))  # a licensed paragraph counts whole, else its licensed lines
    hits = held.join(best, "p").groupBy("text_key", "at").agg(F.max(F.struct("cosine", "name")).alias("b"), lines.alias("k"), F.first("n_lines").alias("n_lines"))
    own = hits.groupBy("text_key").agg(F.max("b").alias("b"), F.sum("k").alias("n_passages"), (F.sum("k") >= file_share * F.first("n_lines")).alias("is_file"))
    own = own.select("text_key", F.col("b.name").alias("own_license"), F.col("b.cosine").alias("cosine"), "n_passages", "is_file")
    found = cut(rows.select("doc_id", "path", "text_key", directory(F.col("path")).alias("dir")).join(own, "text_key", "left"))
    speaks = found.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.max(F.struct("cosine", "own_license", "path")).alias("b")).select(F.col("dir").alias("up"), F.col("b.own_license").alias("theirs"), F.col("b.path").alias("from_path"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = found.where("dir IS NOT NULL").groupBy("dir").agg(F.lit(1).alias("one")).select("dir", F.explode(F.array_distinct(ups)).alias("up"))
    nearest = dirs.join(speaks, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "theirs", "from_path")).alias("b"))
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int").alias("salt")
    nearest = nearest.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = found.select("*", salt).join(nearest, ["dir", "salt"], "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("own_license", "b.theirs").alias("license"), F.when(inherits, F.col("b.from_path")).alias("inherited_from"))


def op4_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id; licence lines that make up a tenth of a text let it speak for its folder."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", path.alias("path")), file_share=0.1)
