"""License scans: TF-IDF cosine to templates, then nearest-ancestor inheritance.

Units of a file with a trigger word are its windows of 1 to ``WINDOW`` lines
that hold a trigger (also one wrapped over two lines), its header blocks (runs
of consecutive lines that are not blank, runs of comment lines, delimited
comments) and the whole file.  Terms are the runs of ``[a-z]`` or ``[0-9]`` of
the lower-cased text.  Templates come in sets: one-line notices, multi-line
notices, SPDX tags and titles, full licence texts.  Only a set's own terms
count in its cosines; their idf is ln((1 + N) / (1 + df)) + 1 with df over all
files.  A unit's vector is tf * idf; its cosine to each template is a sparse
product (terms of the units joined to the templates' terms), and a unit at
``threshold`` or more names the best template's license.  Further, a unit that
is not a single line with a one-line notice holds at least ``threshold`` of
its words from the template, and one named by a tag or title holds all its terms.

A file's own license is that of its best unit: full texts first, titles that
leave the version open last, then by cosine.  A *licence file* is one whose
name says so, or whose license lines hold at least half of its words; it covers
its directory.  A file without a license of its own inherits from the licence
file in the nearest ancestor directory: directories (not files) are expanded
into their ancestors and joined by path.

The templates are a parameter of bounded size (``MAX_TEMPLATE_TERMS`` rows),
checked before they are broadcast.  Only DataFrame functions run.

Defined results: null or empty texts have no header; a null path has no
directory and inherits nothing; among equal cosines the first line, license id
and path win; repeated rows get the same answer; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.scratch import parked, word_array

#: In the terms of a line, or of two in turn, joined by one space; in a text any other signs may stand between them.
TRIGGER = "licen[cs]|spdx|released under|public domain|permission is hereby|permission to use|redistribut|provided as is"
IN_TEXT = "(?i)" + TRIGGER.replace(" ", "[^a-z0-9]+")
WINDOW = 6
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|\.\.|!|\"|(?i:rem|dnl)\b)"
OPENS, CLOSES = r"/\*|<!--", r"\*/|-->"
FILE_NAME = "(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"
MAX_TEMPLATE_TERMS = 20_000

#: Notices by license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms are permitted under the 2-clause BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the 3-clause BSD License"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution NonCommercial 4.0 License, CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
]


#: Notices that are usually wrapped over lines.
NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
                   "specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE "
                   "file distributed with this work for additional information regarding copyright ownership. The ASF licenses this "
                   'file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
            "the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
]
_MOVED = ("{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free "
          "Software Foundation; either version {2} of the License, or (at your option) any later version.")
_HOPE = (" {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
         "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of "
         "the GNU {1} along with {0}. If not, see https://www.gnu.org/licenses/.")
_GNU = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
        ("AGPL-3.0", "Affero General Public License", "3")]
NOTICES += [(lic, part.format("This program" if lic[0] in "GA" else "This library", name, v))
            for lic, name, v in _GNU for part in (_MOVED, _MOVED + _HOPE)]

#: SPDX tags: all terms must be there.
TAGS = [(lic, f"SPDX-License-Identifier: {tag}") for lic, tags in {
    "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "CC-BY-4.0": "CC-BY-4.0",
    "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC0-1.0": "CC0-1.0", "ISC": "ISC", "MIT": "MIT",
    "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "0BSD": "0BSD",
    **{g: f"{g} {g}-only {g}-or-later" for g in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
}.items() for tag in tags.split()]

#: Titles: all terms must be there, in a unit of at most twice as many words.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"), ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("CC0-1.0", "CC0 1.0 Universal public domain"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
]
#: What leaves the version or the clauses open: the license that holds in any case, if nothing else of the file names one.
OPEN = [("GPL-1.0", "GNU General Public License"), ("LGPL-2.0", "GNU Lesser General Public License"),
        ("AGPL-3.0", "GNU Affero General Public License"),
        ("GPL-1.0", "under the terms of the GNU General Public License as published by"),
        ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without")]

#: Full texts that differ from another one's by a few passages, which are replaced here.
VARIANTS = {
    "AGPL-3.0": ("GPL-3.0", [(r"(?i)GNU General Public License", "GNU Affero General Public License"),
                             (r"Use with the GNU Affero", "Remote Network Interaction; Use with the GNU")]),
    "CC-BY-4.0": ("CC-BY-SA-4.0", [(r"(?s)\n  b\. ShareAlike\..*?\n\n\nSection 4", "\n\n\nSection 4"), (r"-ShareAlike| and ShareAlike", "")]),
    "CC-BY-NC-4.0": ("CC-BY-SA-4.0", [
        (r"(?s)\n  b\. ShareAlike\..*?\n\n\nSection 4", "\n\n\nSection 4"), (r"-ShareAlike| and ShareAlike", "-NonCommercial"),
        (r"in whole or in part", "in whole or in part, for NonCommercial purposes only"),
        (r"\n\n\nSection 2", "\nNonCommercial means not primarily intended for or directed towards commercial advantage or monetary "
                             "compensation.\n\n\nSection 2")]),
}


@lru_cache(maxsize=1)
def full_texts() -> tuple:
    """(license, text) of the full licence texts beside this file and their variants."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    texts = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            texts[name.removesuffix(".txt")] = f.read()
    for name, (base, passages) in VARIANTS.items():
        text = texts[base]
        for old, new in passages:
            text = re.sub(old, new, text)
        texts[name] = text
    return tuple(texts.items())


def standard_templates() -> dict:
    return {"line": TEMPLATES, "notice": NOTICES, "tag": TAGS, "title": TITLES, "open": OPEN, "text": full_texts()}


def terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+|[0-9]+)"), F.lit(1))


def template_vectors(files: DataFrame, templates: dict) -> DataFrame:
    """(set, template, license, term, idf, weight, norm, n, size): one row per template and term;
    n and size are the template's different and all terms."""
    spark = files.sparkSession
    rows = [(kind, i, lic, text) for kind, some in templates.items() for i, (lic, text) in enumerate(some)]
    table = spark.createDataFrame(rows, "set string, template int, license string, text string")
    tf = table.select("set", "template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "set", "template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = sorted({r["term"] for r in tf.select("term").distinct().collect()})
    if tf.count() > MAX_TEMPLATE_TERMS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_TERMS} terms")
    words = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "term string"))
    df = parked(files.select(F.explode(F.array_distinct(terms(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
                .join(words, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    n = files.count()
    weighed = tf.join(F.broadcast(df), "term", "left").withColumn(
        "idf", F.log(F.lit(1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    own = Window.partitionBy("set", "template")
    norm = F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2))).over(own))
    return weighed.select("set", "template", "license", "term", "idf", (F.col("tf") * F.col("idf")).alias("weight"), norm.alias("norm"),
                          F.count(F.lit(1)).over(own).alias("n"), F.sum("tf").over(own).alias("size"))


def runs(marked):
    """(first, k) of the runs of consecutive lines; ``marked`` has each line's number and a colon, or nothing at a gap."""
    pieces = F.split(F.array_join(marked, "\n"), "\n\n+")
    lines = F.transform(pieces, lambda x: F.split(F.btrim(x, F.lit("\n")), "\n"))
    number = lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("int")
    return F.transform(F.filter(lines, lambda x: x[0] != ""), lambda x: F.struct(
        number(x[0]).alias("first"), (number(F.element_at(x, -1)) - number(x[0]) + 1).alias("k")))


def units(files: DataFrame) -> DataFrame:
    """(path, h, first, k, n_terms, t) of the units of files (path, h, text); t holds the terms."""
    some = files.where(F.regexp_like("text", F.lit(IN_TEXT))).dropDuplicates(["path", "h"])
    some = some.select("path", "h", F.split("text", "\n").alias("line")).withColumn("t", F.transform("line", terms))
    some = some.withColumn("said", F.transform("t", lambda x: F.array_join(x, " ")))
    some = some.withColumn("own", F.transform("said", lambda x: F.regexp_like(x, F.lit(TRIGGER)))).withColumn(
        "pair", F.zip_with("said", F.slice("said", 2, F.size("said")), lambda x, y: F.regexp_like(
            F.concat_ws(" ", x, y), F.lit(TRIGGER))))
    number = lambda i: F.concat(i.cast("string"), F.lit(":"))
    at = F.sequence(F.lit(0), F.size("line") - 1)
    text = F.zip_with("line", F.transform("said", lambda x, i: F.when(x != "", number(i)).otherwise("")), lambda x, m: F.concat(
        F.when(x.rlike(OPENS), "\n").otherwise(""), m, F.when(x.rlike(CLOSES), "\n").otherwise("")))
    comment = F.transform("line", lambda x, i: F.when(x.rlike(COMMENT), number(i)).otherwise(""))
    marks = F.transform("line", lambda x, i: F.concat(
        F.when(x.rlike(OPENS), F.concat(F.lit("{"), number(i))).otherwise(""), F.when(x.rlike(CLOSES), F.concat(number(i), F.lit("}"))).otherwise("")))
    enclosed = F.transform(F.regexp_extract_all(F.array_join(marks, ""), F.lit(r"\{([0-9]+:[0-9]+):\}"), F.lit(1)), lambda x: F.struct(
        F.split_part(x, F.lit(":"), F.lit(1)).cast("int").alias("first"),
        (F.split_part(x, F.lit(":"), F.lit(2)).cast("int") - F.split_part(x, F.lit(":"), F.lit(1)).cast("int") + 1).alias("k")))
    near = F.filter(at, lambda i: F.exists(F.slice("pair", i + 1, WINDOW - 1), lambda x: x) | F.get("own", i))
    windows = F.flatten(F.transform(near, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size("line") - i)),
                                                                lambda k: F.struct(i.alias("first"), k.alias("k")))))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.size("line").alias("k")))
    hit = lambda x: F.when(x.k == 1, F.get("own", x.first)).otherwise(F.exists(F.slice("pair", x.first + 1, x.k - 1), lambda y: y))
    ranges = F.filter(F.array_distinct(F.concat(windows, runs(text), runs(comment), enclosed, whole)), hit)
    found = some.select("path", "h", F.explode(F.transform(ranges, lambda x: F.struct(
        x["first"].alias("first"), x.k.alias("k"), F.flatten(F.slice("t", x["first"] + 1, x.k)).alias("t")))).alias("u"))
    return found.select("path", "h", "u.first", "u.k", F.size("u.t").alias("n_terms"), "u.t")


def header_licenses(files: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(path, h, first, k, rank, license, cosine) of the units of files (path, h, text) that name a license."""
    key = ["path", "h", "first", "k", "n_terms"]
    idf = vectors.select("set", "term", "idf").distinct()
    tf = units(files).select(*key, F.explode("t").alias("term")).join(F.broadcast(vectors.select("term").distinct()), "term").groupBy(
        *key, "term").agg(F.count(F.lit(1)).alias("tf"))
    known = parked(tf, "unit_terms").join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = known.groupBy(*key, "set").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own"))
    dot = known.drop("idf").join(F.broadcast(vectors), ["set", "term"]).groupBy(
        *key, "set", "template", "license", "norm", "n", "size").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("same"), F.sum("tf").alias("covered"))
    a, b = dot.alias("a"), norm.alias("b")
    met = F.col("a.path").eqNullSafe(F.col("b.path"))
    for c in (*key[1:], "set"):
        met = met & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    scored = a.join(b, met).select("a.*", F.round(F.col("dot") / (F.col("own") * F.col("norm")), 9).alias("cosine"))
    named = F.col("set").isin("tag", "title", "open")
    return scored.where((F.col("cosine") >= threshold) & ((F.col("set") == "line") & (F.col("k") == 1)
                                                          | (F.col("covered") >= threshold * F.col("n_terms")) | (F.col("set") == "tag"))
                        & (~named | (F.col("same") == F.col("n")))
                        & (~F.col("set").isin("title", "open") | (F.col("n_terms") <= 2 * F.col("size")))).select(
        "path", "h", "first", "k", F.when(F.col("set") == "text", 0).when(F.col("set") == "open", 2).otherwise(1).alias("rank"),
        "license", "cosine")


def scan(files: DataFrame, templates=None, threshold: float = 0.8) -> DataFrame:
    """(path, license, cosine, origin, licence_path) of every row of ``files`` (path, text);
    origin is ``header``, ``file``, ``inherited`` or null.  ``templates`` are sets of (license, text)
    by kind, or one-line notices (license, text); by default all of this module."""
    templates = standard_templates() if templates is None else templates if isinstance(templates, dict) else {"line": templates}
    files = files.select(F.col("path").cast("string").alias("path"), "text", F.xxhash64("text").alias("h"))
    vectors = parked(template_vectors(files, templates), "templates")
    named = parked(header_licenses(files, vectors, threshold), "headers")
    best = F.min(F.struct("rank", -F.col("cosine"), "first", "license", "k")).alias("best")
    own = named.groupBy("path", "h").agg(best, F.collect_set(F.struct("first", "k")).alias("ranges")).select(
        F.col("path").alias("own_path"), F.col("h").alias("own_h"), F.col("best.license").alias("license"), (-F.col("best.col2")).alias("cosine"),
        F.array_distinct(F.flatten(F.transform("ranges", lambda x: F.sequence(x["first"], x["first"] + x.k - 1)))).alias("lines"))
    counts = lambda text: F.transform(F.split(text, "\n"), lambda x: F.size(word_array(x)))
    slim = files.select("path", "h", F.size(word_array(F.col("text"))).alias("n_words"),
                        F.when(F.regexp_like("text", F.lit(IN_TEXT)), counts(F.col("text"))).alias("line_words"))
    words = F.aggregate("lines", F.lit(0), lambda x, i: x + F.get("line_words", i))
    found = parked(slim.join(own, slim["path"].eqNullSafe(own["own_path"]) & (slim["h"] == own["own_h"]), "left").select(
        "path", "license", "cosine", F.coalesce(F.regexp_like("path", F.lit(FILE_NAME)) & F.col("license").isNotNull()
                                                | (2 * words >= F.col("n_words")), F.lit(False)).alias("is_file"))
        .withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "found")
    pick = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("cosine"), "license", "path"))
    covering = found.where("is_file and path is not null").distinct().withColumn("r", pick).where("r = 1").select(
        F.col("folder").alias("ancestor"), F.col("license").alias("their_license"), F.col("cosine").alias("their_cosine"),
        F.col("path").alias("their_path"))
    folders = found.where("path is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn(
        "ancestor", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("depth")))
    inherited = ancestors.join(covering, "ancestor").withColumn("r", nearest).where("r = 1").select(
        F.col("folder").alias("their_folder"), "their_license", "their_cosine", "their_path")
    joined = found.join(inherited, found["folder"] == inherited["their_folder"], "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "path", F.coalesce("license", "their_license").alias("license"),
        F.when(has, F.col("cosine")).otherwise(F.col("their_cosine")).alias("cosine"),
        F.when(has & F.col("is_file"), F.lit("file")).when(has, F.lit("header"))
        .when(F.col("their_license").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~has, F.col("their_path")).alias("licence_path"))
