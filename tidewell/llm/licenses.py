"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame functions only.

A file is cut into segments at line ends and sentence ends. Segments that mostly consist of words of the templates (a
share of SHARE and more) stand in runs, parted by other segments; lines without words, as between comment signs, part
nothing. A file's passages are the windows of 1, 2, 4, 8 and 16 segments of its runs, the runs, and (if at least half of
its segments are such, or its name is that of a licence file) its whole text. Every distinct passage's cosine to every
template (notices, SPDX lines, full licence texts) comes from one join on terms with the few thousand weights of the
templates, and counts for all files that hold the passage. A file whose name is that of a licence file, or whose whole
text is a licence, speaks for its directory; a file without a licence of its own inherits from the nearest directory
above it that has such a file.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

THRESHOLD = 0.6
#: A file that isn't named so is a licence file only if its whole text is hardly more than a licence.
FILE_THRESHOLD = 0.95
#: Licence identifiers and notices as their owners recommend them for file headers and licence files.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."),
)
#: SPDX identifiers; those of the GNU licences also come with a suffix.
SPDX = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-1.1", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense", "Artistic-1.0-Perl")
GNU = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")
#: Notices, SPDX lines, and the full texts in license_texts, each file named by its licence and version.
TEMPLATES: tuple[tuple[str, str], ...] = (
    *NOTICES,
    *((i, f"SPDX-License-Identifier: {i}") for i in (*SPDX, *GNU)),
    *((i, f"SPDX-License-Identifier: {i}-{suffix}") for i in GNU for suffix in ("only", "or-later")),
    *((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
)
#: Fixed value: names of licence files.
FILE_NAME = r"(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"
#: Share of template words from which a segment can be part of a licence, and how many segments a window has.
SHARE = 0.6
WINDOWS = (1, 2, 4, 8, 16)
#: Rows of a side that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and numbers with points; other characters part them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+)"), F.lit(1))


def template_weights(spark, templates: Sequence[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, float]:
    """Unit TF-IDF weights (template, license, term, idf, weight), and the idf of terms in no template."""
    rows = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(templates)], "template int, license string, body string")
    terms = rows.select("template", "license", F.explode(words(F.col("body"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = len(templates)
    idf = terms.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weighted = terms.join(idf, "term").withColumn("raw", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("template")))
    return weighted.select("template", "license", "term", "idf", (F.col("raw") / norm).alias("weight")), math.log(1.0 + n) + 1


def passages(files: DataFrame, known: Sequence[str]) -> DataFrame:
    """(file, kind, passage) of files(file, name, text); known: the templates' words."""
    # U+0001 parts runs and U+0002 the segments of a run, so neither may come from the text
    plain = F.regexp_replace(F.translate("text", "\x01\x02", "  "), r"([.!?])[ \t]+", "$1\n")
    cut = F.filter(F.transform(F.split(plain, "[\r\n]+"), lambda x: F.struct(x.alias("text"), words(x).alias("words"))), lambda x: F.size(x["words"]) > 0)
    inside = ", ".join(f"'{w}'" for w in known if w.isalnum() or re.fullmatch(r"[0-9.]+", w))
    cut = files.where(F.length("text") > 0).select("file", "name", "text", cut.alias("cut"))
    like = F.expr(f"transform(cut, x -> if(size(filter(x.words, w -> w in ({inside}))) >= {SHARE} * size(x.words), trim(x.text), cast(null as string)))")
    marked = cut.select("file", "name", "text", like.alias("like"))
    runs = F.split(F.array_join("like", "\x02", "\x01"), "\x02?\x01\x02?")
    count = F.size(F.filter("like", lambda x: x.isNotNull()))
    whole = F.when((count > 0) & (2 * count >= F.size("like")) | F.col("name").rlike(FILE_NAME), F.col("text"))
    marked = marked.where((count > 0) | F.col("name").rlike(FILE_NAME)).select("file", whole.alias("whole"), F.filter(runs, lambda x: x != "").alias("runs"))
    each = marked.select("file", F.explode("runs").alias("run")).select("file", F.split("run", "\x02").alias("run"))

    def windows(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.size("run") - n + 1), lambda i: F.array_join(F.slice("run", i, n), " "))
        return F.when(F.size("run") >= n, at).otherwise(F.array().cast("array<string>"))

    parts = each.select("file", F.lit("part").alias("kind"), F.explode(F.array_distinct(F.concat(*map(windows, WINDOWS), F.array(F.array_join("run", " "))))).alias("passage"))
    return parts.union(marked.where(F.col("whole").isNotNull()).select("file", F.lit("whole"), "whole")).distinct()


def best_license(found: DataFrame, weights: DataFrame, rare_idf: float, threshold: float = THRESHOLD) -> DataFrame:
    """(passage_id, license, score) of found(passage_id, passage): the largest cosine to a template, ties to the first one, from `threshold` on.

    Terms are counted once. What follows keeps to a passage, so it needs no other exchange.
    """
    known = weights.select("term", "idf").distinct()
    terms = found.select("passage_id", F.explode(words(F.col("passage"))).alias("term")).groupBy("passage_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    # the templates' weights are a fixed few thousand rows
    raw = (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(rare_idf))
    vectors = terms.join(F.broadcast(known), "term", "left").withColumn("raw", raw)
    shared = F.filter(F.collect_list(F.struct("term", "raw", F.col("idf").isNotNull().alias("known"))), lambda x: x["known"])
    vectors = vectors.groupBy("passage_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), shared.alias("shared"))
    each = vectors.select("passage_id", "norm", F.inline("shared")).drop("known")
    dots = each.join(F.broadcast(weights.select("term", "template", "license", "weight")), "term").groupBy("passage_id", "template", "license").agg((F.sum(F.col("raw") * F.col("weight")) / F.first("norm")).alias("dot"))
    score = F.round("dot", 9)
    return dots.groupBy("passage_id").agg(F.max_by("license", F.struct(score, -F.col("template"))).alias("license"), F.max(score).alias("score"), F.max_by(-F.col("template"), F.struct(score, -F.col("template"))).alias("first")).where(F.col("score") >= threshold)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates: Sequence[tuple[str, str]] = TEMPLATES, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """path, license, score, origin, licensed_by of every file row.

    origin: 'own' (a passage of the file itself), 'inherited' (licensed_by names the nearest directory at or above the file's
    own that has a licence file; of several there, the best match speaks, ties to the smaller path) or 'none'. Null and
    empty texts have no passages; a file with a null path has no directory and inherits nothing; repeated rows each get
    their row; a file equal in path and text to another shares its result. Other columns play no part; an empty table
    gives an empty result. '' is the root directory. Files, and passages, are told apart by 64-bit hashes.
    """
    spark = files.sparkSession
    small = lambda df: F.broadcast(df) if df.count() <= max_broadcast_rows else df
    path, text = F.col(path_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    rows = files.select(path.alias("path"), F.xxhash64(F.coalesce(path, F.lit("\x00")), text).alias("file"), text.alias("text"))
    weights, rare = template_weights(spark, templates)
    weights = materialize(weights, "license-templates")
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1)
    vocabulary = sorted(r[0] for r in weights.select("term").distinct().collect())  # the templates' words, a fixed few thousand
    found = materialize(passages(rows.select("file", name.alias("name"), "text"), vocabulary).withColumn("passage_id", F.xxhash64("passage")), "license-passages")
    texts = found.groupBy("passage_id").agg(F.first("passage").alias("passage"))
    scored = materialize(best_license(texts, weights, rare, threshold), "license-scores")
    held = found.select("file", "kind", "passage_id").join(small(scored), "passage_id")
    best = F.struct("score", "first", F.col("kind") == "part", "license")
    whole = F.when(F.col("kind") == "whole", best)
    own = held.groupBy("file").agg(F.max(best).alias("best"), F.max(whole).alias("whole")).select("file", F.col("best.license").alias("own"), F.col("best.score").alias("own_score"), F.col("whole.license").alias("whole"), F.col("whole.score").alias("whole_score"))
    own = materialize(own, "license-own")
    slim = materialize(rows.select("path", "file"), "license-files")
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    slim = slim.withColumn("dir", parent)
    speaks = slim.join(own, "file").where(F.col("dir").isNotNull() & ((F.col("whole_score") >= FILE_THRESHOLD) | F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME)))
    rank = F.struct(F.coalesce("whole_score", "own_score"), F.col("own"))
    declared = materialize(speaks.groupBy("dir").agg(F.max_by(F.coalesce("whole", "own"), rank).alias("dir_license"), F.max(F.coalesce("whole_score", "own_score")).alias("dir_score")).withColumnRenamed("dir", "above"), "license-directories")
    # the directories above each directory: itself, then one step shorter at a time, and the root
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("above")))
    tree = slim.where(F.col("dir").isNotNull()).select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    nearest = tree.join(small(declared), "above").groupBy("dir").agg(F.max_by(F.struct("dir_license", "dir_score", "above"), "depth").alias("up")).withColumnRenamed("dir", "_dir_")
    out = slim.join(own.select(F.col("file").alias("_file_"), "own", "own_score"), F.col("file") == F.col("_file_"), "left").join(nearest, F.col("dir") == F.col("_dir_"), "left")
    has_own, has_up = F.col("own").isNotNull(), F.col("up").isNotNull()
    return out.select(
        "path", F.coalesce("own", "up.dir_license").alias("license"), F.coalesce("own_score", "up.dir_score").alias("score"),
        F.when(has_own, "own").when(has_up, "inherited").otherwise("none").alias("origin"), F.when(~has_own, F.col("up.above")).alias("licensed_by"),
    )
