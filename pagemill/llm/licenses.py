r"""License scans: TF-IDF cosine of lines and blocks to templates, then inheritance from the nearest ancestor directory.

A scan compares each line, each block of consecutive lines that hold words (a paragraph, or a comment's block, whatever
its marks), the header (the comment lines that a file begins with), and a license file as a whole, with sentences,
notices and whole license texts: notices are wrapped as they may be. Terms are lower-cased words; such a part and a template are sparse vectors of term counts times inverse document frequency,
which is counted over the lines of the whole table. Parts that hold none of the templates' rare terms are left out
before their terms are exploded: by Cauchy-Schwarz the others cannot reach the threshold, so nothing is lost. A file
has the license of its best part, but 'All rights reserved' only where nothing else matches, and of the BSD licenses the
one whose clauses it has. Files without one inherit from the nearest ancestor directory with a license file
that has one, found by joining directories on their path. DataFrame operations only.

Defined results: null and empty texts, and files at or under no licensed directory, have no license (null) and score
0. Ties go to the license that sorts first, and among license files of one directory to the higher score, then the
smaller path. Null paths are files of the root directory. Rows that
share a key share the best of their lines; rows without a key have none of their own and may inherit. Words outside the templates weigh as if seen in one line.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._common import hot_keys, join_by_key, kept

THRESHOLD = 0.6
WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
#: Wording of common license notices, several to a license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

#: Whole notices, as they stand in headers and license files; the name with a plus outdoes that of fewer clauses.
NOTICES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause+", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)
#: Whole license texts that are short enough to stand in a file's header.
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
LICENSE_FILE = r"^(licen[cs]e|copying|unlicense)([.-].*)?\z"
#: Between two blocks: lines without a letter or digit. Possessive, as Java would run the group by recursion.
BREAK = r"\n(?:[^A-Za-z0-9\n]*+\n)++"
#: A file's header: the lines it begins with that are marked as comments.
HEADER = r"\A((?:[ \t]*+(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*+\n?+)++)"


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({WORD})"), F.lit(1))


def _exploded(docs: DataFrame, key: str, parts: Column) -> DataFrame:
    """doc, line (a name for the part) and terms of each of the parts of a text; rows without a key have none.

    Terms are made before an outer explode, so that they are made once: filters cannot be pushed below it.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.posexplode_outer(F.transform(parts, terms)).alias("at", "terms"))
    # parts at one place of rows that share a key stay apart
    return rows.where("at is not null").select("doc", F.xxhash64("at", "terms").alias("line"), "terms")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _exploded(docs, key, F.split(F.col(text), "\n"))


def _parts(docs: DataFrame, key: str, text: str, whole: Column) -> DataFrame:
    """Lines, blocks of several lines, the header, and the whole text where ``whole`` holds."""
    t = F.col(text)
    several = F.filter(F.concat(F.split(t, BREAK), F.array(F.regexp_extract(t, HEADER, 1))), lambda b: F.contains(b, F.lit("\n")))
    return _exploded(docs, key, F.concat(F.split(t, "\n"), several, F.when(whole, F.array(t)).otherwise(F.array().cast("array<string>"))))


def _table(spark: SparkSession, rows: list[tuple], names: list[str], schema: str) -> DataFrame:
    """A small table from literals."""
    given = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(given), f"array<struct<{schema}>>")))


def own_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD, whole: Column | None = None) -> DataFrame:
    """doc, license and score of every row of ``docs`` that has a line like a template.

    With ``whole``, which says what rows are license files, blocks and whole files count too.
    """
    spark: SparkSession = docs.sparkSession
    vectors = [(name, Counter(re.findall(WORD, words.lower()))) for name, words in templates]
    vocabulary = sorted(set().union(*(v for _, v in vectors)))
    lines = _lines(docs, key, text)
    # one row per template term; the null row counts all lines
    known = F.array_distinct(F.filter("terms", lambda t: t.isin(*vocabulary)))
    seen = lines.select(F.explode_outer(F.concat(known, F.array(F.lit(None).cast("string")))).alias("term"))
    counts = {r.term: r.n for r in seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get(None, 0)
    idf = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log((1 + total) / 2) + 1
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in v.items())) for _, v in vectors]
    # common terms: even all of them together leave every template below the threshold
    common: set[str] = set()
    for t in sorted(vocabulary, key=lambda t: (idf[t], t)):
        trial = common | {t}
        if all(sum((n * idf[x]) ** 2 for x, n in v.items() if x in trial) < (0.999 * threshold * norm) ** 2 for (_, v), norm in zip(vectors, norms, strict=True)):
            common = trial
    rare = [t for t in vocabulary if t not in common]
    parts = lines if whole is None else _parts(docs, key, text, whole)
    near = parts.where(F.exists("terms", lambda t: t.isin(*rare))).select("doc", "line", F.explode_outer("terms").alias("term"))
    # written once: the norms and the products both read it
    tf = kept(near.groupBy("doc", "line", "term").agg(F.count(F.lit(1)).alias("tf")))
    weights = _table(spark, list(idf.items()), ["term", "idf"], "term string, idf double")
    entries = [(i, name, t, n * idf[t] / norm) for i, ((name, v), norm) in enumerate(zip(vectors, norms, strict=True)) for t, n in v.items()]
    entries = _table(spark, entries, ["template", "license", "term", "part"], "template int, license string, term string, part double")
    # both tables are bounded by the templates
    weighed = tf.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norm = weighed.groupBy("doc", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(entries), "term").groupBy("doc", "line", "template", "license").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    scored = dots.join(norm, ["doc", "line"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    if whole is None:
        best = scored.groupBy("doc").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    else:
        # no more entries than licenses
        each = scored.groupBy("doc", "license").agg(F.min(-F.col("score")).alias("s"))
        each = each.groupBy("doc").agg(F.collect_list(F.struct("s", "license")).alias("all"), F.collect_set("license").alias("names"))
        has = lambda n: F.array_contains("names", n)
        outdone = lambda n: (
            ((n == "Proprietary") & (F.size("names") > 1)) | ((n == "BSD-2-Clause") & has("BSD-3-Clause+")) | ((n == "BSD-3-Clause") & has("BSD-2-Clause") & ~has("BSD-3-Clause+"))
        )
        left = F.array_min(F.filter("all", lambda e: ~outdone(e["license"])))
        best = each.select("doc", F.struct(left["s"].alias("s"), F.rtrim(left["license"], F.lit("+")).alias("license")).alias("best"))
    return best.select("doc", "best.license", (-F.col("best.s")).alias("score"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def _name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)\z", 1))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, path, license, score, origin (own, inherited or none) and licensed_by (the path it comes from) of every row."""
    named = _name(F.coalesce(F.col(path), F.lit(""))).rlike(LICENSE_FILE)
    found = own_licenses(files, key, text, TEMPLATES + NOTICES + TEXTS, threshold, named).withColumnRenamed("license", "own").withColumnRenamed("score", "own_score")
    names = files.select(F.col(key), F.coalesce(path, F.lit("")).alias("path"))
    # rows without a key match nothing and stay where they are
    without = names.where(F.col(key).isNull()).select(key, "path", F.lit(None).cast("string").alias("own"), F.lit(None).cast("double").alias("own_score"))
    rows = names.where(F.col(key).isNotNull()).join(found, F.col(key) == F.col("doc"), "left").drop("doc").unionByName(without)
    rows = kept(rows.withColumn("dir", _parent(F.col("path"))))
    is_license = _name(F.col("path")).rlike(LICENSE_FILE)
    by_dir = rows.where(is_license & F.col("own").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own")).alias("b"))
    by_dir = by_dir.select(F.col("dir").alias("at"), F.col("b.path").alias("from_path"), F.col("b.own").alias("from_license"), (-F.col("b.s")).alias("from_score"))
    # each directory once, however many files it has: its prefixes are its ancestors
    parts = F.split("dir", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    sizes = kept(rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files")))
    ups = sizes.select("dir", F.posexplode(prefixes).alias("depth", "at"))
    nearest = ups.join(by_dir, "at").groupBy("dir").agg(F.max(F.struct("depth", "from_path", "from_license", "from_score")).alias("n"))
    total = sizes.agg(F.sum("n_files")).first()[0] or 0
    # one directory may hold most files
    out = join_by_key(rows, nearest, ["dir"], hot_keys(sizes, "n_files", total), "left")
    own, up = F.col("own").isNotNull(), F.col("n").isNotNull()
    return out.select(
        key,
        "path",
        F.coalesce("own", "n.from_license").alias("license"),
        F.when(own, F.col("own_score")).when(up, F.col("n.from_score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(own, "own").when(up, "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("path")).when(up, F.col("n.from_path")).alias("licensed_by"),
    )
