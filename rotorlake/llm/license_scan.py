"""License scan in DataFrame operations: TF-IDF cosine to templates, then directory inheritance.

Segments of a file are its lines, its paragraphs of several lines (cut at lines without a-z or
0-9, so that comment marks don't matter) and, as a licence file, its whole text. Words are
runs of a-z and 0-9 after A-Z become a-z. Weights are term count times
``ln((1 + T) / (1 + df)) + 1`` over the T wordings of all templates (df is 0 for words that none
has). A segment matches a template if its cosine to one of the template's wordings reaches
``least``; the best match of a file is the one with the highest cosine, then the
alphabetically first template, then the earliest segment. Lines count from 0, the whole text
is segment -1, paragraphs count down from -2.

A segment must also have one of the words ``KEYS``. So texts without any are left out before
anything is exploded, and no cosine of words like "the" alone counts.

A file whose whole text, first line or first paragraph matches is a licence file of its
directory. A file without a match of its own inherits from the nearest directory above that
has a licence file; the best match wins there, too. Null and empty texts match nothing but
inherit; a null path has no directory. Rows with equal paths are one file, with the best match of
their texts, and keep their rows. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAST = 0.75
#: Wordings that licences are declared with, and paragraphs of their notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "This file is released under the Apache License 2.0, see LICENSE for details.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, all copyright and related rights are waived under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "ISC": ("ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": (
        "Released under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License", "The MIT License (MIT)", "This file is released under the MIT License, see LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.", "Copyright (c) 2020. All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    "Unlicense": ("SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."),
}
#: Words of which a segment must have one to match: each wording has some, other prose seldom.
KEYS = (
    "apache bsd cc cc0 copyright gnu isc license licensed licenses mit mozilla mpl permission proprietary redistribute redistribution redistributions reserved spdx sublicense unauthorized unencumbered unlicense waived warranties"
).split()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def weights(templates: dict[str, tuple[str, ...]]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """idf by word, idf of other words, and for each wording its template and unit vector."""
    counts = [(name, Counter(words(t))) for name in sorted(templates) for t in templates[name]]
    df = Counter(w for _, c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = []
    for name, c in counts:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        vectors.append((name, {w: n * idf[w] / norm for w, n in c.items()}))
    return idf, math.log(1 + len(counts)) + 1, vectors


def any_of(found: list[str]) -> str:
    """A pattern of these words that branches letter by letter."""
    heads: dict[str, list[str]] = {}
    for w in found:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    branches = [re.escape(head) + (any_of(rest) if rest != [""] else "") for head, rest in sorted(heads.items()) if head]
    return "(?:" + "|".join(branches) + ")" + "?" * ends if branches else ""


def directory(path: Column) -> Column:
    """What stands before the last '/'; null without one."""
    return F.nullif(F.regexp_extract(path, "^(.*)/", 1), F.lit(""))


#: What lies between paragraphs: a line break, and lines without words.
_GAP = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def matches(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST, path: str = "path", text: str = "text") -> DataFrame:
    """``path, license, score, segment, directory_wide`` of each file that matches a template."""
    spark = files.sparkSession
    idf, other, vectors = weights(templates)
    keyed = "(?i)(?<![a-z0-9])" + any_of(KEYS) + "(?![a-z0-9])"
    full = files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text")).where(F.col("path").isNotNull() & F.col("text").rlike(keyed))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("segment"), x.alias("text")))
    paragraphs = F.transform(F.split("text", _GAP), lambda x, i: F.struct((-2 - i).alias("segment"), x.alias("text")))
    several = F.filter(paragraphs, lambda p: F.contains(p["text"], F.lit("\n")))
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("segment"), F.col("text").alias("text"))), lines, several)
    segments = full.select("path", F.explode(parts).alias("s")).select("path", "s.segment", "s.text").where(F.col("text").rlike(keyed))
    # Only words of templates leave their row. Of the others a segment keeps the sum of squared
    # counts; the empty word counts equal rows, which scale dots and norms alike.
    found = F.filter(F.split(F.translate("text", _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")
    run = lambda w, n, s: F.named_struct(F.lit("w"), w, F.lit("n"), n.cast("long"), F.lit("s"), s.cast("long"))
    step = lambda a, w: F.when(a["w"] == w, run(w, a["n"] + 1, a["s"])).otherwise(run(w, F.lit(1), a["s"] + a["n"] * a["n"]))
    squares = F.aggregate(F.sort_array("words"), run(F.lit(""), F.lit(0), F.lit(0)), step, lambda a: a["s"] + a["n"] * a["n"])
    kept = F.concat(F.array(F.lit("")), F.filter(F.col("words"), lambda w: w.isin(sorted(idf))))
    terms = segments.select("path", "segment", F.xxhash64("text").alias("h"), found.alias("words")).select("path", "segment", "h", squares.alias("squares"), kept.alias("kept"))
    terms = terms.select("path", "segment", "h", "squares", F.explode("kept").alias("word"))
    counted = terms.groupBy("path", "segment", "h", "word").agg(F.count("*").alias("n"), F.max("squares").alias("squares"))
    known = spark.createDataFrame([(w, v, [x.get(w, 0.0) for _, x in vectors]) for w, v in sorted(idf.items())], "word string, idf double, unit array<double>")
    weighted = counted.join(F.broadcast(known), "word", "left").withColumn("w", F.col("n") * F.col("idf"))
    dots = [F.sum(F.col("w") * F.col("unit")[i]).alias(f"d{i}") for i in range(len(vectors))]
    rows = F.max(F.when(F.col("word") == "", F.col("n")))
    norm = F.sqrt(other * other * F.max("squares") * rows * rows + F.coalesce(F.sum(F.col("w") * F.col("w") - F.when(F.col("word") != "", other * other * F.col("n") * F.col("n"))), F.lit(0.0)))
    summed = weighted.groupBy("path", "segment", "h").agg(norm.alias("norm"), *dots)
    scores = F.array(*[F.struct(F.lit(name).alias("license"), F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.col("norm"), 6).alias("score")) for i, (name, _) in enumerate(vectors)])
    hits = summed.select("path", "segment", F.explode(F.filter(scores, lambda m: m["score"] >= least)).alias("m")).select("path", "segment", "m.license", "m.score")
    best = F.min(F.struct((-F.col("score")).alias("s"), "license", "segment")).alias("b")
    wide = F.bool_or(F.col("segment").isin(0, -1, -2)).alias("directory_wide")
    return hits.groupBy("path").agg(best, wide).select("path", "b.license", (-F.col("b.s")).alias("score"), "b.segment", "directory_wide")


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST, path: str = "path", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, path, own_license, score, segment, license, inherited_from`` of each row of ``files``."""
    own = stored(matches(files, templates, least, path, text), "licenses")  # it is used twice
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), directory(F.col(path)).alias("dir"))
    best = F.min_by("license", F.struct((-F.col("score")).alias("s"), "license"))
    declared = own.where("directory_wide").withColumn("at", directory(F.col("path"))).where("at is not null").groupBy("at").agg(best.alias("found"))
    parts = F.split("dir", "/")
    above = rows.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    above = above.select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("at"))
    nearest = above.join(declared, "at").groupBy("dir").agg(F.max_by(F.struct("found", "at"), "depth").alias("near"))
    out = rows.join(own.select("path", F.col("license").alias("own_license"), "score", "segment"), "path", "left").join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select(F.col("key").alias(key), "path", "own_license", "score", "segment", F.coalesce("own_license", "near.found").alias("license"), F.when(inherits, F.col("near.at")).alias("inherited_from"))


def sql(files: str, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> str:
    """The same in DuckDB's SQL; ``files`` is a query with doc_id, path and text."""
    idf, other, vectors = weights(templates)
    known = ", ".join(f"('{w}', {v!r}::double)" for w, v in sorted(idf.items()))
    unit = ", ".join(f"('{name}', {i}, '{w}', {v!r}::double)" for i, (name, vector) in enumerate(vectors) for w, v in sorted(vector.items()))
    return f"""
with files as (select *, row_number() over () as rid from ({files})), known(word, idf) as (values {known}), unit(license, wording, word, v) as (values {unit}),
lines as (select path, rid, unnest(range(len(l)))::int as segment, unnest(l) as text from (select path, rid, string_split(text, chr(10)) as l from files)),
paragraphs as (select path, rid, -2 - unnest(range(len(l)))::int as segment, unnest(l) as text from (select path, rid, string_split_regex(text, '\\n(?:[^A-Za-z0-9\\n]*\\n)+') as l from files)),
segments as (select * from (select * from lines union all select * from paragraphs where contains(text, chr(10)) union all select path, rid, -1, text from files) where regexp_matches(text, '(?i)(?:^|[^a-z0-9])(?:{'|'.join(KEYS)})(?:$|[^a-z0-9])')),
terms as (select path, rid, segment, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+')) as word from segments),
weighted as (select path, rid, segment, word, count(*) * coalesce(any_value(idf), {other!r}) as w from terms left join known using (word) group by all),
norms as (select path, rid, segment, sqrt(sum(w * w)) as norm from weighted group by all),
scored as (select path, rid, segment, license, wording, round(sum(w * v) / any_value(norm), 6) as score from weighted join unit using (word) join norms using (path, rid, segment) group by all),
hits as (select *, bool_or(segment in (0, -1, -2)) over (partition by path) as wide, row_number() over (partition by path order by score desc, license, segment) as r from scored where score >= {least}),
own as (select * from hits where r = 1),
placed as (select *, nullif(regexp_extract(path, '^(.*)/', 1), '') as dir from files),
declared as (select dir as place, arg_min(license, struct_pack(s := -score, l := license)) as found from own join (select distinct path, dir from placed) using (path) where wide and dir is not null group by all),
nearest as (select dir, arg_max(found, length(place)) as found, arg_max(place, length(place)) as place from (select distinct dir from placed) d join declared on d.dir = place or starts_with(d.dir, place || '/') group by dir)
select doc_id, path, own.license as own_license, own.score, own.segment, coalesce(own.license, nearest.found) as license, case when own.license is null then nearest.place end as inherited_from
from placed left join own using (path) left join nearest using (dir)"""
