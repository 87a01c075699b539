"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance along paths.

Only DataFrame functions run here. A text is compared by three kinds of units: its lines, its blocks
(runs of lines up to one without a letter or digit: header comments, clauses) and the whole of it (a
license file). A unit is a vector over its terms, runs of a-z and digits, so comment marks fall away;
inverse document frequencies come from all texts. Two bounds keep the work small, and neither loses a
match: a unit without any of the templates' rarer terms cannot reach the threshold, so texts without
one are left out; and a unit's cosine is at most what it would be if its terms outside the templates
were in all texts, so only units above the threshold by that bound have those terms' frequencies
counted. Texts without a license of their own take the one of the license file in the nearest
directory above them, by joins of directories, not of files.
"""

from __future__ import annotations

import json
import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, let, written

#: Texts that the scan knows, by SPDX identifier: tags, one-line notices, titles, file
#: headers, and the paragraphs that grant the license. Paragraphs are compared with blocks, and all
#: paragraphs of one grant in a row, as they stand in a license file, with whole texts too.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSL-1.0": (
        "SPDX-License-Identifier: BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
    ),
    "CC-BY-4.0": (
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "GPL-2.0": (
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-3.0": (
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "SPDX-License-Identifier: Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}
THRESHOLD = 0.8
#: Terms whose frequencies are asked for, up to which they are broadcast.
MOST_TERMS = 200_000
BETWEEN, BREAK = "[^a-z0-9]+", "\\n[^a-z0-9]*\\n"
#: The kinds of units, by the number that orders them in ties.
UNITS = ("line", "block", "text")


def terms(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.lower()) if w]


def _terms(text: Column) -> Column:
    """The terms of a text in lower case."""
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def frequencies(texts: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of texts, and for each term of the texts that hold it: a row a term."""
    held = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), BETWEEN), lambda w: w.isin(*vocabulary)))
    # The empty term counts the texts. An outer explode: for an inner one Spark infers a filter that
    # would make the array twice.
    marks = texts.select(F.explode_outer(F.concat(held, F.array(F.lit("")))).alias("term"))
    got = {r["term"]: r["n"] for r in marks.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return got.pop("", 0), got


def needed(bags: list[dict[str, float]], often: dict[str, int], threshold: float) -> list[str]:
    """Terms one of which every unit like a template holds: all but the commonest, as many of these
    as leave each template less than `threshold` of its length. `bags` are tf times idf by term."""
    size = [sum(x * x for x in b.values()) for b in bags]
    held, common = [0.0] * len(bags), set()
    vocabulary = {w for b in bags for w in b}
    for w in sorted(vocabulary, key=lambda w: (-often.get(w, 0), w)):
        now = [h + b.get(w, 0.0) ** 2 for h, b in zip(held, bags, strict=True)]
        if all(x < (threshold - 1e-6) ** 2 * s for x, s in zip(now, size, strict=True)):
            held = now
            common.add(w)
    return sorted(vocabulary - common)


def units(texts: DataFrame) -> DataFrame:
    """(body, kind, at, terms) of each line, block and whole of (body, text), text in lower case."""

    def some(kind: int, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), _terms(x).alias("terms")))

    t = F.col("text")
    return texts.select("body", F.explode(F.concat(some(0, F.split(t, "\n", -1)), some(1, F.split(t, BREAK, -1)), some(2, F.array(t)))).alias("u")).select("body", "u.*")


def matched(texts: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per distinct text with a unit like a template: body (a 64-bit hash of the text), license,
    score (rounded to 6 places), unit ('line', 'block' or 'text') and at, its number in the text.

    The best unit counts; ties take lines before blocks before the whole, then the earlier unit, then
    the least identifier. Null and empty texts have no term. Rows of equal texts are one.
    """
    named = [(k, {w: terms(v).count(w) for w in sorted(set(terms(v)))}) for k, vs in sorted(templates.items()) for v in vs]
    vocabulary = sorted({w for _, b in named for w in b})
    n, df = frequencies(texts, text, vocabulary)
    idf = {w: log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    weighed = [{w: tf * idf[w] for w, tf in b.items()} for _, b in named]
    spark = texts.sparkSession
    asked = needed(weighed, df, threshold)
    # Templates are a handful of fixed texts: their weights are part of the plan.
    weights = F.from_json(F.lit(json.dumps(idf)), "map<string,double>")
    rows = [(k, str(t), w, x * idf[w] / sum(y * y for y in b.values()) ** 0.5) for t, ((k, _), b) in enumerate(zip(named, weighed, strict=True)) for w, x in b.items()]
    known = F.from_json(F.lit(json.dumps([dict(zip(("license", "template", "term", "weight"), r, strict=True)) for r in rows])), "array<struct<license:string,template:string,term:string,weight:double>>")
    known = spark.range(1).select(F.inline(known))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = texts.select(F.xxhash64(t).alias("body"), F.lower(t).alias("text"))
    some = written(held.where(F.exists(F.split("text", BETWEEN), lambda w: w.isin(*asked))).dropDuplicates(["body"]), "candidates")

    def bag(t: Column) -> Column:
        # Sorted, so that equal terms are side by side: a run's end less its start is its number.
        def runs(x: Column) -> Column:
            ends = F.filter(F.transform(x, lambda w, i: F.when(F.coalesce(F.get(x, i + 1) != w, F.lit(True)), i)), lambda i: i.isNotNull())
            return let(ends, lambda e: F.transform(e, lambda at, k: F.struct(F.get(x, at).alias("term"), (at - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("tf"))))

        return let(F.array_sort(t), runs)

    square = lambda x: x * x
    key = ["body", "kind", "at"]
    all_units = units(some)
    # A term weighs 1 at least, and tf^2 is tf at least: so much do the other terms add to the square
    # of a unit's length, whatever their frequencies.
    found = all_units.withColumn("inside", F.filter("terms", lambda w: w.isin(*vocabulary))).where(F.exists("inside", lambda w: w.isin(*asked))).withColumn("others", F.size("terms") - F.size("inside"))
    found = (
        found.withColumn("bag", bag(F.col("inside")))
        .withColumn("norm", F.aggregate("bag", F.lit(0.0), lambda a, x: a + square(x["tf"] * F.element_at(weights, x["term"]))))
        .where((1 - threshold**2) * F.col("norm") >= threshold**2 * F.col("others") - 1e-6)
        .select(*key, "norm", "others", F.explode("bag").alias("t"))
        .select(*key, "norm", "others", "t.*")
    )
    near = (
        found.join(F.broadcast(known), "term")
        .groupBy(*key, "license", "template")
        .agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"), F.first("others").alias("others"))
        .where(F.col("dot") >= (threshold - 1e-6) * F.sqrt(F.col("norm") + F.col("others")))
    )
    near = written(near, "near")
    # The other terms of these units, with their frequencies in all texts.
    more = all_units.join(near.where("others > 0").select(*key).distinct(), key, "left_semi")
    outside = F.filter("terms", lambda w: ~w.isin(*vocabulary))
    more = written(more.select(*key, F.explode(bag(outside)).alias("t")).select(*key, "t.*"), "others")
    counts = _counts(texts, text, more.select("term").distinct())
    weight = F.log((1 + n) / (1 + F.coalesce("n", F.lit(0)))) + 1
    rest = more.join(counts, "term", "left").groupBy(*key).agg(F.sum(square(F.col("tf") * weight)).alias("rest"))
    best = (
        near.join(rest, key, "left")
        .withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("norm") + F.coalesce("rest", F.lit(0.0))), 6))
        .where(F.col("score") >= threshold)
        .groupBy("body")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "kind", "at", "license")).alias("best"))
    )
    return best.select("body", "best.license", (-F.col("best.minus")).alias("score"), F.get(F.array(*map(F.lit, UNITS)), F.col("best.kind")).alias("unit"), "best.at")


def _counts(texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(term, n) of the wanted terms: the texts that hold each."""
    held = texts.select(F.explode(F.array_distinct(_terms(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))))).alias("term"))
    wanted = written(wanted, "terms")
    if wanted.isEmpty():
        return wanted.withColumn("n", F.lit(0).cast("long"))
    if fits(wanted, MOST_TERMS):
        return held.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return held.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term", "left_semi")


def scanned(files: DataFrame, id: str = "doc_id", path: str = "path", text: str = "text", is_license_file: Column | None = None, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of `files`: id, license, score, origin ('own', 'inherited' or 'none'), from_dir.

    A file's own license is that of its best unit. License files pass theirs to all files below their
    directory that have none; the nearest directory wins, in one directory the higher score, then the
    least identifier. They are those named LICENSE, LICENCE, COPYING or NOTICE, whatever follows, or
    those where `is_license_file` holds, a column of unit and at of the best unit. A null path lies in
    no directory; a path without `/` in the root, ''. Rows that share an id, a path or a text are
    judged each. An id column of the name of another column here is named id_.
    """
    p = F.coalesce(F.col(f"`{path}`"), F.lit(""))
    name, folder = F.substring_index(p, "/", -1), F.when(F.instr(p, "/") > 0, F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1)).otherwise(F.lit(""))
    files_ = files.select(
        F.col(f"`{id}`").alias("id"),
        F.when(F.col(f"`{path}`").isNotNull(), folder).alias("dir"),
        F.regexp_like(name, F.lit("(?i)^(licen[cs]e|copying|notice)")).alias("named"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"),
    )
    own = written(matched(files, text, templates, threshold), "own")
    gives = F.col("named") if is_license_file is None else is_license_file
    rows = files_.join(own, "body", "left").select("id", "dir", "license", "score", F.coalesce(gives, F.lit(False)).alias("gives"))
    rows = written(rows, "rows")
    given = (
        rows.where(F.col("gives") & F.col("license").isNotNull() & F.col("dir").isNotNull())
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("g"))
        .select(F.col("dir").alias("from_dir"), F.col("g.license").alias("dir_license"), (-F.col("g.minus")).alias("dir_score"))
    )
    depth = F.size(F.split("dir", "/"))
    above = (
        rows.where("dir is not null")
        .select("dir")
        .distinct()
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(depth))))
        .withColumn("from_dir", F.when(F.col("k") == 0, F.lit("")).otherwise(F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("k")), "/")))
        .join(given, "from_dir")
        .groupBy("dir")
        .agg(F.max(F.struct("k", "from_dir", "dir_license", "dir_score")).alias("near"))
    )
    out = rows.join(above, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(f"{id}_" if id.lower() in ("license", "score", "origin", "from_dir") else id),
        F.coalesce("license", "near.dir_license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("near.dir_score")).alias("score"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("dir")).otherwise(F.col("near.from_dir")).alias("from_dir"),
    )
