"""Operator 10 [native]: licence scan of a file tree.

The units of a file are, by level: 0 its header (the comment that it begins
with, after a line ``#!`` or ``<?``) and, if its name is that of a licence file,
its whole text; 1 the paragraphs of those; 2 each line. A unit is a sparse
TF-IDF vector over its terms but for common words; the inverse document
frequencies are those of the templates (standard headers, titles, short licence
texts, tags), and a term of no template weighs as one that is rarer than all. A
unit takes the template of the largest cosine if that is at least ``limit``. A
file takes the best unit of its lowest level that has one, so a line that was
wrapped out of a header doesn't speak against the header. A file without a
licence of its own inherits that of the nearest directory above it that has a
licence file, by a join of its ancestor paths with the directories' licences.

All of it is DataFrame operations. A cosine with a template is at most the share
of a unit's length that lies in terms of templates, so units whose share is
under the limit are left out before their terms are exploded; none of them could
match. Aggregates are by unit, file and directory, with partial sums; the
template table is a bounded constant and the only table that is broadcast. Full
texts of long licences are recognised by their title and by the notice that they
recommend; other templates can be given as ``notices``.

Null and empty texts have no licence of their own but can inherit. A file with
a null path has none, and inherits none. Rows repeated with one path count as
one file with the lines of all of them, and each gives a result row. Of equal
cosines the template that sorts first counts; of a directory's licence files
the path that sorts first. Columns other than path and text pass by unread.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Notices, standard headers, titles and texts of public licences.
NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-2-Clause", "BSD 2-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: A tag names a licence by its identifier, so each licence has the template of its tag too.
TAG = "SPDX-License-Identifier: {}"
NOTICES += tuple((name, TAG.format(name)) for name in sorted({n for n, _ in NOTICES}))
#: Common words, which aren't terms.
COMMON = tuple("a all and any are as at be by can does for form found from has in into is it its law may not of on or other that the this to under up use used v was what which who with without you".split())
#: The term separator; terms are runs of ASCII letters and digits in lower case.
SEPARATOR = "[^a-z0-9]+"
#: Comments that a header can be: from a mark to its end, or lines that begin with a mark.
BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'))
COMMENT_LINE = "^[ \\t]*(#|//|--|;|%)"
BLANK = " \t\r\n"
#: Paragraphs end at lines without a letter or digit.
PARAGRAPH = "\\n[^A-Za-z0-9]*\\n"
LICENCE_FILE = r"(^|/)(licen[cs]e|copying|notice)([.][^/]*)?$"
LIMIT = 0.6


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(SEPARATOR, text.lower()) if t and t not in COMMON]


def template_weights(notices: tuple[tuple[str, str], ...]) -> tuple[list[tuple[int, str, str, float, float]], dict[str, float], float]:
    """Rows (template, licence, term, weight of the term in the unit vector, idf); idf by term; idf of other terms."""
    bags = [Counter(terms_of(t)) for _, t in notices]
    seen = Counter(t for b in bags for t in b)
    idf = {t: round(math.log((len(bags) + 1) / (n + 1)) + 1, 9) for t, n in seen.items()}
    rows = []
    for i, ((name, _), bag) in enumerate(zip(notices, bags, strict=True)):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(i, name, t, n * idf[t] / length, idf[t]) for t, n in sorted(bag.items())]
    return rows, idf, round(math.log(len(bags) + 1) + 1, 9)


def squared_counts(terms: Column) -> Column:
    """The sum of n * n over the distinct values of an array, each there n times."""
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(F.lit(1.0))
        return F.struct(t.alias("last"), run.alias("run"), (a["total"] + 2 * run - 1).alias("total"))

    return F.aggregate(F.array_sort(terms), start, step, lambda a: a["total"])


def header(text: Column) -> Column:
    """The comment that a text begins with, after a line ``#!`` or ``<?``; NULL if there is none."""
    start = F.ltrim(text, F.lit(BLANK))
    after = F.ltrim(F.substr(start, F.instr(start, "\n") + 1), F.lit(BLANK))
    body = F.when(start.startswith("#!") | start.startswith("<?"), after).otherwise(start)
    lines = F.split(body, "\n")
    other = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT_LINE)), False)
    found = F.when(body.rlike(COMMENT_LINE), F.array_join(F.slice(lines, F.lit(1), F.when(other > 0, other - 1).otherwise(F.size(lines)).cast("int")), "\n"))
    for first, last in BLOCKS:
        inside = F.substr(body, F.lit(len(first) + 1))
        found = F.when(body.startswith(first), F.substring_index(inside, last, 1)).otherwise(found)
    return found


def scan_licenses(files: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, limit: float = LIMIT,
                  path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, ``license``, ``basis``: own, inherited or none, ``similarity``, ``licence_path``) for each row."""
    spark = files.sparkSession
    rows, idf, other = template_weights(notices)
    table = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double, idf double"))
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    paths = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    is_file = F.lower("path").rlike(LICENCE_FILE)
    known, common = sorted(idf), ["", *COMMON]
    most = max(idf.values(), default=0.0)
    split = lambda text: F.split(F.lower(text), SEPARATOR)
    # A unit's key is its place and a hash, not its text, so that a row of a term stays small.
    present = paths.where("path IS NOT NULL")
    whole = present.select("path", F.explode(F.array(header(F.col("text")), F.when(is_file, F.col("text")))).alias("unit")).where("unit IS NOT NULL")
    units = reduce(DataFrame.unionByName, [
        whole.select("path", F.lit(0).alias("level"), F.lit(0).alias("place"), "unit"),
        whole.select("path", F.lit(1).alias("level"), F.posexplode(F.split("unit", PARAGRAPH)).alias("place", "unit")),
        present.select("path", F.lit(2).alias("level"), F.posexplode(F.split("text", "\n")).alias("place", "unit"))])
    units = units.select("path", F.struct("level", "place", F.xxhash64("unit")).alias("unit"), split(F.col("unit")).alias("terms"))
    # Terms of no template only add to a unit's length, all with one weight, so they get no rows of their own.
    units = units.select("path", "unit", F.filter("terms", lambda t: t.isin(known)).alias("inside"), F.filter("terms", lambda t: ~t.isin(known + common)).alias("outside")).where(F.size("inside") > 0)
    units = units.withColumn("rest", squared_counts(F.col("outside")) * other * other)
    # No cosine is above the part of the length inside; "most" is the largest weight there. A little slack for rounding.
    can_match = squared_counts(F.col("inside")) * (most * most) * (1 - limit * limit) >= F.col("rest") * (limit * limit) * (1 - 1e-6) - 1e-5
    # A unit of a repeated row has the same terms, each as often, so the maxima take each unit once.
    counted = F.transform(F.array_distinct("inside"), lambda t: F.struct(t.alias("term"), F.size(F.filter("inside", lambda x: x == t)).alias("n")))
    counts = (units.where(can_match)
              .select("path", "unit", "rest", F.explode(counted).alias("counted"))
              .groupBy("path", "unit", F.col("counted.term").alias("term")).agg(F.max("counted.n").alias("n"), F.max("rest").alias("rest")))
    # Written, as both the lengths and the products read it.
    weighed = cut_lineage(counts.join(weights, "term").select("path", "unit", "term", "rest", (F.col("n") * F.col("idf")).alias("w")))
    length = weighed.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.max("rest")).alias("length"))
    dots = weighed.join(table.select("template", "license", "term", "weight"), "term").groupBy("path", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dots.join(length, ["path", "unit"]).select("path", "license", F.col("unit.level").alias("level"), F.round(F.col("dot") / F.col("length"), 6).alias("similarity"))
    best = F.min(F.struct("level", (-F.col("similarity")).alias("less"), "license"))
    own = cut_lineage(cosine.where(F.col("similarity") >= limit).groupBy("path").agg(best.alias("best"))
                      .select("path", F.col("best.license").alias("own"), (-F.col("best.less")).alias("similarity")))
    # Written, so that adaptive execution can split a directory of many files.
    above = cut_lineage(own.where(is_file).select(F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), "path", F.col("own").alias("given"))
                        .groupBy("directory").agg(F.min("path").alias("licence_path"), F.min_by("given", "path").alias("given")))
    need = paths.select("path").distinct().where("path IS NOT NULL").join(own, "path", "left_anti")
    parts = F.split("path", "/")
    parents = need.select("path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")).select(
        "path", "depth", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth"))).alias("directory"))
    inherited = parents.join(above, "directory").groupBy("path").agg(F.max_by("given", "depth").alias("inherited"), F.max_by("licence_path", "depth").alias("licence_path"))
    return (paths.select("path").join(own, "path", "left").join(inherited, "path", "left")
            .select(F.col("path").alias(path_col), F.coalesce("own", "inherited").alias("license"),
                    F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("basis"),
                    "similarity", "licence_path"))


def tree_of_documents(docs: DataFrame) -> DataFrame:
    """Documents as a file tree: source, hundreds of the id, file. A document that
    begins with a licence line is its directory's LICENSE file. A null source
    leaves out that level; a null id gives a null path."""
    begins = F.lower(F.substring_index("text", "\n", 1)).rlike("licen[cs]e|copyright")
    name = F.when(begins, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 100).cast("string"), name))
    return docs.select("doc_id", path.alias("path"), "text")


def document_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, path, license, basis, similarity, licence_path) for each document."""
    tree = tree_of_documents(docs)
    found = scan_licenses(tree).dropDuplicates(["path"])
    return (tree.select("doc_id", "path").join(found, "path", "left")
            .select("doc_id", "path", "license", F.coalesce("basis", F.lit("none")).alias("basis"), "similarity", "licence_path"))


def oracle() -> str:
    """The same in DuckDB SQL, with the weights computed there and no line left out beforehand."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    common = ", ".join(map(quote, ("", *COMMON)))
    blank = " || ".join(f"chr({ord(c)})" for c in BLANK)
    blocks = " ".join(f"WHEN starts_with(body, '{a}') THEN string_split(substr(body, {len(a) + 1}), '{z}')[1]" for a, z in BLOCKS)
    values = ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(NOTICES))
    return rf"""
        WITH notice(template, license, body) AS (VALUES {values}),
        bag AS (SELECT template, license, term, count(*) AS n
                FROM (SELECT template, license, unnest(regexp_split_to_array(lower(body), '{SEPARATOR}')) AS term FROM notice) WHERE term NOT IN ({common}) GROUP BY ALL),
        idf AS (SELECT term, round(ln((SELECT count(*) + 1 FROM notice) / (count(*) + 1)) + 1, 9) AS idf FROM bag GROUP BY term),
        unit_vector AS (SELECT template, license, term, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS weight FROM bag JOIN idf USING (term)),
        other AS (SELECT round(ln(count(*) + 1) + 1, 9) AS idf FROM notice),
        tree AS (SELECT doc_id, text, CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', source, CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR),
                    CASE WHEN regexp_matches(lower(string_split(text, chr(10))[1]), 'licen[cs]e|copyright') THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) END AS path FROM documents),
        started AS (SELECT path, text, ltrim(text, {blank}) AS start FROM tree WHERE path IS NOT NULL),
        bodies AS (SELECT path, text, CASE WHEN starts_with(start, '#!') OR starts_with(start, '<?') THEN ltrim(substr(start, strpos(start, chr(10)) + 1), {blank}) ELSE start END AS body FROM started),
        commented AS (SELECT *, string_split(body, chr(10)) AS lines FROM bodies),
        whole AS (SELECT path, CASE {blocks}
                         WHEN regexp_matches(body, '{COMMENT_LINE}') THEN array_to_string(lines[1:coalesce(nullif(list_position([regexp_matches(x, '{COMMENT_LINE}') FOR x IN lines], false), 0), len(lines) + 1) - 1], chr(10)) END AS unit FROM commented
                  UNION ALL SELECT path, text FROM started WHERE regexp_matches(lower(path), '{LICENCE_FILE}')),
        units AS (SELECT DISTINCT path, level, unit FROM (
                    SELECT path, 0 AS level, unit FROM whole
                    UNION ALL SELECT path, 1, unnest(regexp_split_to_array(unit, '{PARAGRAPH}')) FROM whole
                    UNION ALL SELECT path, 2, unnest(string_split(text, chr(10))) FROM started) WHERE unit IS NOT NULL),
        counts AS (SELECT path, level, unit, term, count(*) AS n FROM (SELECT path, level, unit, unnest(regexp_split_to_array(lower(unit), '{SEPARATOR}')) AS term FROM units) WHERE term NOT IN ({common}) GROUP BY ALL),
        weighed AS (SELECT path, level, unit, term, n * coalesce(idf.idf, other.idf) AS w FROM counts LEFT JOIN idf USING (term), other),
        lengths AS (SELECT path, level, unit, sqrt(sum(w * w)) AS length FROM weighed GROUP BY ALL),
        dots AS (SELECT path, level, unit, template, license, sum(w * weight) AS dot FROM weighed JOIN unit_vector USING (term) GROUP BY ALL),
        cosines AS (SELECT path, level, license, round(dot / length, 6) AS similarity FROM dots JOIN lengths USING (path, level, unit)),
        own AS (SELECT path, license, similarity FROM cosines WHERE similarity >= {LIMIT}
                QUALIFY row_number() OVER (PARTITION BY path ORDER BY level, similarity DESC, license) = 1),
        above AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS directory, path AS licence_path, license AS given FROM own
                  WHERE regexp_matches(lower(path), '{LICENCE_FILE}') QUALIFY row_number() OVER (PARTITION BY directory ORDER BY path) = 1),
        near AS (SELECT t.path, a.licence_path, a.given FROM tree t JOIN above a ON a.directory = '' OR starts_with(t.path, a.directory || '/')
                 WHERE t.path NOT IN (SELECT path FROM own) QUALIFY row_number() OVER (PARTITION BY t.path ORDER BY length(a.directory) DESC) = 1)
        SELECT t.doc_id, t.path, coalesce(o.license, n.given) AS license,
               CASE WHEN o.path IS NOT NULL THEN 'own' WHEN n.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis, o.similarity, n.licence_path
        FROM tree t LEFT JOIN own o ON t.path = o.path LEFT JOIN near n ON t.path = n.path"""
