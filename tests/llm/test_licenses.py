"""Operator 10 by hand; the registered query has its SQL."""
import math
import random
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from routelens.llm.op10_licenses import NOTICES, document_licenses, header, scan_licenses, template_weights, terms_of

MIT = "Released under the MIT License."


def test_tree(spark):
    rows = [("a/LICENSE", "This work is licensed under the GNU General Public License, version 3.\nmore words of no term"), ("a/x.py", "nothing"), ("a/b/y.py", f"# {MIT}\ncode"),
            ("a/b/c/z.py", None), ("a/b/LICENSE.txt", MIT + "\n" + MIT), ("q/r.py", "no notice here"), ("LICENSES", "x"), (None, MIT), ("a/x.py", "nothing"),
            ("q/long.py", "word " * 100000 + "\nLicensed under CC BY-NC 4.0."), ("top.py", "")]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "path string, text string, license string").repartition(3)
    got = {}
    for r in scan_licenses(files).collect():
        got.setdefault(r["path"], []).append((r["license"], r["basis"], r["licence_path"]))
    assert got == {
        "a/LICENSE": [("GPL-3.0", "own", None)], "a/x.py": [("GPL-3.0", "inherited", "a/LICENSE")] * 2, "a/b/y.py": [("MIT", "own", None)],
        "a/b/c/z.py": [("MIT", "inherited", "a/b/LICENSE.txt")], "a/b/LICENSE.txt": [("MIT", "own", None)], "q/r.py": [(None, "none", None)],
        "LICENSES": [(None, "none", None)], None: [(None, "none", None)], "q/long.py": [("CC-BY-NC-4.0", "own", None)], "top.py": [(None, "none", None)]}
    assert scan_licenses(files.limit(0)).count() == 0


def test_root_licence(spark):
    files = spark.createDataFrame([("LICENSE", MIT), ("a/b/c.py", "x"), ("d.py", "y")], "path string, text string")
    assert {r["path"]: r["basis"] for r in scan_licenses(files).collect()} == {"LICENSE": "own", "a/b/c.py": "inherited", "d.py": "inherited"}


def test_documents(make):
    rows = [(1, MIT + "\nbody"), (2, "body"), (103, "body"), (None, MIT), (4, None), (4, None), (5, "body\n" + MIT)]
    got = sorted(((r["doc_id"], r["license"], r["basis"]) for r in document_licenses(make(rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", "own"), (2, None, "none"), (103, None, "none"), (None, None, "none"), (4, None, "none"), (4, None, "none"), (5, "MIT", "own")], key=str)


def test_plan_has_no_python(make):
    plan = document_licenses(make([(1, MIT)]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_repeated_rows_of_mixed_terms(spark):
    """A document counts once, however often its row is there."""
    mixed = "Released under the MIT License foo bar baz qux"
    rows = [("a/x.py", mixed), ("b/LICENSE", mixed), ("b/y.py", "nothing"), ("c/z.py", f"{mixed}\n{MIT} foo\n{MIT} foo")]
    once = {r["path"]: r for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [once[p]["basis"] for p in ("a/x.py", "b/LICENSE", "b/y.py", "c/z.py")] == ["none", "none", "none", "own"]
    for r in scan_licenses(spark.createDataFrame(rows * 3, "path string, text string").repartition(3)).collect():
        assert r == once[r["path"]]


HEADERS = {
    "GPL-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}


def wrap(text, style):
    lines = ["Copyright (C) 2020 Some Author", "", *text.split("\n")]
    if style == "hash":
        return "#!/bin/sh\n" + "\n".join(f"# {x}" for x in lines) + "\n\nexit 0"
    if style == "star":
        return "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint main;"
    if style == "block":
        return "/*\n" + "\n".join(lines) + "\n*/\nint main;"
    return '"""' + "\n".join(lines) + '\n"""\nimport os'


def test_headers_of_each_licence(spark):
    """Wrapped standard headers, in each style of comment, take their own licence."""
    rows = [(f"{style}/{name}.src", wrap(text, style)) for name, text in HEADERS.items() for style in ("hash", "star", "block", "doc")]
    got = {r["path"]: r["license"] for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {p: p.split("/")[1][:-4] for p, _ in rows}


def test_titles_and_tags(spark):
    titles = {"GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991",
              "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007",
              "Apache-2.0": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "EPL-2.0": "Eclipse Public License - v 2.0", "MPL-2.0": "Mozilla Public License Version 2.0"}
    body = "\n\nEveryone is permitted to make verbatim copies. " + "Preamble of many words that stand in no template whatsoever. " * 30
    rows = [(f"t/{n}/COPYING", t + body) for n, t in titles.items()] + [(f"t/{n}/deep/x.c", "int x;") for n in titles]
    names = sorted({n for n, _ in NOTICES})
    rows += [(f"s/{n}/x.c", f"// SPDX-License-Identifier: {n}\nint x;") for n in names] + [("s/Zlib/x.c", "// SPDX-License-Identifier: Zlib\nint x;"), ("s/GPL-2.0/y.c", "// SPDX-License-Identifier: GPL-2.0-only\nint x;")]
    for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect():
        name = r["path"].split("/")[1]
        assert r["license"] == (None if name == "Zlib" else name), r
        assert r["basis"] == ("none" if name == "Zlib" else "inherited" if "deep" in r["path"] else "own")


def test_full_texts(spark):
    """The texts of the short licences as licence files, with a copyright line."""
    whole = {n: max((t for m, t in NOTICES if m == n), key=len) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")}
    rows = [(f"{n}/LICENSE", "Copyright (c) 2021 Some Author\n\n" + "\n".join(textwrap.wrap(t, 70))) for n, t in whole.items()]
    got = {r["path"]: r["license"] for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"{n}/LICENSE": n for n in whole}


def test_header(spark):
    texts = ["# a\n# b\nc", "#!/x\n\n// a\n//b", "/* a\n b */ c", "<!-- a --> b", '"""a"""\nb', "plain\n# a", "", None, "#!only", "<?php\n/* a */", "/* open", "-- a"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(header(F.col("t"))).collect()]
    assert got == ["# a\n# b", "// a\n//b", " a\n b ", " a ", "a", None, None, None, "#!only", " a ", " open", "-- a"]


def test_left_out_units_cannot_match(spark):
    """Random lines of template words and others: the same as every cosine computed in Python."""
    rnd = random.Random(3)
    rows, idf, other = template_weights(NOTICES)
    vectors = {}
    for i, name, t, w, _ in rows:
        vectors.setdefault((i, name), {})[t] = w
    lines = []
    for _ in range(300):
        words = terms_of(rnd.choice(NOTICES)[1])[:14]
        lines.append(" ".join(rnd.sample(words, rnd.randint(1, len(words))) + [f"zz{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 8))]))
    got = {r["path"]: r["similarity"] for r in scan_licenses(spark.createDataFrame([(f"{i}.c", x) for i, x in enumerate(lines)], "path string, text string")).collect()}
    for i, x in enumerate(lines):
        bag = {t: n * idf.get(t, other) for t, n in Counter(terms_of(x)).items()}
        best = max(sum(w * v.get(t, 0.0) for t, w in bag.items()) for v in vectors.values()) / math.sqrt(sum(w * w for w in bag.values()))
        assert (got[f"{i}.c"] is None) == (round(best, 6) < 0.6) and (got[f"{i}.c"] is None or abs(got[f"{i}.c"] - best) < 2e-6), (x, best)
