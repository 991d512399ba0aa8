from __future__ import annotations

import math
import re
import textwrap
from collections import Counter

from wickline.llm import licence_texts
from wickline.llm.licences import TEMPLATES, THRESHOLD, WORD, scan_licences, telling_words, weights

SCHEMA = "doc_id long, text string, path string"
LONG = " ".join(f"w{i}" for i in range(100))
ROWS = [
    (1, "Licensed under the Apache License, Version 2.0.", "a/LICENSE"),
    (2, LONG, "a/b/c.txt"),
    (3, f"{LONG}\n(MIT) released under the MIT license\n{LONG}", "a/b/own.txt"),
    (4, "Released under the MIT License.", "a/b/d/COPYING"),
    (5, LONG, "a/b/d/e/f/g.txt"),
    (6, LONG, "z/none.txt"),
    (7, None, "a/null.txt"),
    (8, "", None),
    (9, "Licensed under CC BY-NC 4.0.", None),
    (2, LONG, "a/b/c.txt"),
    (9, "Licensed under CC BY-NC 4.0.", None),
    (None, "the of and to in", "a/x"),
    (10, "Released under the MIT License.\n" + LONG, "q/small.txt"),
    (11, LONG, "q/next.txt"),
]


def brute_cosine(line):
    idf, unseen, vectors = weights(TEMPLATES)
    counts = Counter(re.findall(WORD, line.lower()))
    norm = math.sqrt(sum((n * idf.get(w, unseen)) ** 2 for w, n in counts.items()))
    return min((-round(sum(n * idf.get(w, unseen) * v.get(w, 0) for w, n in counts.items()) / norm, 9), name) for name, v in vectors.items()) if norm else None


def test_scan_and_inheritance(spark):
    out = scan_licences(spark.createDataFrame(ROWS, SCHEMA), "path")
    plan = out._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "Cartesian", "NestedLoop"))
    got = sorted(((r.doc_id, r.own_licence, r.licence, r.inherited_from) for r in out.collect()), key=str)
    want = [
        (1, "Apache-2.0", "Apache-2.0", None),
        (2, None, "Apache-2.0", "a"),
        (2, None, "Apache-2.0", "a"),
        (3, "MIT", "MIT", None),
        (4, "MIT", "MIT", None),
        (5, None, "MIT", "a/b/d"),
        (6, None, None, None),
        (7, None, "Apache-2.0", "a"),
        (8, None, None, None),
        (9, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        (9, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        (None, None, "Apache-2.0", "a"),
        (10, "MIT", "MIT", None),
        (11, None, None, None),
    ]
    assert got == sorted(want, key=str)


def test_cosines_against_loops(spark):
    lines = [*TEMPLATES.values(), "GNU GPL version 3", "licensed under the gnu general public license", "the of and", "All rights", "MIT MIT", "x"]
    rows = [(i, line, "p") for i, line in enumerate(lines)]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, SCHEMA), "path").collect()}
    for i, line in enumerate(lines):
        less, name = brute_cosine(line)
        if -less >= THRESHOLD:
            assert got[i].own_licence == name and abs(got[i].cosine + less) < 1e-8
        else:
            assert got[i].own_licence is None
    assert all(got[i].own_licence == name for i, name in enumerate(TEMPLATES))


def test_other_words_cant_reach_the_threshold():
    idf, _, vectors = weights(TEMPLATES)
    telling = set(telling_words(idf, vectors, THRESHOLD))
    for v in vectors.values():
        assert math.sqrt(sum(x * x for w, x in v.items() if w not in telling)) < THRESHOLD


def test_empty_table(spark):
    assert scan_licences(spark.createDataFrame([], SCHEMA), "path").count() == 0


CODE = "import os\n" + "\n".join(f"def name_{i}(arg): return arg + value_{i}" for i in range(40))
APACHE = """# Copyright 2019 The Example Authors. All Rights Reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL2 = """/* frob.c - frobs
 * Copyright (C) 2001 A. Hacker
 *
 * This file is free software; you can redistribute it and/or modify it under
 * the terms of the GNU General Public License as published by the Free
 * Software Foundation; either version 2, or (at your option) any later version.
 *
 * It is distributed in the hope that it will be useful, but WITHOUT ANY
 * WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
 * A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
 */
"""


def full(name, kind="FULL"):
    return getattr(licence_texts, kind)[name][0]


HEADERS = [
    ("Copyright 2020 Example Inc. All rights reserved.", "Proprietary"),
    ("(c) Acme. All rights reserved.\n" + CODE, "Proprietary"),
    ("MIT License", "MIT"),
    ("The MIT License (MIT)\n\nCopyright (c) 2020 Jo", "MIT"),
    ("Released under the MIT License. See LICENSE for details.", "MIT"),
    (CODE + "\n# SPDX-License-Identifier: Apache-2.0\n" + CODE, "Apache-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only\n" + CODE, "GPL-2.0"),
    (APACHE + CODE, "Apache-2.0"),
    (GPL2 + CODE, "GPL-2.0"),
    ("Foo\nCopyright 2018 Jo. All rights reserved.\n\n" + full("BSD-3-Clause", "HEADERS").replace("copyright holder nor", "Foo project nor"), "BSD-3-Clause"),
    ("Copyright (c) 2017 Jo Doe\n\n" + "\n".join(textwrap.wrap(full("MIT", "HEADERS").replace("AUTHORS OR COPYRIGHT", "JO DOE OR COPYRIGHT"), 60)) + "\n" + CODE, "MIT"),
    ("The licence of frob follows.\n" + full("GPL-3.0"), "GPL-3.0"),
    (full("MPL-2.0") + "\nExhibit C: none", "MPL-2.0"),
    (full("LGPL-2.1")[2000:], "LGPL-2.1"),
    ("see the license\n" + CODE, None),
    ("MIT der Zeit und mit dem Rest", None),
    ("this software is provided for use without copies of any notice\n" + CODE, None),
]


def test_headers_and_texts_among_other_words(spark):
    known = {t for kind in (licence_texts.NAMES, licence_texts.HEADERS, licence_texts.FULL) for given in kind.values() for t in given}
    rows = [(i, text, f"s/f{i}.c") for i, (text, _) in enumerate(HEADERS)]
    assert sum(text in known for _, text, _ in rows) == 1  # the bare name
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, SCHEMA), "path").collect()}
    assert {i: got[i].own_licence for i in got} == {i: name for i, (_, name) in enumerate(HEADERS)}
    assert all(r.cosine is None or THRESHOLD <= r.cosine <= 1 for r in got.values())


def test_only_named_files_pass_their_licence_down(spark):
    rows = [(1, "Released under the MIT License.", "q/short.txt"), (2, LONG, "q/next.txt"), (3, LONG, "r/next.txt"), (4, "Licensed under CC BY 4.0.", "r/LICENSE.md")]
    got = {r.doc_id: (r.licence, r.inherited_from) for r in scan_licences(spark.createDataFrame(rows, SCHEMA), "path").collect()}
    assert got == {1: ("MIT", None), 2: (None, None), 3: ("CC-BY-4.0", "r"), 4: ("CC-BY-4.0", None)}


def test_copies_without_notice_inherit_in_the_query(spark, tmp_path):
    from wickline.llm.catalog import op5_licence_scan

    work, other = (" ".join(f"{mark}{i}" for i in range(100)) for mark in ("w", "v"))
    notice = "\nReleased under the MIT License."
    texts = [work + notice, work, work + " and a changed end", other, "w0 w1", None, "", work + notice, "w0 w1"]
    rows = [(i, text, "en", f"src{i}", None) for i, text in enumerate(texts)] + [(None, work, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from is not None) for r in op5_licence_scan(spark, str(tmp_path)).collect()}
    own, copy, none = ("MIT", "MIT", False), (None, "MIT", True), (None, None, False)
    assert got == {0: own, 1: copy, 2: copy, 3: none, 4: none, 5: none, 6: none, 7: own, 8: none, None: copy}
