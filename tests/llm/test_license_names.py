from cohortspark.llm import licenses

GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
NAMED = [
    (GNU.format("", "2"), ["GPL-2.0 (header)"]),
    (GNU.format("", "3"), ["GPL-3.0 (header)"]),
    (GNU.format("Lesser ", "2.1"), ["LGPL-2.1 (header)"]),
    (GNU.format("Lesser ", "3"), ["LGPL-3.0 (header)"]),
    (GNU.format("Affero ", "3"), ["AGPL-3.0 (header)"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed", ["MPL-2.0 (header)"]),
    ("made available under the terms of the Eclipse Public License 2.0 which is available at", ["EPL-2.0 (line)"]),
    ("Shared under CC BY-SA 4.0, see the site.", ["CC-BY-SA-4.0 (short line)"]),
    ("To the public domain by CC0 1.0 Universal.", ["CC0-1.0 (line)"]),
    ("This is the BSD 2-Clause License.", ["BSD-2-Clause (line)"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-2-Clause */", ["BSD-2-Clause (SPDX)", "GPL-2.0-only (SPDX)"]),
    ("# spdx-license-identifier: Zlib-acknowledgement and more\n# SPDX-License-Identifier: EUPL-1.2.\n", ["EUPL-1.2 (SPDX)", "Zlib-acknowledgement (SPDX)", "more (SPDX)"]),
    ("SPDX-License-Identifier: MIT the rest is prose", ["MIT (SPDX)"]),
    ("SPDX-License-Identifier:", []),
]


def test_notices_have_their_own_names(spark):
    rows = [(i, t) for i, (t, _) in enumerate(NAMED)]
    got = {r.doc_id: list(r.licenses) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {i: sorted(want) for i, (_, want) in enumerate(NAMED)}


def test_every_template_is_found_by_its_name(spark):
    rows = list(enumerate(licenses.TEMPLATES))
    docs = spark.createDataFrame([(i, f"some words before {licenses.TEMPLATES[n]} and some words after") for i, n in rows], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_report(docs).collect()}
    assert all(n in got[i] for i, n in rows)
