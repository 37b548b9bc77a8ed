"""License notices in texts: MinHash bands over overlapping windows retrieve templates, containment verifies."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import textops as T

SHINGLE = 5
CONTAINED = 0.8
#: Chance that a notice's window shares no band with its template, at the least overlap that verifies.
MISS = 1e-4

# Notices of common licenses, by SPDX name where there is one. Where licenses differ in a word or a version
# only, a notice is so short that the other's text holds less than CONTAINED of its shingles.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT (line)": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause or BSD-3-Clause (conditions)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or",
    "GPL-2.0 (header)": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or",
    "GPL-2.0 (only header)": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "GPL-3.0 (only header)": "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "LGPL-2.1 (header)": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or",
    "LGPL-3.0 (header)": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or",
    "LGPL-2.0 (header)": "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or",
    "AGPL-3.0 (header)": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or",
    "GPL-2.0 (line)": "GNU General Public License, version 2",
    "GPL-2.0 (v line)": "GNU General Public License v2",
    "GPL-3.0 (v line)": "GNU General Public License v3",
    "LGPL-2.1 (line)": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0 (line)": "GNU Lesser General Public License, version 3",
    "LGPL-2.1 (v line)": "GNU Lesser General Public License v2.1",
    "LGPL-3.0 (v line)": "GNU Lesser General Public License v3",
    "AGPL-3.0 (line)": "GNU Affero General Public License, version 3",
    "AGPL-3.0 (v line)": "GNU Affero General Public License v3",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-1.1 (header)": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "MPL-2.0 (line)": "Mozilla Public License, version 2.0",
    "MPL-2.0 (short line)": "Mozilla Public License 2.0",
    "EPL-2.0 (line)": "Eclipse Public License 2.0",
    "EPL-2.0 (version line)": "Eclipse Public License, version 2.0",
    "EPL-2.0 (v line)": "Eclipse Public License v2.0",
    "EPL-2.0 (v. line)": "Eclipse Public License - v 2.0",
    "EPL-1.0 (v. line)": "Eclipse Public License - v 1.0",
    "MPL-2.0 (v line)": "Mozilla Public License v2.0",
    "Apache-2.0 (short line)": "Apache License 2.0",
    "GPL-2.0 (short line)": "GNU GPL v2",
    "GPL-3.0 (short line)": "GNU GPL v3",
    "LGPL-2.1 (short line)": "GNU LGPL v2.1",
    "LGPL-3.0 (short line)": "GNU LGPL v3",
    "AGPL-3.0 (short line)": "GNU AGPL v3",
    "EPL-1.0 (line)": "Eclipse Public License 1.0",
    "EPL-1.0 (v line)": "Eclipse Public License v1.0",
    "BSD-2-Clause (line)": "BSD 2-Clause License",
    "BSD-2-Clause (simplified line)": "Simplified BSD License",
    "BSD-3-Clause (line)": "BSD 3-Clause License",
    "BSD (disclaimer)": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC (line)": "under the ISC License",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0 (line)": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "CC0-1.0 (line)": "CC0 1.0 Universal",
    "CC0-1.0 (short line)": "Licensed under CC0",
    "CC-BY-SA-4.0 (line)": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-SA-3.0 (line)": "Creative Commons Attribution-ShareAlike 3.0",
    "CC-BY-SA-4.0 (short line)": "CC BY-SA 4.0",
    "CC-BY-SA-3.0 (short line)": "CC BY-SA 3.0",
    "CC-BY-4.0 (short line)": "CC BY 4.0",
    "CC-BY-3.0 (short line)": "CC BY 3.0",
    "CC-BY-ND-4.0 (short line)": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0 (short line)": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0 (short line)": "CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0 (line)": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0",
    "CC-BY-NC-ND-4.0 (line)": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0",
    "CC-BY-ND-4.0 (line)": "Creative Commons Attribution-NoDerivatives 4.0",
    "CC-BY-NC-4.0 (name)": "Creative Commons Attribution-NonCommercial 4.0",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all rights reserved": "All rights reserved.",
}


#: The tag of a file, with the expression after it up to the end of the line.
_TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-() \t]+)", re.IGNORECASE)
_JOIN = ("AND", "OR", "WITH")
_ID = re.compile(rb"[A-Za-z0-9][A-Za-z0-9.+\-]*")


def tags(data: bytes, off: np.ndarray) -> list[tuple[int, str, int, int, float]]:
    """(text, "id (SPDX)", first byte, last byte, 1.0) of every identifier in an SPDX tag, whatever it names."""
    out: list[tuple[int, str, int, int, float]] = []
    for t, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        for m in _TAG.finditer(data, i, j):
            last = "OR"
            for x in _ID.finditer(data, m.start(1), m.end(1)):
                word = x.group().decode().rstrip(".")
                if (word.upper() in _JOIN) == (last in _JOIN):
                    break  # words after the expression
                if word.upper() not in _JOIN and last != "WITH":
                    out.append((t, f"{word} (SPDX)", x.start() - i, x.start() - i + len(word), 1.0))
                last = word.upper()
    return out


def bands_for(jaccard: float, miss: float = MISS, rows: int = 1) -> int:
    """Bands of ``rows`` minima so that sets of this Jaccard share one with a probability of at least 1 - ``miss``."""
    return ceil(log(miss) / log(1 - jaccard**rows))


def _first(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


class _Class:
    """Templates of like size: shingles of k words, at most ``stride`` of them; windows are twice and four times as long."""

    def __init__(self, k: int, stride: int, members: list[tuple[str, np.ndarray]]):
        self.k, self.stride = k, stride
        self.names = [m[0] for m in members]
        self.sets = [np.unique(m[1]) for m in members]
        least = min(len(s) for s in self.sets)
        need = ceil(CONTAINED * least)
        self.count = bands_for(need / (4 * stride + least - need))
        self.seeds = T.seeds(self.count, 31 * stride + k)
        minima = np.array([[self.hash(s, i).min() for i in range(self.count)] for s in self.sets])
        # the band index: for each band its keys in order, and the templates that have them
        self.order = np.argsort(minima, axis=0, kind="stable")
        self.keys = np.take_along_axis(minima, self.order, axis=0)
        self.known = np.unique(np.concatenate(self.sets))

    def hash(self, h: np.ndarray, i: int) -> np.ndarray:
        return (h ^ self.seeds[i]) * (self.seeds[i] | T.U(1)) >> T.U(16)

    def windows(self, first: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first shingle, end, text) of the windows of both lengths, half overlapping, with a shingle that some template has."""
        out = []
        for half in (self.stride, 2 * self.stride):
            many = np.diff(first)
            blocks = np.maximum(-(-many // half), (many > 0).astype(np.int64))
            owner = np.repeat(np.arange(len(many)), blocks)
            base = np.concatenate([[0], np.cumsum(blocks)])
            start = first[owner] + (np.arange(len(owner)) - base[owner]) * half
            stop = np.minimum(start + 2 * half, first[owner + 1])
            use = np.searchsorted(hits, stop) > np.searchsorted(hits, start)
            out.append((start[use], stop[use], owner[use]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def candidates(self, h: np.ndarray, first: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window's first shingle, end, text, template) of windows that share a band with a template.

        A window without a single shingle of the templates can share none, so minima are taken of the others only.
        """
        start, stop, owner = self.windows(first, hits)
        if not len(start):
            z = np.zeros(0, np.int64)
            return z, z, z, z
        size = stop - start
        at = np.concatenate([[0], np.cumsum(size)])
        x = h[np.arange(at[-1]) - np.repeat(at[:-1] - start, size)]
        hit = np.zeros((len(start), len(self.sets)), bool)
        for i in range(self.count):
            least = np.minimum.reduceat(self.hash(x, i), at[:-1])
            left, right = (np.searchsorted(self.keys[:, i], least, side) for side in ("left", "right"))
            for w in np.flatnonzero(right > left):
                hit[w, self.order[left[w] : right[w], i]] = True
        w, t = np.nonzero(hit)
        return start[w], stop[w], owner[w], t


def compile_templates(templates: Mapping[str, str]) -> list[_Class]:
    """Classes of templates; a template of fewer than ``SHINGLE`` words is one shingle of them all."""
    grouped: dict[tuple[int, int], list] = defaultdict(list)
    for name, notice in templates.items():
        w = T.words(*T.strings(pa.array([notice], pa.large_string())), T.ALNUM)
        k = min(SHINGLE, len(w.hash))
        if not k:
            continue
        h, _ = T.shingles(w, k)
        grouped[k, 1 << int(np.ceil(np.log2(max(len(np.unique(h)), 4))))].append((name, h))
    return [_Class(k, stride, members) for (k, stride), members in sorted(grouped.items())]


def scan_piece(raw: np.ndarray, off: np.ndarray, classes: list[_Class]) -> list[tuple[int, str, int, int, float]]:
    """(text, template, first byte, last byte, containment) of every notice; overlapping windows' finds are one."""
    n = len(off) - 1
    w = T.words(raw, off, T.ALNUM)
    by_k: dict[int, tuple] = {}
    out = []
    for c in classes:
        if c.k not in by_k:
            h, text = T.shingles(w, c.k)
            at = T.shingle_starts(w, c.k)
            full = np.diff(w.first)[text] >= c.k
            h, text, at = h[full], text[full], at[full]
            known = np.unique(np.concatenate([x.known for x in classes if x.k == c.k]))
            by_k[c.k] = h, _first(h, text, n), at, np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
        h, first, at, some = by_k[c.k]
        hits = some[np.isin(h[some], c.known)]
        if not len(hits):
            continue
        found: dict[tuple[int, int], list] = defaultdict(list)
        for s, e, t, m in zip(*c.candidates(h, first, hits)):
            here = np.flatnonzero(np.isin(h[s:e], c.sets[m])) + s
            share = len(np.unique(h[here])) / len(c.sets[m])
            if share >= CONTAINED:
                found[int(t), int(m)].append((int(w.start[at[here[0]]]), int(w.end[at[here[-1]] + c.k - 1]), share))
        for (t, m), spans in found.items():
            merged: list[list] = []
            for a, b, share in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                    merged[-1][2] = max(merged[-1][2], share)
                else:
                    merged.append([a, b, share])
            out += [(t, c.names[m], int(a - off[t]), int(b - off[t]), share) for a, b, share in merged]
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, matches) of every row of ``docs`` (doc_id, text); matches are (license, start, stop, containment).

    Each text is cut into half-overlapping windows, for every class of templates twice and four times as long as its
    longest: a notice as it is lies in one of the first, one that is stretched to twice its class's length by words set
    into it in one of the second. Windows that share a MinHash band with a template (missed with a
    probability of at most ``MISS``) are verified: a match contains at least 0.8 of the template's distinct five-word
    shingles (a shorter template is one shingle). Words are letters and digits, A-Z lower-cased. start and stop are
    byte offsets of the first and last shared shingle; identifiers in SPDX tags are matches too, of any license; nearby repeats in one
    window are one match. Null and empty texts have none, texts of any length are read whole, rows may repeat ids, an
    empty table gives no rows. Extra columns are ignored. No shuffle, no state: a lost task is simply run again.
    """
    classes = compile_templates(templates)
    match = pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, off in T.pieces(batch.column("text")):
                n = len(off) - 1
                found: list = [[] for _ in range(n)]
                data = raw.tobytes()
                marked = tags(data, off) if b"SPDX-LICENSE-IDENTIFIER" in data.upper() else []
                for t, name, start, stop, share in scan_piece(raw, off, classes) + marked:
                    found[t].append({"license": name, "start": start, "stop": stop, "containment": share})
                for f in found:
                    f.sort(key=lambda m: (m["start"], m["license"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.array(found, pa.list_(match))], names=["doc_id", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, matches array<struct<license:string,start:bigint,stop:bigint,containment:double>>")


def license_report(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, licenses, n_matches, containment, matches): distinct notices by name, their number, the best share."""
    found = scan(docs, templates)
    return found.select(
        "doc_id",
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))).alias("licenses"),
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
        "matches",
    )
