"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread
from .decontaminate import spans, words
from .near_duplicates import SHINGLE, runs

# Notices, opening passages and, where they are short, whole texts of common licenses.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause-terms": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-terms": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC-terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-terms": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}
#: Least share of a template's shingles that a window must hold, and the chance of missing one that holds just that.
CONTAINMENT, MISS = 0.8, 1e-6
#: Most bytes of templates that each task may hold.
TEMPLATE_BYTES = 32 << 20


class Class(NamedTuple):
    """Templates of over ``block`` / 2 and up to ``block`` shingles, met in windows of two adjacent blocks."""

    block: int
    names: list[str]
    sets: list[np.ndarray]
    values: np.ndarray  # MinHash values by template and hash function
    sorted: np.ndarray  # by hash function, the templates' values in ascending order
    owner: np.ndarray  # by hash function, whose values these are


def hashing(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` hash functions, as multipliers and offsets."""
    drawn = np.random.default_rng(19970401).integers(0, 1 << 32, (n, 2), dtype=np.uint64).astype(np.uint32)
    return drawn[:, 0] | np.uint32(1), drawn[:, 1]


def bands_for(block: int, containment: float, miss: float) -> int:
    """How many bands of one value make a template's retrieval fail with probability ``miss`` at most.

    A window of 2 * block shingles that holds ``containment`` of a template of more than block / 2 has at least
    the Jaccard similarity j below with it, and misses it in each band with probability 1 - j.
    """
    n = block // 2 + 1
    j = containment * n / (2 * block + (1 - containment) * n)
    return ceil(log(miss) / log(1 - j))


def classes_of(templates: dict[str, str], containment: float, miss: float) -> list[Class]:
    by_block: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in sorted(templates.items()):
        w = words(text)
        if len(w) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        x = np.unique(runs(w))
        by_block.setdefault(1 << max(0, len(x) - 1).bit_length(), []).append((name, x))
    out = []
    for block, own in sorted(by_block.items()):
        a, b = hashing(bands_for(block, containment, miss))
        values = np.array([(a[:, None] * (x >> np.uint64(32)).astype(np.uint32)[None, :] + b[:, None]).min(axis=1) for _, x in own])
        owner = np.argsort(values.T, axis=1, kind="stable")
        out.append(Class(block, [n for n, _ in own], [x for _, x in own], values, np.take_along_axis(values.T, owner, axis=1), owner))
    return out


def candidates(low: np.ndarray, pad: np.ndarray, classes: list[Class]) -> list[list[tuple[int, np.ndarray]]]:
    """By class: (template, windows in which one of its bands collides). ``low``: padded shingle hashes, in whole blocks.

    Windows are looked up in each band's sorted values, so work hardly grows with the number of templates.
    """
    found: list[list[np.ndarray]] = [[] for _ in classes]
    most = max(c.values.shape[1] for c in classes)
    a, b = hashing(most)
    for k in range(most):
        least = low * a[k] + b[k]
        least[pad] = 0xFFFFFFFF
        size = 1
        for c, own in zip(classes, found, strict=True):
            while size < c.block:
                least = np.minimum(least[::2], least[1::2])
                size *= 2
            if k >= c.values.shape[1]:
                continue
            band = c.sorted[k]
            from_ = np.searchsorted(band, least, side="left")
            at = np.flatnonzero((from_ < len(band)) & (band[np.minimum(from_, len(band) - 1)] == least))
            if not len(at):
                continue
            # A value that is a window's least stands in one of its blocks; the other's must not be less.
            first = np.concatenate([at, at[at > 0] - 1])
            at = np.concatenate([at, at[at > 0]])
            held = np.minimum(least[first], least[np.minimum(first + 1, len(least) - 1)]) == least[at]
            first, at = first[held], at[held]
            n = np.searchsorted(band, least[at], side="right") - from_[at]
            place = np.repeat(from_[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own.append(c.owner[k][place] * (len(low) + 1) + np.repeat(first, n))
    out = []
    for own in found:
        pairs = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.int64)
        template = pairs // (len(low) + 1)
        out.append([(int(t), pairs[template == t] % (len(low) + 1)) for t in np.unique(template)])
    return out


def scan(parsed: list[list[bytes]], classes: list[Class], containment: float) -> list[list[tuple[str, int, int, float]]]:
    """Per text: (template, first word, end word, containment) of each verified window's matching stretch, merged."""
    top = classes[-1].block
    hashes = [runs(w) if len(w) >= SHINGLE else np.zeros(0, dtype=np.uint64) for w in parsed]
    sizes = np.array([-(-len(x) // top) * top for x in hashes], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in parsed]
    if not starts[-1]:
        return found
    flat, pad = np.zeros(starts[-1], dtype=np.uint64), np.ones(starts[-1], dtype=bool)
    for s, x in zip(starts, hashes, strict=False):
        flat[s : s + len(x)], pad[s : s + len(x)] = x, False
    for c, own in zip(classes, candidates((flat >> np.uint64(32)).astype(np.uint32), pad, classes), strict=True):
        for t, windows in own:
            for w in windows:
                d = int(np.searchsorted(starts, w * c.block, side="right")) - 1
                first = w * c.block - starts[d]
                window = hashes[d][first : first + 2 * c.block]
                at = np.flatnonzero(np.isin(window, c.sets[t]))
                share = len(np.unique(window[at])) / len(c.sets[t])
                if share >= containment - 1e-9:
                    found[d].append((c.names[t], int(first + at[0]), int(first + at[-1]) + SHINGLE, share))
    return [merged(f) for f in found]


def merged(matches: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    out: list[tuple[str, int, int, float]] = []
    for name, a, b, share in sorted(matches):
        if out and out[-1][0] == name and a <= out[-1][2]:
            out[-1] = (name, out[-1][1], max(b, out[-1][2]), max(share, out[-1][3]))
        else:
            out.append((name, a, b, share))
    return out


def template_table(templates: DataFrame) -> dict[str, str]:
    """Texts by name of a table ``license, text`` (null names or texts are passed over; of equal names the least text counts), of bounded size."""
    own = templates.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).filter("license is not null and text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {TEMPLATE_BYTES} are supported")
    return {r["license"]: r["text"] for r in own.groupBy("license").agg(F.min("text").alias("text")).collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """Per document: its id and ``matches``: array of (license, start, end, containment), with character offsets.

    ``templates`` is a table ``license, text`` (or a dict) of up to ``TEMPLATE_BYTES``. They are classed by their number of five-word shingles. Documents are cut into blocks of a class's size, and
    two adjacent blocks form a window, so windows overlap by half and any stretch of a template's length lies in one.
    Each window's MinHash values are compared band by band with those of the class's templates; ``bands_for`` sets
    their number so that a template held to ``containment`` is missed with probability ``miss`` at most. A retrieved
    template is verified by the exact share of its shingles that the window holds.

    Defined cases: null, empty and shorter texts than five words have no match; repeated rows are scanned each; a
    license that occurs several times is reported at each place; an empty table gives an empty result; without
    templates nothing matches; templates of under five words are an error.
    """
    if isinstance(templates, DataFrame):
        templates = template_table(templates)
    classes = classes_of(TEMPLATES if templates is None else templates, containment, miss)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    match = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = batch.column("__text").to_pylist()
                found = scan([words(t) for t in texts], classes, containment) if classes else [[] for _ in texts]
                rows = []
                for text, own in zip(texts, found, strict=True):
                    places = spans(text, [(a, b) for _, a, b, _ in own]) if own else []
                    rows.append([{"license": n, "start": s, "end": e, "containment": share} for (n, _, _, share), (s, e) in zip(own, places, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(rows, arrow)], names=["__id", "matches"])

    return spread(source).mapInArrow(run, T.StructType([source.schema["__id"], T.StructField("matches", T.ArrayType(match))])).withColumnRenamed("__id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_licenses, licenses`` (sorted, comma-joined)."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return scan_licenses(docs).select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def _rows() -> str:
    out = []
    for c in classes_of(TEMPLATES, CONTAINMENT, MISS):
        for name, own in zip(c.names, c.sets, strict=True):
            w = [x.decode() for x in words(TEMPLATES[name])]
            out += [f"('{name}', {c.block}, {len(own)}, '{g}')" for g in sorted({' '.join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})]
    return ", ".join(out)


SQL = rf"""
WITH t(license, block, n, g) AS (VALUES {_rows()}),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(0, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
s AS (SELECT r, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM p),
h AS (SELECT r, license, n, g, unnest([i // block, i // block - 1]) AS k FROM s JOIN t USING (g)),
m AS (SELECT r, license FROM h GROUP BY r, license, n, k HAVING count(DISTINCT g) >= 0.8 * n - 1e-9),
l AS (SELECT r, count(DISTINCT license) AS n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY r)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM w LEFT JOIN l USING (r)
"""
