"""Licence scans: passages of documents against licence templates by the Dice coefficient over word bigrams.

A passage is a line with a word, or a paragraph: a run of two or more such lines. Dice is twice the bigrams in common,
counted with their numbers, over the bigrams of both. Two bounds prune before anything is compared: a coefficient of t
needs a number of bigrams between t / (2 - t) and (2 - t) / t times the template's, and enough of the passage's bigrams
must occur in a template at all, which one lookup for all words of a slice decides. What is left is compared with
the templates of fitting size.

A notice within a longer line, or over lines that are no paragraph, is found by its span: from a bigram of the template
to the last one within the template's length. An index from bigrams to templates gives their places; a span needs at least
t / (2 - t) of the template's number. The best span of a template in a document counts where no passage comes as near.
Templates are a small fixed table; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.words import attach, mix, ragged, runs, words

LEAST = 0.8

#: Fixed texts: passages of public licences and usual notices, by licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

FOUND = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("dice", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mix(mix(h[:-1]) + h[1:])


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least, self.names = least, [n for n, _ in templates]
        self.counts: list[Counter] = [Counter(_bigrams(w.hashes()).tolist()) for _, t in templates for w in words(pa.array([t]))]
        self.sizes = np.array([c.total() for c in self.counts])
        pairs = sorted((g, t) for t, c in enumerate(self.counts) for g in c)
        self.known, first = np.unique(np.array([g for g, _ in pairs], np.uint64), return_index=True)
        self.first, self.of = np.append(first, len(pairs)), np.array([t for _, t in pairs], np.int64)

    def best(self, bigrams: np.ndarray) -> list[tuple[int, float]]:
        """(template, Dice) of the templates that the bigrams of a passage come near to."""
        n, mine, out = len(bigrams), None, []
        low = self.least / (2 - self.least)
        for k in np.flatnonzero((self.sizes >= n * low) & (n >= self.sizes * low)):
            mine = mine if mine is not None else Counter(bigrams.tolist())
            dice = 2 * (mine & self.counts[k]).total() / (n + int(self.sizes[k]))
            if dice >= self.least:
                out.append((int(k), dice))
        return out

    def spans(self, g: np.ndarray, place: np.ndarray, near: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(document, template, Dice, first and last bigram) of the best span of each template in each document, the first
        of equals; place: known bigrams of g, near: which ones, doc: their documents."""
        n = self.first[near + 1] - self.first[near]
        t, at, d = self.of[ragged(self.first[near], n)], np.repeat(place, n), np.repeat(doc, n)
        order = np.lexsort((at, t))
        t, at, d = t[order], at[order], d[order]
        out: dict[tuple[int, int], tuple[float, int, int]] = {}
        for one in np.unique(t).tolist():
            lo, hi = np.searchsorted(t, [one, one + 1])
            q, own, size = at[lo:hi], d[lo:hi], int(self.sizes[one])
            need = max(1, math.ceil(size * self.least / (2 - self.least) - 1e-9))
            begin = np.arange(max(0, len(q) - need + 1))
            begin = begin[(q[begin + need - 1] - q[begin] < size) & (own[begin + need - 1] == own[begin])]
            stop = np.minimum(np.searchsorted(q, q[begin] + size), np.searchsorted(own, own[begin], "right"))
            for i, j in zip(begin.tolist(), stop.tolist(), strict=True):
                key, both = (int(own[i]), one), int(q[j - 1] - q[i]) + 1 + size
                before = out[key][0] if key in out else 0.0
                if 2 * (j - i) / both <= before:
                    continue
                dice = 2 * (Counter(g[q[i:j]].tolist()) & self.counts[one]).total() / both
                if dice >= self.least and dice > before:
                    out[key] = dice, int(q[i]), int(q[j - 1])
        return [(*k, *v) for k, v in out.items()]

    def scan(self, text: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = []
        for w in words(text):
            h = w.hashes()
            base, found = len(out), [[] for _ in w.rows]
            out += found
            if w.n < 2:
                continue
            g = _bigrams(h)
            near = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
            is_known = self.known[near] == g
            hit = np.concatenate([[0], np.cumsum(is_known)])
            offsets = _edges(text, w)
            start, end = runs(w.data != 10, offsets)
            first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
            some = last > first
            start, end, first, last = start[some], end[some], first[some], last[some]
            doc = np.searchsorted(w.first, first, "right") - 1
            # lines that follow each other without a blank one
            joined = np.zeros(len(start), bool)
            joined[1:] = (start[1:] == end[:-1] + 1) & (doc[1:] == doc[:-1])
            heads = np.flatnonzero(~joined)
            tails = np.append(heads[1:], len(start)) - 1
            many = tails > heads
            a, b, d = np.concatenate([first, first[heads[many]]]), np.concatenate([last, last[tails[many]]]), np.concatenate([doc, doc[heads[many]]])
            n = b - a - 1
            enough = (n > 0) & (2 * (hit[np.maximum(b - 1, a)] - hit[a]) >= self.least * (n + self.sizes.min()))
            for k in np.flatnonzero(enough):
                for t, dice in self.best(g[a[k] : b[k] - 1]):
                    at = int(w.first[d[k]])
                    found[d[k]].append({"licence": self.names[t], "template": t, "dice": dice, "start": int(a[k]) - at, "end": int(b[k]) - at})
            inside = is_known.copy()
            inside[w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < w.n)] - 1] = False  # from one document to the next
            place = np.flatnonzero(inside)
            for d, t, dice, i, j in self.spans(g, place, near[place], np.searchsorted(w.first, place, "right") - 1):
                if dice > max((x["dice"] for x in found[d] if x["template"] == t), default=0.0):
                    at = int(w.first[d])
                    found[d].append({"licence": self.names[t], "template": t, "dice": dice, "start": i - at, "end": j + 2 - at})
            for k in range(base, len(out)):
                out[k].sort(key=lambda x: (x["start"], x["end"], x["template"]))
        return out


def _edges(text: pa.Array, w) -> np.ndarray:
    """Byte offsets of the documents of a slice."""
    n = np.asarray(pa.compute.binary_length(text.slice(w.rows.start, len(w.rows))).fill_null(0))
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def scan_licences(docs: DataFrame, *, text: str = "text", out: str = "licences", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """docs with an array ``out`` of (licence, template, dice, start, end) in order of place: the passages that come to a
    Dice coefficient of ``least`` or more with a template, and the best span of a template where it comes nearer than all
    passages; start and end count words, the end exclusive.

    Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty texts and passages of one word match
    nothing. A passage that is near several templates is listed for each. Rows are scanned one by one, repeated rows
    alike. A column of docs named ``out`` is replaced.
    """
    held: list[Scanner] = []
    kind = pa.list_(pa.struct([("licence", pa.string()), ("template", pa.int32()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def one(b: pa.RecordBatch) -> pa.Array:
        if not held:
            held.append(Scanner(templates, least))
        return pa.array(held[0].scan(b.column(b.schema.names.index(text))), kind)

    return attach(docs, out, FOUND, one)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"])))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licences"), F.round(F.array_max(F.transform("licences", lambda x: x["dice"])), 6).alias("best_dice"))


def _sql() -> str:
    rows = ", ".join(f"({k}, '{n}', '" + t.replace("'", "''") + "')" for k, (n, t) in enumerate(TEMPLATES))
    word = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH tpl AS (SELECT t, licence, {word.format("body")} AS w FROM (VALUES {rows}) v(t, licence, body)),
tbi AS (SELECT t, g, count(*) AS c FROM (SELECT t, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tpl) x GROUP BY t, g),
tn AS (SELECT t, licence, len(w) - 1 AS n FROM tpl),
line AS (
  SELECT doc_id, pos, {word.format("line")} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) x),
par AS (SELECT *, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM line),
passage AS (
  SELECT doc_id, pos, 0 AS kind, w FROM line WHERE len(w) > 1
  UNION ALL
  SELECT doc_id, min(pos), 1, flatten(list(w ORDER BY pos)) FROM par WHERE len(w) > 0 GROUP BY doc_id, grp HAVING count(*) > 1),
big AS (SELECT doc_id, pos, kind, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM passage),
cnt AS (SELECT doc_id, pos, kind, n, g, count(*) AS c FROM big GROUP BY doc_id, pos, kind, n, g),
meet AS (SELECT doc_id, pos, kind, cnt.n, t, sum(least(cnt.c, tbi.c)) AS m FROM cnt JOIN tbi USING (g) GROUP BY doc_id, pos, kind, cnt.n, t),
hit AS (SELECT doc_id, t, licence, 2 * m / CAST(meet.n + tn.n AS DOUBLE) AS dice FROM meet JOIN tn USING (t) WHERE 2 * m / CAST(meet.n + tn.n AS DOUBLE) >= 0.8e0),
place AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, {word.format("text")} AS w FROM documents) x) y),
spot AS (SELECT doc_id, t, i, g, c, tn.n FROM place JOIN tbi USING (g) JOIN tn USING (t)),
win AS (SELECT a.doc_id, a.t, a.i AS p, a.n, b.g, b.c, count(*) AS k, max(b.i) AS last FROM spot a JOIN spot b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i BETWEEN a.i AND a.i + a.n - 1 GROUP BY a.doc_id, a.t, a.i, a.n, b.g, b.c),
span AS (SELECT doc_id, t, max(dice) AS dice FROM (SELECT doc_id, t, p, 2 * sum(least(k, c)) / CAST(max(last) - p + 1 + n AS DOUBLE) AS dice FROM win GROUP BY doc_id, t, p, n) z GROUP BY doc_id, t),
more AS (SELECT s.doc_id, tn.licence, s.dice FROM span s JOIN tn USING (t) LEFT JOIN (SELECT doc_id, t, max(dice) AS dice FROM hit GROUP BY doc_id, t) h USING (doc_id, t) WHERE s.dice >= 0.8e0 AND s.dice > coalesce(h.dice, 0)),
agg AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(dice) AS best FROM (SELECT doc_id, licence, dice FROM hit UNION ALL SELECT doc_id, licence, dice FROM more) u GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences, round(best, 6) AS best_dice FROM documents d LEFT JOIN agg USING (doc_id)
"""


SQL = _sql()
