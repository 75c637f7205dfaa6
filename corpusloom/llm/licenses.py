"""License scans by diagonal voting.

Rolling k-gram hashes of all words of all documents are joined with those of license templates. A gram at word p of a
document and word t of a template votes for the diagonal p - t; an unbroken copy puts all its votes on one diagonal,
and inserted or lost words move the rest to a neighbouring one. So votes are gathered by diagonal and neighbouring
diagonals merged where one goes on behind the other in the document and in the template alike; what they make up is
verified by how much of the template it covers and how densely. A phrase that stands many times has many diagonals, but
none that goes on behind another, so it neither hides nor joins a license beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Prefix, Words, cut, lists, signed, slices

#: Words of a gram, how far apart merged diagonals may be, and the least share of a template's grams in a span.
GRAM, GAP, COVER = 3, 3, 0.6

# Phrases of the base labels, and notices and grants as the licenses state them.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    first = words.windows(GRAM)
    return first, Prefix(words.hash).of(first, first + GRAM)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(cut(pa.array([p]), True, True).hash, label) for p, label in PHRASES]
    for batch in batches:
        for part in slices(batch, "text"):
            words = cut(part.column("text"), lower=True, signs=True)
            n = part.num_rows
            count, least, most = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for hashes, label in phrases:
                at = words.windows(len(hashes))
                for k, h in enumerate(hashes):
                    at = at[words.hash[at + k] == h]
                doc = words.doc[at]
                np.add.at(count, doc, 1)
                np.minimum.at(least, doc, at - words.offsets[doc])
                np.maximum.at(most, doc, at - words.offsets[doc])
                for d in np.unique(doc).tolist():
                    labels[d].add(label)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("print"), pa.array(words.lengths()), pa.array(count), pa.array(least, mask=none), pa.array(most, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))],
                ["doc_id", "print", "n_words", "n_base", "first_word", "last_word", "base"],
            )


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = cut(part.column("text"), lower=True, signs=True)
            first, gram = _grams(words)
            count = np.bincount(words.doc[first], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("print"), lists(signed(gram), count, pa.int64())], ["doc_id", "print", "grams"])


def template_grams(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, int, int, int]]:
    """(gram, template, position, grams of the template)."""
    rows = []
    for number, (_, text) in enumerate(templates):
        _, grams = _grams(cut(pa.array([text]), True, True))
        rows += [(int(g), number, t, len(grams)) for t, g in enumerate(signed(grams))]
    return rows


def runs_of(votes: list[tuple[int, list[int]]]) -> np.ndarray:
    """Unbroken runs (first p, first t, grams) on the diagonals of (diagonal, places p), by p."""
    p = np.concatenate([np.sort(np.asarray(places, np.int64)) for _, places in votes])
    t = p - np.repeat([d for d, _ in votes], [len(places) for _, places in votes])
    new = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(t) != 1)))
    runs = np.stack([p[new], t[new], np.diff(np.append(new, len(p)))], 1)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def chains(votes: list[tuple[int, list[int]]], total: int) -> list[tuple[int, int, int]]:
    """(first p, last p, grams) of the spans that cover a template of `total` grams enough, best first, none sharing a run.

    A run goes on behind another one that begins and ends before it in both document and template, on the same diagonal or
    one at most GAP beside; grams that both have count once. So a span is no longer than the template and the words put in. Of all ways to go on, the one with
    most grams is taken, then the one that begins last.
    """
    runs = runs_of(votes)
    p, t, n = runs.T
    best, back = n.copy(), np.full(len(runs), -1)
    begin = p.copy()
    for i in np.flatnonzero(t > 0):
        low = np.searchsorted(p, p[i] - t[i] - GAP)  # nothing further back is on a neighbouring diagonal at an earlier t
        j = np.arange(low, i)
        shift = (p[j] - t[j]) - (p[i] - t[i])
        twice = np.maximum(0, np.maximum(t[j] + n[j] - t[i], p[j] + n[j] - p[i]))  # grams at the seam that both have
        fits = (np.abs(shift) <= GAP) & (t[j] < t[i]) & (p[j] < p[i]) & (twice < np.minimum(n[j], n[i]))
        j, twice = j[fits], twice[fits]
        if len(j):
            sums = best[j] - twice
            m = np.lexsort((begin[j], sums))[-1]
            if sums[m] > 0:
                best[i], back[i], begin[i] = sums[m] + n[i], j[m], begin[j[m]]
    last = p + n - 1
    good = np.flatnonzero((best >= COVER * total) & (best >= 0.5 * (last - begin + 1)))
    found, used = [], np.zeros(len(runs), bool)
    for i in good[np.lexsort((last[good], -best[good]))]:
        path, k = [], i
        while k >= 0:
            path.append(k)
            k = back[k]
        if not used[path].any():
            used[path] = True
            found.append((int(begin[i]), int(last[i]), int(best[i])))
    return found


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            votes = [(x["diagonal"], x["ps"]) for x in sorted(r["lines"], key=lambda x: x["diagonal"])]
            rows += [(r["doc_id"], r["print"], r["template"], first, last + GRAM, n / r["total"]) for first, last, n in chains(votes, r["total"])]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "print", "template", "first_word", "end_word", "cover"])


def _told_apart(documents: DataFrame) -> DataFrame:
    """doc_id, text and print, which tells the texts of one id apart."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("print"))


def license_spans(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, print, label, first_word, end_word, cover): verified spans of template text in (doc_id, text) rows.

    print is the text's digest: texts of one id, null ids too, have their own spans, and exactly repeated rows have them
    once. Spans of one template share no words of it; those of several templates may lie on the same words.
    """
    spark = documents.sparkSession
    known = spark.createDataFrame(template_grams(templates), "gram long, template int, t int, total int")  # as many rows as the templates have words
    rolled = _told_apart(documents).mapInArrow(_rolling, "doc_id long, print string, grams array<long>").select("doc_id", "print", F.posexplode("grams").alias("p", "gram"))
    votes = rolled.join(F.broadcast(known), "gram")
    lines = votes.groupBy("doc_id", "print", "template", "total", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("p").alias("ps"))
    gathered = lines.groupBy("doc_id", "print", "template", "total").agg(F.collect_list(F.struct("diagonal", "ps")).alias("lines"), F.sum(F.size("ps")).alias("n"))
    found = gathered.where(F.col("n") >= COVER * F.col("total")).drop("n").mapInArrow(_chained, "doc_id long, print string, template int, first_word long, end_word long, cover double")
    names = F.create_map(*[x for i, (label, _) in enumerate(templates) for x in (F.lit(i), F.lit(label))])
    return found.select("doc_id", "print", names[F.col("template")].alias("label"), "first_word", "end_word", "cover")


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of (doc_id, text) rows.

    Words are letters, digits and non-ASCII, with A-Z lower-cased. Base labels come from PHRASES, further ones from
    verified template spans. score: the best span's cover, at least 0.5 where a base phrase stands, else 0. A null
    text has no words; each row is judged by its own text, whatever its doc_id; spans of equal cover don't compete, as
    all their labels count. Other columns are ignored, and an empty table gives an empty result.
    """
    base = _told_apart(documents).mapInArrow(_base, "doc_id long, print string, n_words long, n_base long, first_word long, last_word long, base array<string>")
    found = license_spans(documents).groupBy("doc_id", "print").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover")).withColumnsRenamed({"doc_id": "of", "print": "own"})
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("own")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
