"""Suffix-array dedup with sparse suffix arrays.

Suffixes are retained only at minimiser positions: of each window of `size` words, the one whose first
`grain` words have the least fingerprint. Two equal windows retain the suffix at the same place, so no
repeat of `size` words is missed. The retained suffixes, about one in twenty, are sorted by content, dealt over
partitions; neighbours in that order that share their first words come from repeats. Matches are then
extended left and right: each window that owns a shared suffix, from the leftmost to the rightmost, is
compared whole, and the windows that hold are merged into maximal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import identified, merge_spans, repeated_windows, word_classes
from .words import Prefix, U, Words

#: Words at a suffix's start by which minimisers are chosen and suffixes first compared.
GRAIN = 10


def minimiser_suffixes(words: Words, size: int, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `size` words, the fingerprint of the retained suffix's first words."""
    first = words.windows(size)
    if not len(first):
        return first, np.zeros(0, U)
    starts = np.arange(len(words) - grain + 1)
    least = Prefix(words.hash).of(starts, starts + grain)
    span, reach = size - grain + 1, 1
    while 2 * reach <= span:  # minima over spans that double
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return first, np.minimum(least[first], least[first + span - reach])


def _spans(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, firsts, others in zip(batch.column("doc_id").to_pylist(), batch.column("firsts"), batch.column("others"), strict=True):
                at, other = firsts.values.to_numpy(), others.values.to_numpy()
                begin, end = merge_spans(at, size)
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], begin)
                for b, e, o in zip(begin, end, np.minimum.reduceat(other[order], cuts), strict=True):
                    rows.append((doc, int(b), int(e), int(e - b), int(o)))
            kinds = [("doc_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64()), ("other_id", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def repeated_spans(documents: DataFrame, size: int = 50) -> DataFrame:
    """Maximal spans made of windows of `size` words that another document has too.

    Takes (doc_id, text), ignores other columns. Words are all but ASCII white space, unchanged. Returns one row
    a span: doc_id, first_word and end_word (from 0, end not included), n_words, other_id (a document
    that has one of its windows; of several, the least of those that its windows were met in). Repeats inside one document only are not reported, so a repeated row with the same
    doc_id is none; two texts with one doc_id have their spans each. Null ids, null, empty and shorter texts give no rows; an empty table gives an empty result.
    """
    docs = identified(documents).repartition("doc_id")
    classes = word_classes(documents)
    found = repeated_windows(docs, classes, size, minimiser_suffixes, smaller=False)
    by_doc = found.groupBy("doc_id", "variant").agg(F.collect_list("first").alias("firsts"), F.collect_list("other_id").alias("others"))
    copied = F.col("least_id") < F.col("last_id")
    whole = classes.where(copied & (F.col("n_words") >= size)).dropDuplicates(["doc_id", "variant"])
    whole = whole.select("doc_id", "variant", F.lit(0).cast("long").alias("first_word"), F.col("n_words").alias("end_word"), "n_words", F.when(F.col("doc_id") > F.col("least_id"), F.col("least_id")).otherwise(F.col("last_id")).alias("other_id"))
    parts = by_doc.join(whole.select("doc_id", "variant"), ["doc_id", "variant"], "left_anti").mapInArrow(_spans(size), "doc_id long, first_word long, end_word long, n_words long, other_id long")
    return parts.union(whole.drop("variant"))
