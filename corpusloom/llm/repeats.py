"""Exact word windows that stand in more than one document, found through shared anchors.

Shuffling every window of a corpus costs several times its size. Instead each window gets one anchor:
a fingerprint chosen by the window's own words alone, so equal windows get equal anchors, and
neighbouring windows mostly share theirs. Three steps follow.

1. *Reveal*: (anchor, document) pairs are hash-partitioned and sorted by anchor; comparing neighbours in
   that order keeps the anchors that stand in two documents or more. The sorted rows are streamed, so an
   anchor that a third of all documents hold needs no more memory than any other.
2. *Verify*: each document reads its revealed anchors, and only windows with such an anchor are
   fingerprinted whole (96 bits over 64-bit word fingerprints).
3. Sorted by fingerprint, equal windows are neighbours again; the first document of a run is its smallest.

No window is dropped, capped or sampled: one whose words choose no better anchor is its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage
from .words import Prefix, U, Words, cut, mix, signed, slices, unsigned

#: Gets words and a window length; returns the first word and the anchor of every window.
Chooser = Callable[[Words, int], tuple[np.ndarray, np.ndarray]]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def _anchors(choose: Chooser, size: int, lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = cut(part.column("text"), lower, signs=False)
                first, key = choose(words, size)
                doc = words.doc[first]
                new = np.ones(len(first), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[new])), pa.array(_ids(part)[doc[new]])], ["key", "doc_id"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, doc_id): those whose neighbour has the same key and another document."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), False)  # the last row and whether it is known as shared
    for batch in batches:
        key = np.concatenate([held[0], batch.column("key").to_numpy()])
        doc = np.concatenate([held[1], batch.column("doc_id").to_numpy()])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        if not len(key):
            continue
        as_next = np.zeros(len(key), bool)
        as_next[:-1] = key[1:] == key[:-1]
        shared = as_next.copy()
        shared[1:] |= as_next[:-1]
        shared[0] |= held[2]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][shared[:-1]]), pa.array(doc[:-1][shared[:-1]])], ["key", "doc_id"])
        held = (key[-1:], doc[-1:], bool(shared[-1]))
    if held[2]:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["key", "doc_id"])


def _windows(choose: Chooser, size: int, lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = cut(part.column("text"), lower, signs=False)
                first, key = choose(words, size)
                keys = part.column("keys")
                owner = np.repeat(np.arange(len(keys), dtype=np.int64), np.diff(keys.offsets.to_numpy()))
                known = unsigned(keys.flatten().to_numpy())
                tag = lambda k, d: mix(k + d.astype(U) * U(0xA24BAED4963EE407))
                doc = words.doc[first]
                first = first[np.isin(tag(key, doc), tag(known, owner))]
                doc = words.doc[first]
                whole, other = Prefix(words.hash), Prefix(mix(words.hash), 0xD1342543DE82EF95)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(whole.of(first, first + size))),
                        pa.array((other.of(first, first + size) >> U(33)).astype(np.int32)),
                        pa.array(_ids(part)[doc]),
                        pa.array(part.column("variant").to_numpy()[doc]),
                        pa.array((first - words.offsets[doc]).astype(np.int32)),
                    ],
                    ["print", "check", "doc_id", "variant", "first"],
                )

    return run


FOUND = ["doc_id", "variant", "first", "other_id"]


def _repeated(smaller: bool) -> Callable:
    """From rows sorted by (print, check, doc_id): windows of which another document has an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["print", "check", "doc_id", "variant", "first"]
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]  # rows of the run's first document
        least = None  # that document, once its rows are out
        for batch in batches:
            new = [batch.column(n).to_numpy() for n in names]
            if smaller:
                held_n = 0 if least is None else 1
                if held_n:
                    new = [np.concatenate([np.array([a], b.dtype), b]) for a, b in zip(least, new, strict=True)]
                p, c, d, kind, at = new
                run_start = np.ones(len(p), bool)
                run_start[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
                begin = np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
                hit = d > d[begin]
                yield pa.RecordBatch.from_arrays([pa.array(d[hit]), pa.array(kind[hit]), pa.array(at[hit]), pa.array(d[begin][hit])], FOUND)
                if len(p):
                    least = tuple(x[begin[-1]] for x in new)
                continue
            p, c, d, kind, at = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(p):
                continue
            run_start = np.ones(len(p), bool)
            run_start[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
            starts = np.flatnonzero(run_start)
            which = np.cumsum(run_start) - 1
            begin = starts[which]
            if least is not None and len(held[0]) == 0 and (p[0], c[0]) == least[:2]:
                first_doc = np.where(which == 0, least[2], d[begin])
            else:
                first_doc = d[begin]
            # a second document of each run: its last one, as rows are sorted by document
            last_doc = d[np.append(starts[1:], len(p)) - 1][which]
            open_run = which == which[-1]
            lone = open_run & (first_doc == last_doc)  # may still meet another document: held back
            hit = ~lone & (first_doc != last_doc)
            other = np.where(d == first_doc, last_doc, first_doc)
            yield pa.RecordBatch.from_arrays([pa.array(d[hit]), pa.array(kind[hit]), pa.array(at[hit]), pa.array(other[hit])], FOUND)
            held = [x[lone] for x in (p, c, d, kind, at)]
            least = (p[-1], c[-1], first_doc[-1])

    return run


def _sequences(lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = cut(part.column("text"), lower, signs=False)
                begin, end = words.offsets[:-1], words.offsets[1:]
                prints = [Prefix(words.hash).of(begin, end), Prefix(mix(words.hash), 0xD1342543DE82EF95).of(begin, end)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("variant"), pa.array(words.lengths()), *(pa.array(signed(x)) for x in prints)], ["doc_id", "variant", "n_words", "one", "two"])

    return run


def identified(documents: DataFrame) -> DataFrame:
    """(doc_id, text, variant) of rows with an id, null texts as empty; variant: a hash of the text, which parts rows of one doc_id.

    The form is always the same, so that one shuffle of it serves all that follows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.hash(text).alias("variant")).where("doc_id is not null")


def word_classes(documents: DataFrame, lower: bool = False) -> DataFrame:
    """(doc_id, variant, n_words, least_id, last_id): documents with the same words, by their smallest and largest id.

    Copies need no search: they repeat the first one whole. This keeps even a huge group of them out of the shuffles below.
    """
    rows = cut_lineage(identified(documents).mapInArrow(_sequences(lower), "doc_id long, variant int, n_words long, one long, two long"))
    classes = rows.groupBy("n_words", "one", "two").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("last_id"))
    return cut_lineage(rows.join(classes, ["n_words", "one", "two"]).select("doc_id", "variant", "n_words", "least_id", "last_id"))


def repeated_windows(docs: DataFrame, classes: DataFrame, size: int, choose: Chooser, smaller: bool, lower: bool = False) -> DataFrame:
    """(doc_id, variant, first, other_id): windows of `size` words that start at word `first` and also stand in document other_id.

    docs: identified(), dealt out by doc_id. classes: their word_classes(); only the first of each class is searched.
    smaller: only windows that a document with a smaller id has, which is then the smallest such; else all that
    any other searched document has. Rows with one doc_id count as one document; variant says which text a window is of.
    """
    firsts = classes.where(F.col("doc_id") == F.col("least_id")).where(F.col("n_words") >= size).select("doc_id").distinct()
    searched = docs.join(firsts, "doc_id")  # a semi-join would be moved below the shuffle of docs, which then serves it alone
    anchors = searched.mapInArrow(_anchors(choose, size, lower), "key long, doc_id long")
    shared = anchors.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_shared, "key long, doc_id long")
    by_doc = shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    windows = docs.join(by_doc, "doc_id").select("doc_id", "text", "variant", "keys").mapInArrow(_windows(choose, size, lower), "print long, check int, doc_id long, variant int, first int")
    ordered = windows.repartition("print").sortWithinPartitions("print", "check", "doc_id")
    return ordered.mapInArrow(_repeated(smaller), "doc_id long, variant int, first int, other_id long")


def merge_spans(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches [from, to) that windows of `size` words starting at `first` cover."""
    first = np.unique(first)
    if not len(first):
        return first, first
    apart = np.flatnonzero(first[1:] > first[:-1] + size)
    return first[np.append(0, apart + 1)], first[np.append(apart, len(first) - 1)] + size
