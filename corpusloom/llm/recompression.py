"""Substring dedup by recompression.

Rounds over the whole corpus rename runs of one symbol and then pairs of symbols, starting from words.
A name is a fingerprint of what it stands for, so naming is global without a shuffle: whichever executor
meets a run or pair gives it the same name. Pairs are formed by a bit of each symbol's name (left
followed by right), never by position, so equal stretches of text come out as equal symbols but for a
few at their edges. Every symbol knows the words it depends on, the stretch [low, high) that fixes both
its name and its place. If that lies in a window, each copy of the window has the same symbol in the
same place. Such high-level symbols, shared between documents, reveal repeats; whole windows verify them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import identified, repeated_windows, word_classes
from .words import Prefix, U, Words, cut, mix, slices

#: Rounds of renaming; after two a symbol depends on about eight words.
ROUNDS = 2


def recompress(words: Words, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Symbols after some rounds: name, first and last word, and low and high, the words they depend on.

    What depends on a text's end gets a bound outside the text, since another text may go on there.
    """
    n = len(words)
    symbol, doc = words.hash.copy(), words.doc
    first = np.arange(n)
    last, low, high = first.copy(), first.copy(), first + 1
    outside_low, outside_high = words.offsets[:-1] - 1, words.offsets[1:] + 1
    for step in range(rounds):
        if not len(symbol):
            break
        salt = U((0x51ED270B + 2 * step) * 0x9E3779B97F4A7C15 % (1 << 64))
        # runs
        head = np.ones(len(symbol), bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(head)
        final = np.append(begin[1:], len(symbol)) - 1
        count = (final - begin + 1).astype(U)
        name = np.where(count > 1, mix(symbol[begin] + salt + count * U(0xC2B2AE3D27D4EB4F)), symbol[begin])
        owner = doc[begin]
        before, after = np.maximum(begin - 1, 0), np.minimum(final + 1, len(symbol) - 1)
        low = np.where((begin > 0) & (doc[before] == owner), low[before], outside_low[owner])
        high = np.where((final + 1 < len(symbol)) & (doc[after] == owner), high[after], outside_high[owner])
        symbol, first, last, doc = name, first[begin], last[final], owner
        # pairs
        right = mix(symbol ^ salt) >> U(63) == 1
        m = len(symbol)
        next_same = np.zeros(m, bool)
        next_same[:-1] = doc[1:] == doc[:-1]
        next_right = np.append(right[1:], False)
        pair = ~right & next_right & next_same
        taken = np.append(False, pair[:-1])
        after = np.minimum(np.arange(m) + 1, m - 1)
        name = np.where(pair, mix(mix(symbol + salt) + U(3) * symbol[after]), symbol)
        prev_same = np.append(False, next_same[:-1])
        before = np.maximum(np.arange(m) - 1, 0)
        # a left one left alone depends on what follows, a right one on what stands before, a pair on itself
        new_low = np.where(right, np.where(prev_same, low[before], outside_low[doc]), low)
        new_high = np.where(right, high, np.where(next_same, high[after], outside_high[doc]))
        last = np.where(pair, last[after], last)
        keep = ~taken
        symbol, first, last, doc, low, high = name[keep], first[keep], last[keep], doc[keep], new_low[keep], new_high[keep]
    return {"name": symbol, "first": first, "last": last, "low": low, "high": high}


def symbol_anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor: the least-hashed symbol that the window's own words fix, with those words; else the window itself."""
    first = words.windows(size)
    if not len(first):
        return first, np.zeros(0, U)
    s = recompress(words)
    whole = Prefix(words.hash)
    n = len(words)
    low, high = np.clip(s["low"], 0, n), np.clip(s["high"], 0, n)
    name = mix(whole.of(np.minimum(low, high), high) + s["name"])
    below = np.zeros(n + 2, np.int64)  # symbols whose low is less than a word
    np.cumsum(np.bincount(s["low"] + 1, minlength=n + 2)[: n + 2], out=below)
    upto = np.zeros(n + 2, np.int64)  # symbols whose high is at most a word
    np.cumsum(np.bincount(s["high"], minlength=n + 2)[: n + 2], out=upto)
    at, end = below[first], upto[first + size]
    best = np.full(len(first), np.iinfo(np.uint64).max, U)
    rows = np.flatnonzero(at < end)
    at, end = at[rows], end[rows]
    while len(rows):
        best[rows] = np.minimum(best[rows], name[at])
        at = at + 1
        on = at < end
        rows, at, end = rows[on], at[on], end[on]
    alone = best == np.iinfo(np.uint64).max
    best[alone] = mix(whole.of(first[alone], first[alone] + size) + U(17))
    return first, best


def kept_words(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' kept words, joined by one space, as one byte array with its bounds."""
    n, texts = len(words), len(words.offsets) - 1
    kept = np.flatnonzero(~removed)
    doc = words.doc[kept]
    followed = np.zeros(len(kept), bool)
    followed[:-1] = doc[1:] == doc[:-1]
    edge = np.zeros(len(words.buffer) + 2, np.int8)
    end = words.end[kept] + followed
    edge[words.start[kept]] += 1
    edge[end] -= 1  # a word's end is no other's; its start may be
    mask = np.cumsum(edge[:-2], dtype=np.int8) > 0
    out = words.buffer.copy()
    out[words.end[kept[followed]]] = 32
    sizes = np.bincount(doc, weights=end - words.start[kept], minlength=texts).astype(np.int64) if n else np.zeros(texts, np.int64)
    return out[mask], np.concatenate([[0], np.cumsum(sizes)])


def _own(values: pa.Array, variants: pa.Array, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists found by doc_id, what belongs to each row's own text: rows and values."""
    owner = np.repeat(np.arange(len(values)), np.diff(values.offsets.to_numpy()))
    mine = variants.flatten().to_numpy() == variant[owner]
    return owner[mine], values.flatten().to_numpy().astype(np.int64)[mine]


def _clean(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = cut(part.column("text"), lower=False, signs=False)
                variant = part.column("variant").to_numpy()
                owner, first = _own(part.column("starts"), part.column("of"), variant)
                copied = np.zeros(part.num_rows, bool)
                copied[_own(part.column("copies"), part.column("copies"), variant)[0]] = True
                change = np.zeros(len(words) + 1, np.int64)
                at = words.offsets[owner] + first
                np.add.at(change, at, 1)
                np.add.at(change, at + size, -1)
                removed = (np.cumsum(change[:-1]) > 0) | copied[words.doc]
                data, bounds = kept_words(words, removed)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                count = np.bincount(words.doc[removed], minlength=part.num_rows)
                columns = [part.column("doc_id"), pa.array(words.lengths()), pa.array(count.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def substring_dedup(documents: DataFrame, size: int = 13, with_text: bool = True) -> DataFrame:
    """Removes words inside windows of `size` words that also start in a document with a smaller doc_id.

    Takes (doc_id, text) and ignores other columns. Words are all but ASCII white space; windows are judged on
    the input. Returns doc_id, n_words, n_removed, kept_sha256 of the kept words joined by spaces and, if asked
    for, kept_text. A null text has no words and an empty kept text; a row with null doc_id is returned whole,
    since no order holds for it. Rows with one doc_id don't remove from each other, so a repeated row doesn't remove
    itself, and of two texts with one doc_id each loses what documents with a smaller doc_id have. A text of any length
    is read whole; one with fewer words than a window is returned whole, and an empty table gives an empty result.
    """
    docs = identified(documents).repartition("doc_id")
    classes = word_classes(documents)
    found = repeated_windows(docs, classes, size, symbol_anchors, smaller=True)
    starts = found.groupBy("doc_id").agg(F.collect_list("first").alias("starts"), F.collect_list("variant").alias("of"))
    copies = classes.where((F.col("doc_id") > F.col("least_id")) & (F.col("n_words") >= size)).groupBy("doc_id").agg(F.collect_set("variant").alias("copies"))
    none = F.array().cast("array<int>")
    lists = [F.coalesce(c, none).alias(c) for c in ("starts", "of", "copies")]
    joined = docs.join(starts, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "variant", *lists)
    nameless = documents.where(F.col("doc_id").cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(0).alias("variant"), *[none.alias(c) for c in ("starts", "of", "copies")])
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_clean(size, with_text), schema).union(nameless.mapInArrow(_clean(size, with_text), schema))
