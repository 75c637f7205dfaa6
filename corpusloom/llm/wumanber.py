"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of all benchmark items. Blocks are pairs of words. A shift table says for each block
how near to a pattern's end it can stand; blocks in no pattern let the search skip as many words as fit between.
Blocks that end a pattern (shift 0) lead to a bucket of patterns with that suffix, the hash of a pattern's second half,
and direct comparison of the words confirms an occurrence. Equal windows of several items are one pattern. The tables
are arrays, and a batch of documents is searched at once: first only every (length - 1)-th block of each text is looked
up, then, where one of them stands in a pattern, the blocks in its reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage
from .words import Prefix, U, Words, cut, mix, slices

#: Words of benchmark items searched for at once: tables of one pass are broadcast, so they are kept to some 200 MB.
PASS_WORDS = 500_000


@dataclass
class Patterns:
    """Patterns of one length, each as the place of its first word in the items' words."""

    length: int
    first: np.ndarray
    #: Items of pattern i, each once: items[item_bounds[i]:item_bounds[i + 1]].
    item_bounds: np.ndarray
    items: np.ndarray
    #: Sorted fingerprints of blocks and the least shift of each.
    blocks: np.ndarray
    shift: np.ndarray
    #: Sorted hashes of pattern suffixes, and for each its patterns' stretch in `bucket`.
    suffixes: np.ndarray
    bucket_bounds: np.ndarray
    bucket: np.ndarray


def suffix_size(length: int) -> int:
    """Words of the suffix that a bucket is found by."""
    return (length + 1) // 2


@dataclass
class Tables:
    """Items' words and their patterns by length."""

    hash: np.ndarray
    text: list[bytes]
    groups: list[Patterns]


def _block_prints(hashes: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Fingerprints of the blocks that end at the given words."""
    return hashes[at] if block == 1 else mix(hashes[at - 1] * U(3) + hashes[at] + U(block))


def build(ids: list[int], texts: list[str | None], size: int) -> Tables:
    """Shift tables and buckets. An item of fewer words than `size`, but not none, is one pattern."""
    words = cut(pa.array(texts, pa.string()), lower=True, signs=True)
    lengths = words.lengths()
    item = np.asarray(ids, np.int64)
    whole = words.windows(size)
    kinds = [(size, whole, item[words.doc[whole]])] if len(whole) else []
    for n in np.unique(lengths[(lengths > 0) & (lengths < size)]):
        rows = np.flatnonzero(lengths == n)
        kinds.append((int(n), words.offsets[rows], item[rows]))
    groups = []
    texts_of = [words.word(i) for i in range(len(words))]
    for length, places, owner in kinds:
        alike: dict[tuple[bytes, ...], int] = {}  # windows of the same words are one pattern
        kind = np.array([alike.setdefault(tuple(texts_of[p : p + length]), len(alike)) for p in places.tolist()], np.int64)
        first = np.zeros(len(alike), np.int64)
        first[kind[::-1]] = places[::-1]
        pairs = np.unique(np.stack([kind, owner], 1), axis=0)
        item_bounds = np.searchsorted(pairs[:, 0], np.arange(len(alike) + 1))
        block = min(2, length)
        ends = np.arange(block, length + 1)
        stands = (first[:, None] + ends[None, :] - 1).ravel()
        prints = _block_prints(words.hash, stands, block)
        shifts = np.tile(length - ends, len(first))
        order = np.lexsort((shifts, prints))
        prints, shifts = prints[order], shifts[order]
        new = np.append(True, prints[1:] != prints[:-1])
        suffix = Prefix(words.hash).of(first + length - suffix_size(length), first + length)
        by = np.argsort(suffix, kind="stable")
        suffixes, starts = np.unique(suffix[by], return_index=True)
        groups.append(Patterns(length, first, item_bounds, pairs[:, 1], prints[new], shifts[new], suffixes, np.append(starts, len(by)), by))
    return Tables(words.hash, texts_of, groups)


def _find(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = int(count.sum())
    return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


def search(words: Words, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences, their first words and lengths; and (document, item) of the items that occur in each, once."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    owners: list[np.ndarray] = []
    for group in tables.groups:
        n, block = group.length, min(2, group.length)
        lengths = words.lengths()
        begin, size = words.offsets[:-1][lengths >= n], lengths[lengths >= n]
        if not len(begin):
            continue
        # every stride-th possible block from the first pattern end on; between two of them no pattern end is skipped
        stride = n - block + 1
        probes = -(-(size - n + 1) // stride)
        owner = np.repeat(np.arange(len(begin)), probes)
        step = _ranges(np.zeros(len(begin), np.int64), probes)
        last = begin[owner] + size[owner] - 1
        probe = begin[owner] + n - 1 + step * stride
        at, known = _find(group.blocks, _block_prints(words.hash, probe, block))
        shift = group.shift[at][known]
        # a pattern that covers this block ends from `shift` words after it on, before the next block looked up
        probe, last = probe[known], last[known]
        room = np.maximum(np.minimum(stride - 1, last - probe) - shift + 1, 0)
        end = _ranges(probe + shift, room)
        at, known = _find(group.blocks, _block_prints(words.hash, end, block))
        end = end[known & (group.shift[at] == 0)]
        first = end - n + 1
        half = suffix_size(n)
        at, known = _find(group.suffixes, Prefix(words.hash).of(first + n - half, first + n)) if len(first) else (first, first.astype(bool))
        first, at = first[known], at[known]
        count = group.bucket_bounds[at + 1] - group.bucket_bounds[at]
        pattern = group.bucket[_ranges(group.bucket_bounds[at], count)]
        first = np.repeat(first, count)
        for i in range(n):  # words that differ in their hash differ
            alike = words.hash[first + i] == tables.hash[group.first[pattern] + i]
            first, pattern = first[alike], pattern[alike]
        same = [all(words.word(f + i) == tables.text[p + i] for i in range(n)) for f, p in zip(first.tolist(), group.first[pattern].tolist(), strict=True)]
        first, pattern = first[same], pattern[same]
        if len(first):
            found.append((first, np.full(len(first), n)))
            doc, pattern = np.unique(np.stack([words.doc[first], pattern], 1), axis=0).T
            begins, many = group.item_bounds[pattern], group.item_bounds[pattern + 1] - group.item_bounds[pattern]
            owners.append(np.stack([np.repeat(doc, many), group.items[_ranges(begins, many)]], 1))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    pairs = np.unique(np.concatenate(owners), axis=0)
    return *(np.concatenate(x) for x in zip(*found, strict=True)), pairs[:, 0], pairs[:, 1]  # type: ignore[return-value]


FOUND = ("n_words", "hit_words", "item_ids")


def _finds(words: Words, tables: Tables, rows: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each text, the places of its words inside windows, and the items that occur, both in order."""
    first, length, doc, item = search(words, tables)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    places: list[list[int]] = [[] for _ in range(rows)]
    items: list[list[int]] = [[] for _ in range(rows)]
    for w, d in zip(hit.tolist(), words.doc[hit].tolist(), strict=True):
        places[d].append(w - int(words.offsets[d]))
    for d, i in zip(doc.tolist(), item.tolist(), strict=True):
        items[d].append(i)
    return places, items


def _scan(tables_at) -> Callable:
    """Adds FOUND to rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_at.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = cut(part.column("text"), lower=True, signs=True)
                places, items = _finds(words, tables, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words.lengths()), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], [*part.schema.names, *FOUND])

    return run


def _more(tables_at) -> Callable:
    """(row, hit_words, item_ids) of the rows (text, row) that a further pass finds something in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_at.value
        for batch in batches:
            for part in slices(batch, "text"):
                places, items = _finds(cut(part.column("text"), lower=True, signs=True), tables, part.num_rows)
                there = pa.array([i for i, x in enumerate(places) if x], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(ROW).take(there), pa.array([x for x in places if x], pa.list_(pa.int32())), pa.array([y for x, y in zip(places, items, strict=True) if x], pa.list_(pa.int64()))], [ROW, "hit_words", "item_ids"])

    return run


#: The key of a row where there are several passes.
ROW = "row of the scan"


def stretches(text: str, size: int) -> Iterator[str]:
    """An item's text, in parts if it is too long for one pass: each window of `size` words stands in one of them."""
    if len(text) <= 2 * PASS_WORDS:
        yield text
        return
    words = cut(pa.array([text], pa.string()), lower=True, signs=True)
    step = max(1, PASS_WORDS // 8)
    for at in range(0, max(1, len(words) - size + 1), step):
        yield b" ".join(words.word(i) for i in range(at, min(len(words), at + step + size - 1))).decode()


def find_benchmark(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Documents with all their columns (but for clashing names), n_words, hit_words (places of words inside benchmark windows) and item_ids.

    A window is `size` consecutive words of an item, or a shorter item whole. Words are letters, digits and
    non-ASCII characters, with A-Z lower-cased. Items are searched for in passes of PASS_WORDS words, so tables
    have a bound however large the benchmark is. With several passes the rows are written once, with a key of their own;
    each further pass reads their texts and keeps the key and finds of rows that have some, and these join the rows in the
    end. So every row, whatever its doc_id, has all passes' finds; repeated rows have them each. Ids of items are whole numbers.
    Items that share a window all count where it stands. An item too long for a pass is cut into stretches. Null texts have no words, wordless items and those with null ids
    match nothing, an empty benchmark leaves all documents clean, and an empty table of documents gives an empty result.
    """
    documents = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in FOUND])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    spark = documents.sparkSession
    shape = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def blocks() -> Iterator[tuple[list[int], list[str]]]:
        """Items of one pass after another: one partition of the benchmark at a time comes to the driver."""
        block: tuple[list[int], list[str]] = ([], [])
        held = 0
        for row in items.toLocalIterator():
            for text in stretches(row.text, size):
                block[0].append(row.item_id)
                block[1].append(text)
                held += len(text) // 2 + 1
                if held >= PASS_WORDS:
                    yield block
                    block, held = ([], []), 0
        if block[0]:
            yield block

    passes = blocks()
    now, then = next(passes, ([], [])), next(passes, None)
    rows = documents if then is None else cut_lineage(documents.withColumn(ROW, F.monotonically_increasing_id()))
    tables = spark.sparkContext.broadcast(build(*now, size))
    result = rows.mapInArrow(_scan(tables), f"{shape(rows)}, n_words long, hit_words array<int>, item_ids array<long>")
    if then is None:
        return result
    finds = [cut_lineage(result.select(ROW, "n_words", "hit_words", "item_ids"))]
    while then is not None:  # a pass is done, and its tables gone, before the next one's are built
        tables.destroy()
        tables = spark.sparkContext.broadcast(build(*then, size))
        finds.append(cut_lineage(rows.select("text", ROW).mapInArrow(_more(tables), f"`{ROW}` long, hit_words array<int>, item_ids array<long>")).withColumn("n_words", F.lit(None).cast("long")).select(finds[0].columns))
        then = next(passes, None)
    tables.destroy()
    every = finds[0]
    for found in finds[1:]:
        every = every.unionByName(found)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    sums = every.groupBy(ROW).agg(F.max("n_words").alias("n_words"), joined("hit_words"), joined("item_ids"))
    return rows.join(sums, ROW).select(*documents.columns, *FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    ids = F.array_sort(F.transform(F.array_distinct("item_ids"), lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
