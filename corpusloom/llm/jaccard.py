"""N-gram Jaccard join in the metric space of shingle sets, by pivots, Voronoi regions and boundary windows.

Jaccard distance d is a metric, and two documents link when d <= r = 1 - threshold.

* *Classes.* Documents with equal sets are one point of the space, so copies cost nothing further.
* *Points that may link.* Shingles have a common order (by hash). Of two linked sets of about n shingles, the first
  n * r + l of each share l or more. So a point with fewer shared ones there has no neighbour and leaves. Only the points
  that stay are compared, and only what they share with each other counts from then on; their other shingles are their own.
* *Pivots.* In each round, of the points that share rare shingles, those with the least share of own ones lead: they
  stand in the middle of a group of copies. A point leads if it does so for half of its shared rare shingles, so pivots stand apart.
* *Voronoi regions.* The points that share one of those shingles with a pivot measure their distance. A point within r of a pivot
  links with it and belongs to the region of its nearest one. A region is one component by that, so nothing in it need be
  compared with each other. Points in no region are dealt anew, with more pivots each round, until none share a rare shingle.
* *Boundary windows.* If x is outside of region p and links with y inside, then d(x, p) <= d(y, p) + r <= 2r. So points
  at most 2r from p are replicated into p's window if their component is another. Two points within 2r have one of their
  n - ceil((1 - 2r) n) + 1 rarest shingles in common, which brings points and pivots together; no other distance is needed.
* *Regions join.* A region's boundary points, those at least as far from p as the nearest point of the window less r, and its window
  are joined in blocks of bounded size: a task compares two blocks, and only links come out. Pivots that are alone in
  their region are points like others: those that share no window with a point are compared with it directly.

So a group of g near copies takes about g distances, not g**2.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import add_columns, components, cut_lineage, released, settled, trimmed
from .words import Prefix, U, Words, cut, lists, mix, signed, slices

#: Share of a set that its first shingles hold besides the n * r ones, and that linked sets then share of them at least.
MORE = 0.1


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, with the text each belongs to, and each text's count."""
    first = words.windows(size)
    lengths = words.lengths()
    few = np.flatnonzero((lengths > 0) & (lengths < size))
    whole = Prefix(words.hash)
    value = np.concatenate([whole.of(first, first + size), whole.of(words.offsets[few], words.offsets[few + 1])])
    doc = np.concatenate([words.doc[first], few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, doc, np.bincount(doc, minlength=len(lengths))


def _fingerprints(value: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    one, two = np.zeros(len(n), U), np.zeros(len(n), U)
    np.add.at(one, doc, mix(value))
    np.add.at(two, doc, mix(value ^ U(0xD6E8FEB86659FD93)))
    return [pa.array(n), pa.array(signed(one)), pa.array(signed(two))]


KEYS = ["n", "one", "two"]


def _least(n: np.ndarray, threshold: float) -> np.ndarray:
    """Shingles that a linked set of n has in common with any other at least."""
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def _summary(size: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for part in slices(batch, "text"):
                value, doc, n = shingle_sets(cut(part.column("text"), True, False), size)
                bounds = np.concatenate([[0], np.cumsum(n)])
                count = np.where(n > 0, np.minimum(n, n - _least(n, threshold) + np.maximum(1, (n * MORE).astype(np.int64))), 0)
                first = np.arange(len(value)) - bounds[doc] < count[doc]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_fingerprints(value, doc, n), lists(signed(value[first]), count, pa.int64())], ["doc_id", *KEYS, "first"])
            trimmed()

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, doc, n = shingle_sets(cut(part.column("text"), True, False), size)
                yield pa.RecordBatch.from_arrays([*_fingerprints(value, doc, n), lists(signed(value), n, pa.int64())], [*KEYS, "shingles"])

    return run


def _points(docs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """(point, n, shingles) of the classes that may have a neighbour."""
    firsts = rows.join(classes.select(F.col("point").alias("row")), "row", "left_semi").select(F.col("row").alias("point"), "n", F.explode("first").alias("key"))
    shared = firsts.join(firsts.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "key")
    # a linked set has threshold * n shingles at least, so that many of its first ones count
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * F.lit(threshold) - 1e-9) * F.lit(MORE)))
    stay = shared.groupBy("point", "n").agg(F.count("*").alias("c")).where(F.col("c") >= needed).select("point")
    stay = cut_lineage(classes.join(stay, "point", "left_semi"))
    some = docs.join(stay.select(F.col("least_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = some.select("text").mapInArrow(_sets(size), "n long, one long, two long, shingles array<long>")
    return cut_lineage(sets.join(stay.select("point", *KEYS), KEYS).select("point", "n", "shingles").dropDuplicates(["point"]))


def _entries(points: DataFrame, threshold: float) -> DataFrame:
    """(key, point, n, before, own, close): each point's rarest shingles, of which two points within 2r share one; close: within r.

    own: how many of its shingles no other point has; before: how many are rarer than this one.
    """
    keys = points.select("point", "n", F.explode("shingles").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    known = keys.join(often, "key").groupBy("point", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("k"))
    known = known.withColumn("own", F.col("n") - F.size("k"))

    def rarest(least: float) -> Column:
        return F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1 - F.col("own")

    known = known.withColumn("near", rarest(threshold)).where("near > 0")
    taken = F.slice("k", F.lit(1), rarest(2 * threshold - 1).cast("int"))
    rows = known.select("point", "n", "own", "near", F.posexplode(taken).alias("place", "k"))
    return cut_lineage(rows.select(F.col("k.key").alias("key"), "point", "n", (F.col("own") + F.col("place")).alias("before"), "own", (F.col("place") < F.col("near")).alias("close")))


def _enough(common: Column, n: str, other: str, least: float) -> Column:
    """Whether so many common shingles would make a similarity of `least`."""
    return common >= (F.col(n) + F.col(other)) * F.lit(least / (1 + least)) - 1e-9


#: Shingles up to which sets are broadcast: some 8 MB.
SMALL_SETS = 1_000_000


def _measured(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sizes n, m and the number of common shingles."""
    pairs = settled(pairs)
    left = points.select(F.col("point").alias("a"), "n", F.col("shingles").alias("x"))
    right = points.select(F.col("point").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("y"))
    heads = right.join(pairs.select("b").distinct(), "b", "left_semi")
    if (heads.agg(F.sum("m")).first()[0] or 0) <= SMALL_SETS:  # then pairs and their second sets go to the first ones
        right = cut_lineage(heads).hint("broadcast")
    both = pairs.join(left, "a").join(right, "b")
    return both.select(*pairs.columns, "n", "m", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))


def _possible(least_n: str, threshold: float) -> Column:
    """Whether a set of n shingles, `own` of which no other has, can link with one of least_n shingles or more."""
    shared = F.col("n") - F.col("own")
    either = F.when(F.col(least_n) <= shared, F.col("n")).otherwise(F.col("n") + F.col(least_n) - shared)
    return shared >= either * F.lit(threshold) - 1e-9


def _stars(points: DataFrame, entries: DataFrame, threshold: float) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Rounds of pivots as (pivot, m, p_own), their points within 2r as (pivot, point, n, m, common), and the points that may link."""
    outer, candidates, leaders = entries.where("close").drop("close", "before"), None, 1
    pivots, found = [], []
    while True:
        sizes = outer.groupBy("key").agg(F.min("n").alias("least_n"), F.min("point").alias("a"), F.max("point").alias("b")).where("a < b")
        live = settled(outer.join(sizes.select("key", "least_n"), "key").where(_possible("least_n", threshold)).drop("least_n"))
        candidates = settled(live.select("point").distinct()) if candidates is None else candidates
        # the share of own shingles, made different for all points
        rank = F.col("own") / F.col("n") + F.pmod(F.xxhash64("point"), F.lit(1 << 20)) * F.lit(1e-9)
        led = live.groupBy("key", F.pmod(F.xxhash64("point", F.lit(7)), F.lit(leaders)).alias("k")).agg(F.min_by("point", rank).alias("pivot"))
        total = live.groupBy(F.col("point").alias("pivot"), F.col("n").alias("m"), F.col("own").alias("p_own")).agg(F.count("*").alias("total"))
        chosen = settled(led.groupBy("pivot").agg(F.count("*").alias("led")).join(total, "pivot").where("2 * led >= total").select("pivot", "m", "p_own"))
        if chosen.isEmpty():
            return pivots, found, candidates
        pairs = live.join(led.join(chosen, "pivot"), "key").where("point <> pivot").select("point", "pivot").distinct()
        near = _measured(pairs.select(F.col("point").alias("a"), F.col("pivot").alias("b")), points).where(_enough(F.col("common"), "n", "m", 2 * threshold - 1))
        near = settled(near.select(F.col("b").alias("pivot"), F.col("a").alias("point"), "n", "m", "common"))
        pivots.append(chosen)
        found.append(near)
        inside = near.where(_enough(F.col("common"), "n", "m", threshold)).select("point").union(chosen.select("pivot")).distinct()
        outer = live.join(settled(inside), "point", "left_anti")
        leaders *= 16


def _distance() -> Column:
    return 1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))


def _first_common(n: str, before: str, m: str, p_before: str, least: float) -> Column:
    """Whether a shingle can be the first that two sets have in common: what follows in both has to be enough."""
    needed = F.ceil((F.col(n) + F.col(m)) * F.lit(least / (1 + least)) - 1e-9)
    return (F.col(n) - F.col(before) >= needed) & (F.col(m) - F.col(p_before) >= needed)


#: Points and shingles of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 17


def _compare(threshold: float) -> Callable:
    """Links between two blocks of a region and its window, for points of different components that aren't both inside."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["point", "mine"])
        sizes = np.array([len(s) for s in group["shingles"]])
        flat, owner = np.concatenate([np.asarray(s) for s in group["shingles"]]), np.repeat(np.arange(len(group)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        number = np.cumsum(np.append(False, flat[1:] != flat[:-1]))
        common = np.zeros((len(group), len(group)), np.float32)
        for low in range(0, int(number[-1]) + 1, 2048):
            a, b = np.searchsorted(number, [low, low + 2048])
            on = np.zeros((len(group), 2048), np.float32)
            on[owner[a:b], number[a:b] - low] = 1
            common += on @ on.T
        least = (sizes[:, None] + sizes[None, :]) * (threshold / (1 + threshold)) - 1e-6
        point, label, mine, inside = (group[c].to_numpy() for c in ("point", "group", "mine", "inside"))
        across = (mine[:, None] < mine[None, :]) if mine.min() < mine.max() else np.triu(np.ones(common.shape, bool), 1)
        x, y = np.nonzero((common >= least) & across & (label[:, None] != label[None, :]) & ~(inside[:, None] & inside[None, :]))
        return pd.DataFrame({"a": point[x], "b": point[y]})

    return run


def _joined(members: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links among the members (pivot, point, n, group, inside) of each region and its window, block by block."""
    total = members.groupBy("pivot").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(total.select("pivot", blocks.alias("blocks")), "pivot").withColumn("mine", F.pmod(F.xxhash64("point", F.lit(23)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("pivot", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "point", "group", "inside", "mine")
    cells = cells.join(points.select("point", "shingles"), "point")
    return cells.groupBy("pivot", "one", "two").applyInPandas(_compare(threshold), "a long, b long")


def _across(pivots: DataFrame, found: DataFrame, candidates: DataFrame, points: DataFrame, entries: DataFrame, grouped: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links of points in windows with each other and with points of the regions, and of lone points."""
    r, wide = 1 - threshold, 2 * threshold - 1
    kept = entries.join(candidates, "point", "left_semi")
    labels = grouped.select(F.col("node").alias("point"), F.col("component").alias("group"))
    own = kept.select("point", "n", "own").distinct().join(labels, "point", "left").withColumn("group", F.coalesce("group", "point"))
    own = settled(own)
    inside = found.where(_enough(F.col("common"), "n", "m", threshold)).select("pivot", "point", "n", _distance().alias("d"))
    nearest = Window.partitionBy("point").orderBy("d", "pivot")
    region = inside.withColumn("k", F.row_number().over(nearest)).where("k = 1").drop("k")
    heads = region.groupBy("pivot").agg(F.min("n").alias("least_n")).join(own.select(F.col("point").alias("pivot"), F.col("n").alias("m"), F.col("own").alias("p_own"), F.col("group").alias("p_group")), "pivot")
    heads = settled(heads.withColumn("least_n", F.least("least_n", "m")))
    keys = kept.select("key", "point", "before", "close")
    theirs = keys.join(heads, F.col("point") == F.col("pivot")).select("key", "pivot", "m", "p_own", "p_group", "least_n", F.col("before").alias("p_before"))
    theirs = settled(theirs)
    bound = F.least(F.col("n") - F.col("own"), F.col("m") - F.col("p_own"))
    other = (F.col("group") != F.col("p_group")) & _possible("least_n", threshold) & _enough(bound, "n", "m", wide) & _first_common("n", "before", "m", "p_before", wide)
    mine = keys.join(own, "point")
    met = mine.join(theirs, "key").where(other).select(F.col("point").alias("a"), F.col("pivot").alias("b")).distinct()
    window = _measured(met, points).where(_enough(F.col("common"), "n", "m", wide)).select(F.col("b").alias("pivot"), F.col("a").alias("point"), "n", _distance().alias("d"))
    window = settled(window.join(own.select("point", "group"), "point"))
    edge = window.groupBy("pivot").agg((F.min("d") - r - 1e-9).alias("edge"))
    itself = heads.select("pivot", F.col("pivot").alias("point"), F.col("m").alias("n"), F.lit(0.0).alias("d"))
    bounds = region.union(itself).join(edge, "pivot").where("d >= edge").join(own.select("point", "group"), "point")
    columns = ["pivot", "point", "n", "group"]
    links = _joined(window.select(*columns, F.lit(False).alias("inside")).union(bounds.select(*columns, F.lit(True).alias("inside"))), points, threshold)

    # pivots alone in their region, and other points in no region
    loose = mine.where("close").join(region.select("point").union(heads.select("pivot")), "point", "left_anti")
    loose = loose.join(window.groupBy("point").agg(F.collect_set("pivot").alias("windows")), "point", "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<long>")))
    loose = settled(loose, "windows")
    lone = loose.join(pivots.select(F.col("pivot").alias("point")), "point", "left_semi")
    lone = lone.select("key", *[F.col(c).alias(f"p_{c}") for c in ("point", "n", "before", "own", "group", "windows")])
    apart = (F.col("point") != F.col("p_point")) & (F.col("group") != F.col("p_group")) & ~F.arrays_overlap("windows", "p_windows")
    enough = _enough(F.least(F.col("n") - F.col("own"), F.col("p_n") - F.col("p_own")), "n", "p_n", threshold) & _first_common("n", "before", "p_n", "p_before", threshold)
    pairs = loose.join(lone, "key").where(apart & enough).select(F.least("point", "p_point").alias("a"), F.greatest("point", "p_point").alias("b")).distinct()
    return links.union(_measured(pairs, points).where(_enough(F.col("common"), "n", "m", threshold)).select("a", "b"))


def _classes(documents: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows as (row, doc_id, n, one, two), and classes of equal sets as (n, one, two, component_id)."""
    if not 0.5 < threshold <= 1:
        raise ValueError("a similarity above 0.5 is needed: beyond that, windows would hold documents that share nothing")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(_summary(size, threshold), "doc_id long, n long, one long, two long, first array<long>")
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    classes = rows.where("doc_id is not null and n > 0").groupBy(*KEYS).agg(F.min("row").alias("point"), F.min("doc_id").alias("least_id"))
    classes = cut_lineage(classes)
    points = _points(docs.where("doc_id is not null and text is not null"), classes, rows, size, threshold)
    entries = _entries(points, threshold)
    pivots, found, candidates = _stars(points, entries, threshold)
    if found:
        heads, near = functools.reduce(DataFrame.union, pivots), functools.reduce(DataFrame.union, found)
        links = near.where(_enough(F.col("common"), "n", "m", threshold)).select(F.col("point").alias("a"), F.col("pivot").alias("b"))
        grouped = components(links)
        more = cut_lineage(_across(heads, near, candidates, points, entries, grouped, threshold))
        if not more.isEmpty():
            grouped = components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        classes = classes.join(grouped, F.col("point") == F.col("node"), "left").withColumn("component", F.coalesce("component", "point"))
        least = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
        classes = classes.join(least, "component")
    else:
        classes = classes.withColumn("component_id", F.col("least_id"))
    return rows, classes.select(*KEYS, "component_id")


def jaccard_components(documents: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Each document's shingle count and the component of documents linked by Jaccard similarity.

    Takes (doc_id, text), ignores other columns. Words are all but ASCII white space, with A-Z lower-cased; a set
    holds the distinct shingles of `size` words, or the whole text as one if it is shorter. Two documents link when
    common >= threshold * either, exactly so on ties; threshold: above 0.5. Returns doc_id, n_shingles, component_id: the
    smallest doc_id reachable by links, itself included. A null or wordless text has no shingles and is its own
    component; a null doc_id gets a null component and links nothing. Each row is a document of its own, whatever its
    doc_id: repeated rows come back as often as they stand there, and of two texts with one doc_id each has its own
    links. Texts of any length are read whole. An empty table gives an empty result.
    """
    rows, classes = _classes(documents, size, threshold)
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(classes, KEYS, "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def first_of_each(documents: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """documents without those that are linked, over any number of links, with one of a smaller doc_id.

    All columns stay as they are. Rows without a doc_id or without words stay, and so do all rows that repeat one that
    stays. Columns of documents that are named like KEYS or component_id would give way, so they are kept aside.
    """
    _, classes = _classes(documents, size, threshold)
    aside = {c: f"column {i}" for i, c in enumerate(documents.columns)}
    named = documents.select(*[F.col(f"`{c}`").alias(k) for c, k in aside.items()], F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("the id"))

    def prepare() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            return _fingerprints(*shingle_sets(cut(part.column("text"), True, False), size))

        return work

    others = add_columns(named, prepare, dict.fromkeys(KEYS, "long")).join(classes, KEYS, "left")
    stay = others.where(F.col("component_id").isNull() | F.col("the id").isNull() | (F.col("component_id") >= F.col("the id")))
    return stay.select(*[F.col(f"`{k}`").alias(c) for c, k in aside.items()])
