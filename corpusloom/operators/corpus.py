"""Corpus engineering: dedup, anti-joins against earlier corpora, splits, rarity, quotas, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written


def first_by(df: DataFrame, keys: list[Column], order: list[Column], nulls_differ: bool = False) -> DataFrame:
    """One row a key, the first in order. nulls_differ: rows with a null key all stay."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    ranked = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    keep = F.col("__n") == 1
    if nulls_differ:
        for n in names:
            keep = keep | F.col(n).isNull()
    return ranked.where(keep).drop("__n", *names)


def dedup_normalized(df: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """One row for each text, compared trimmed, lower-cased and with white space collapsed.

    The key is shuffled as a digest, so long texts aren't sorted by.
    """
    return first_by(df, [F.sha2(T.normalize(F.col(text)), 256)], order)


def dedup_exact(df: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    return first_by(df, [F.sha2(T.trim(F.col(text)), 256)], order)


def dedup_content(df: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
    """One row for each content hash over several columns."""
    return first_by(df, [F.sha1(F.concat_ws("|", *parts))], order)


def not_in(df: DataFrame, other: DataFrame, key: Column) -> DataFrame:
    """Rows whose key no row of the other corpus has; keys meet as digests."""
    mine = df.withColumn("__key", F.sha2(key, 256))
    theirs = other.select(F.sha2(key, 256).alias("__key")).distinct()
    return mine.join(theirs, "__key", "left_anti").drop("__key")


def pool(sources: list[DataFrame], id_col: str) -> DataFrame:
    """Union in priority order, one row an id; rows without an id all stay."""
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("__rank", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    return first_by(out, [F.col(id_col)], [F.col("__rank")], nulls_differ=True).drop("__rank")  # type: ignore[arg-type]


def hash_key(seed: int, *parts: str) -> Column:
    """A portable pseudo-random order: the digest of a seed and an id."""
    return F.md5(F.concat(F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def hash_unit(seed: int, *parts: str) -> Column:
    """The same as a number from 0 to 1, by its first 8 hex digits."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def split(df: DataFrame, seed: int, shares: tuple[float, ...], names: tuple[str, ...], id_col: str) -> DataFrame:
    """Assigns each row a split by the hash of its id: no sort, no shuffle, the same at any size."""
    u, label, upto = hash_unit(seed, id_col), F.lit(names[-1]), sum(shares)
    for share, name in reversed(list(zip(shares[:-1], names[:-1], strict=True))):
        upto = sum(shares[: names.index(name) + 1])
        label = F.when(u < upto, name).otherwise(label)
    return df.withColumn("split", label)


def stratified_split(df: DataFrame, seed: int, ratio: float, stratum: str, id_col: str) -> DataFrame:
    """Of each stratum, max(1, floor(n * ratio)) rows in hash order go to `val`, the rest to `train`.

    A rank inside one stratum needs its rows together; counts and thresholds per hash prefix keep that
    to the one prefix where the quota falls.
    """
    keyed = df.withColumn("__h", hash_key(seed, id_col)).withColumn("__p", F.substring("__h", 1, 3))
    counts = keyed.groupBy(stratum, "__p").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(stratum).orderBy("__p")
    whole = Window.partitionBy(stratum)
    quota = F.greatest(F.lit(1), F.floor(F.sum("__n").over(whole) * F.lit(ratio)))
    bounds = counts.select(stratum, "__p", (F.sum("__n").over(order) - F.col("__n")).alias("__before"), quota.alias("__quota"))
    joined = keyed.join(bounds, [stratum, "__p"])
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(stratum, "__p").orderBy("__h"))
    return joined.withColumn("split", F.when(rank <= F.col("__quota"), "val").otherwise("train")).drop("__h", "__p", "__before", "__quota")


def downsample(df: DataFrame, positive: Column, times: int, seed: int, id_col: str) -> DataFrame:
    """All positive rows, and of the others the first in hash order, at most `times` as many."""
    marked = df.withColumn("__pos", positive).withColumn("__h", hash_key(seed, id_col)).withColumn("__b", F.substring("__h", 1, 4))
    most = marked.agg((times * F.coalesce(F.sum(F.col("__pos").cast("long")), F.lit(0))).alias("__most"))
    counts = marked.where(~F.col("__pos")).groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n"))  # 65,536 buckets at most
    wanted = counts.join(F.broadcast(most)).where("__before < __most").select("__b", (F.col("__most") - F.col("__before")).alias("__left"), (F.col("__before") + F.col("__n") <= F.col("__most")).alias("__all"))
    met = marked.join(F.broadcast(wanted), "__b", "left")
    # only the bucket in which the last row lies is put in order
    last = met.where(~F.col("__pos") & ~F.col("__all")).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h"))).where("__r <= __left")
    return met.where(F.col("__pos") | (~F.col("__pos") & F.col("__all"))).select(df.columns).unionByName(last.select(df.columns))


def label_counts(df: DataFrame, label: str, split_col: str, splits: list[str]) -> DataFrame:
    """Counts of a label in each split, and whether a split's share leaves 7 to 13 percent."""
    wide = df.groupBy(label).pivot(split_col, splits).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(s) for s in splits[1:]), F.col(splits[0]))
    small = [F.col(s) / total for s in splits[1:]]
    odd = F.lit(False)
    for s in small:
        odd = odd | ~s.between(0.07, 0.13)
    return wide.withColumn("total", total).withColumn("imbalanced", odd)


def weak_labels(df: DataFrame, label: str, low: int = 200, middle: int = 500) -> DataFrame:
    n = F.col("n")
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("flag", F.when(n < low, "weak").when(n < middle, "low").otherwise("ok"))


def presence(df: DataFrame, id_col: str, labels: str) -> DataFrame:
    """In how many rows each label occurs, repeats inside a row counted once."""
    return df.select(id_col, F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("df"))


def rarity(df: DataFrame, id_col: str, labels: str, unknown: float = 100.0) -> DataFrame:
    """Each row's sum of inverse label frequencies per thousand rows; labels nobody counted weigh `unknown`."""
    total = df.agg(F.count("*").alias("total"))
    inverse = presence(df, id_col, labels).join(F.broadcast(total)).select("label", (F.col("total") / (F.col("df") * 1000.0)).alias("inv"))
    spread = df.select(id_col, F.explode_outer(F.array_distinct(labels)).alias("label"))
    return spread.join(inverse, "label", "left").groupBy(id_col).agg(F.sum(F.when(F.col("label").isNotNull(), F.coalesce("inv", F.lit(unknown))).otherwise(0.0)).alias("score"))


def first_contexts(df: DataFrame, keys: list[str], order: list[Column], text: Column, n: int = 2) -> DataFrame:
    """Counts of each key with its first n context snippets.

    Counts and first rows are found apart: of a frequent key each task sends one count and n rows.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    ranked = df.withColumn("__t", text).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n)
    firsts = ranked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__t"))), lambda s: s["__t"]), " / ").alias("contexts"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return counts.join(firsts, same).select(*keys, "n", "contexts")


def quota_fill(df: DataFrame, labels: str, key: str, most: int) -> DataFrame:
    """Rows kept in order of a unique key as long as one of their labels is below its quota; then all their labels count.

    Whether a row stays depends on all before it. It is settled in rounds: a row stays if a label is below its
    quota even with all undecided rows before it counted, and goes if every label has its quota from the rows known to
    stay. The first undecided row is always settled, most others with it, until none is left. Counts before a row are
    sums over ranges of the key and a window inside one range, so a frequent label isn't one task.
    """
    bounds = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / 64 for i in range(1, 64)], 0.001)))
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("k"))) if bounds else F.lit(0)
    rows = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(labels)).alias("label")).withColumn("range", place).withColumn("state", F.lit(None).cast("boolean"))
    rows = written(rows)
    while True:
        counted = {"sure": F.coalesce(F.col("state"), F.lit(False)), "open": F.coalesce(F.col("state"), F.lit(True))}
        sums = rows.groupBy("label", "range").agg(*[F.sum(c.cast("long")).alias(n) for n, c in counted.items()])
        whole = Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        sums = sums.select("label", "range", *[F.coalesce(F.sum(n).over(whole), F.lit(0)).alias(f"{n}_before") for n in counted])
        inside = Window.partitionBy("label", "range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        known = rows.join(sums, ["label", "range"])
        for n, c in counted.items():
            known = known.withColumn(n, F.col(f"{n}_before") + F.coalesce(F.sum(c.cast("long")).over(inside), F.lit(0)))
        fate = known.groupBy("k").agg(F.bool_or(F.col("open") < most).alias("stays"), F.bool_and(F.col("sure") >= most).alias("goes"), F.first("state").alias("state"))
        fate = fate.select("k", F.coalesce("state", F.when(F.col("stays"), True).when(F.col("goes"), False)).alias("new"))
        rows = written(rows.join(fate, "k").select("k", "label", "range", F.col("new").alias("state")))
        if rows.where("state is null").isEmpty():
            break
    kept = rows.where("state").select(F.col("k").alias(key)).distinct()
    return df.join(kept, key, "left_semi")


def merge_spans(sources: list[DataFrame]) -> DataFrame:
    """Spans of several sources by id: each (start, end, label) once, from the first source that has it.

    sources: (id, start, end, label), best first.
    """
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("source", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("id", "start", "end", "label").agg(F.min("source").alias("source"))  # type: ignore[union-attr]


def majority(df: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The commonest vote of each key; keys whose votes all came once and differ are left out."""
    counts = df.groupBy(*keys, vote).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), vote))).withColumn("kinds", F.count("*").over(w))
    return ranked.where("r = 1 and not (n = 1 and kinds > 1)").drop("r", "kinds")


def corrections(said: DataFrame, excluded: tuple[str, ...], resolving: str, short: int) -> DataFrame:
    """(label, span, suggestion) from reviewers' rows (label, text, suggestion, reason), by majority.

    A span whose reviewers all differ isn't corrected, nor an excluded one, nor one of at most `short` characters
    without a reason that matches `resolving`. Rows are counted before they meet, so a frequent span is one row a task.
    """
    votes = said.where("suggestion <> label").groupBy("label", F.lower("text").alias("span"), "suggestion").agg(F.count("*").alias("n"), F.bool_or(F.col("reason").rlike(resolving)).alias("resolved"))
    best = votes.groupBy("label", "span").agg(F.max(F.struct("n", "suggestion", "resolved")).alias("b"), F.count("*").alias("ways"))
    kept = best.where(~((F.col("ways") > 1) & (F.col("b.n") == 1)) & ~F.col("span").isin(*excluded) & ((F.length("span") > short) | F.col("b.resolved")))
    return kept.select("label", "span", "b.suggestion")


def correct(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with new_label and corrected, by a table of (label, span, suggestion)."""
    known = table.select(F.col("label").alias("c_label"), "span", "suggestion")
    joined = rows.join(known, (F.col("label") == F.col("c_label")) & (F.lower("text") == F.col("span")), "left")
    return joined.select(*rows.columns, F.coalesce("suggestion", "label").alias("new_label"), F.col("span").isNotNull().alias("corrected"))
