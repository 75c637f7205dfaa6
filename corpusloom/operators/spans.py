"""Span algebra: overlaps, interval joins inside a sentence, greedy suppression, expansions, negatives.

A span table has doc_id, sent_id, tok, n (tokens), start, end (half-open), text, score, coarse, fine. All joins go by the
sentence key first, so that an interval join is a hash or merge join with a residual condition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W

KEY = ["doc_id", "sent_id"]


def tokens(sentences: DataFrame) -> DataFrame:
    """(key, tok, word, end, start): a sentence's words and where they are if they are joined by one space. They are made where the sentence lies, by batches of sentences."""
    listed = F.arrow_udf(lambda text: W.tokens(text), W.TOKEN)
    return sentences.select(*KEY, F.inline(listed("text"))).withColumn("start", F.col("end") - F.length("word"))


def runs(sentences: DataFrame, most: int, wanted: Callable[..., np.ndarray], given: str | None = None, text: bool = True, line: str | None = None) -> DataFrame:
    """ngrams of (doc_id, sent_id, text), only those for whose first token and length `wanted` holds. They are made from a sentence's own words, so nothing is shuffled.

    wanted takes arrays: wanted(tok, n), or wanted(tok, n, value) with the sentence's value of the column `given` (null: no runs). text: whether rows have their words.
    line: a column that only a row of no words (n 0) of each sentence, before its runs, has.
    """
    kind = W.RUN if text else W.PLACE
    if given:
        listed = F.arrow_udf(lambda texts, value: W.runs(texts, most, wanted, value, text), kind)("text", given)
    else:
        listed = F.arrow_udf(lambda texts: W.runs(texts, most, wanted, None, text), kind)("text")
    if line is None:
        return sentences.select(*KEY, F.inline(listed))
    first = F.array(F.struct(F.lit(0).alias("tok"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), *([F.lit(None).cast("string").alias("text")] if text else [])))
    return sentences.select(*KEY, line, F.inline(F.concat(first, listed))).withColumn(line, F.when(F.col("n") == 0, F.col(line)))


def ngrams(toks: DataFrame, most: int) -> DataFrame:
    """All runs of 1 to `most` tokens: (doc_id, sent_id, tok, n, start, end, text). Each length is one look ahead in the same sorted window."""
    w = Window.partitionBy(*KEY).orderBy("tok")
    cols = {}
    for n in range(1, most + 1):
        cols[f"end{n}"] = F.lead("end", n - 1).over(w)
        cols[f"text{n}"] = F.array_join(F.collect_list("word").over(w.rowsBetween(0, n - 1)), " ")
    ahead = [F.struct(F.lit(n).alias("n"), F.col(f"end{n}").alias("end"), F.col(f"text{n}").alias("text")) for n in range(1, most + 1)]
    rows = toks.withColumns(cols).select(*KEY, "tok", "start", F.explode(F.array(*ahead)).alias("s"))
    return rows.select(*KEY, "tok", "s.n", "start", "s.end", "s.text").where("end is not null")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared length over joint length."""
    shared = overlap(a_start, a_end, b_start, b_end)
    joint = (a_end - a_start) + (b_end - b_start) - shared
    return F.when(joint > 0, shared / joint).otherwise(0.0)


def struct_overlap(a: Column, b: Column) -> Column:
    return overlap(a["start"], a["end"], b["start"], b["end"])


def struct_iou(a: Column, b: Column) -> Column:
    return iou(a["start"], a["end"], b["start"], b["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"])


Clash = Callable[[Column, Column], Column]


def islands(spans: DataFrame, group: list[str]) -> DataFrame:
    """spans with island: a number that overlapping spans of a group share, through others too. What meets in a fold is in one island."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    return spans.withColumn("__new", begins).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def greedy(spans: DataFrame, order: list[tuple[str, bool]], clash: Clash, group: list[str] | None = None) -> DataFrame:
    """Spans kept by going through each sentence's in order (column, descending) and dropping those that clash with a kept one.

    Only spans that overlap may clash, so the fold, one expression over sorted spans, goes over an island of overlapping
    spans at a time; a long sentence is many small folds.
    """
    group = group or KEY
    rest = [c for c in spans.columns if c not in group]
    keys = [(-F.col(c) if down else F.col(c)).alias(f"__o{i}") for i, (c, down) in enumerate(order)]
    packed = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*rest).alias("s"))))
    listed = islands(spans, group).groupBy(*group, "island").agg(packed.alias("all"))
    kept = F.aggregate(
        F.transform("all", lambda x: x["s"]),
        F.transform(F.filter("all", lambda x: F.lit(False)), lambda x: x["s"]),
        lambda acc, c: F.when(F.exists(acc, lambda k: clash(k, c)), acc).otherwise(F.concat(acc, F.array(c))),
    )
    return listed.select(*group, F.explode(kept).alias("s")).select(*group, "s.*")


def compound_children(spans: DataFrame) -> DataFrame:
    """Compound suppression, longest first: a span inside a kept one is its child if their fine labels differ, else dropped; one that overlaps by half is dropped. Adds parent: start of the containing span, or null."""
    rest = [c for c in spans.columns if c not in KEY]
    packed = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("o0"), (-F.col("score")).alias("o1"), F.col("start").alias("o2"), F.struct(*rest, F.lit(None).cast("long").alias("parent")).alias("s"))))
    listed = islands(spans, KEY).groupBy(*KEY, "island").agg(packed.alias("all"))

    def step(acc: Column, c: Column) -> Column:
        parents = F.filter(acc, lambda k: k["parent"].isNull())
        around = F.filter(parents, lambda k: contains(k, c))
        child = F.struct(*[c[r].alias(r) for r in rest], F.get(around, F.lit(0))["start"].cast("long").alias("parent"))
        return (
            F.when((F.size(around) > 0) & (F.get(around, F.lit(0))["fine"] != c["fine"]), F.concat(acc, F.array(child)))
            .when(F.size(around) > 0, acc)
            .when(F.exists(parents, lambda k: struct_iou(k, c) >= 0.5), acc)
            .otherwise(F.concat(acc, F.array(c)))
        )

    all_spans = F.transform("all", lambda x: x["s"])
    kept = F.aggregate(all_spans, F.filter(all_spans, lambda x: F.lit(False)), step)
    return listed.select(*KEY, F.explode(kept).alias("s")).select(*KEY, "s.*")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*KEY, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in KEY])


def pairs(left: DataFrame, right: DataFrame, how: str = "inner", on: Column | None = None) -> DataFrame:
    """Overlapping spans of one sentence: left columns as a_*, right ones as b_*. A `left` join keeps lone left spans."""
    a, b = prefixed(left, "a_"), prefixed(right, "b_")
    key = [a[k] == b[k] for k in KEY]
    condition = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    joined = a.join(b, [*key, condition if on is None else on], how)
    return joined.select(*[a[k] for k in KEY], *[c for c in joined.columns if c not in KEY]) if how not in ("left_semi", "left_anti") else joined


def best_match(left: DataFrame, right: DataFrame, weight: Column, carry: list[str], on: Column | None = None) -> DataFrame:
    """Each left span with the overlapping right one of the greatest weight (of equals the first by start), or nulls."""
    hits = pairs(left, right, "left", on).withColumn("w", weight)
    names = [c for c in hits.columns if c.startswith("a_")]
    top = F.max_by(F.struct(*carry, "w"), F.struct("w", -F.col("b_start"), -F.col("b_end"))).alias("m")
    return hits.groupBy(*KEY, *names).agg(top).select(*KEY, *names, "m.*")


def not_overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left spans that no right span of their sentence overlaps."""
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in KEY], F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    same = [F.col(k) == F.col(f"r_{k}") for k in KEY]
    return left.join(r, [*same, F.col("start") < F.col("r_end"), F.col("r_start") < F.col("end")], "left_anti")


def smallest_container(spans: DataFrame) -> DataFrame:
    """Each span with the shortest span that strictly contains it: adds parent_start and parent_end."""
    on = (F.col("b_start") <= F.col("a_start")) & (F.col("b_end") >= F.col("a_end")) & ((F.col("b_end") - F.col("b_start")) > (F.col("a_end") - F.col("a_start")))
    hits = pairs(spans, spans.select(*KEY, "start", "end"), "left", on)
    names = [c for c in hits.columns if c.startswith("a_")]
    least = F.min_by(F.struct("b_start", "b_end"), F.struct(F.col("b_end") - F.col("b_start"), "b_start")).alias("p")
    return hits.groupBy(*KEY, *names).agg(least).select(*KEY, *[F.col(n).alias(n[2:]) for n in names], F.col("p.b_start").alias("parent_start"), F.col("p.b_end").alias("parent_end"))


def cover_tokens(spans: DataFrame, toks: DataFrame, strict: bool = False) -> DataFrame:
    """First and last token of each span; strict: only tokens that lie inside it."""
    t = toks.select(*KEY, "tok", F.col("start"), F.col("end"))
    on = (F.col("b_start") >= F.col("a_start")) & (F.col("b_end") <= F.col("a_end")) if strict else None
    hits = pairs(spans.select(*KEY, "start", "end"), t, "left", on)
    return hits.groupBy(*KEY, "a_start", "a_end").agg(F.min("b_tok").alias("first_tok"), F.max("b_tok").alias("last_tok")).withColumnsRenamed({"a_start": "start", "a_end": "end"})


def merge_adjacent(spans: DataFrame, text_gap: int = 1) -> DataFrame:
    """Islands of consecutive spans of one coarse type with at most `text_gap` characters between; never persons. Score: the least."""
    w = Window.partitionBy(*KEY, "coarse").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - reach > text_gap) | (F.col("coarse") == "PER"), F.lit(True))
    marked = spans.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*KEY, "coarse", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score"), F.count("*").alias("parts")).drop("island")


def boundary_negatives(spans: DataFrame, toks: DataFrame, reach: int = 2) -> DataFrame:
    """Spans whose bounds differ from a gold one's by up to `reach` tokens each and that still overlap it: (…, tok, last, d_first, d_last, iou of tokens)."""
    sizes = toks.groupBy(*KEY).agg((F.max("tok") + 1).alias("size"))
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1)])
    grid = spans.select(*KEY, "tok", "n").join(sizes, KEY).withColumn("d_first", F.explode(steps)).withColumn("d_last", F.explode(steps))
    first, last = F.col("tok") + F.col("d_first"), F.col("tok") + F.col("n") - 1 + F.col("d_last")
    moved = grid.withColumn("first", first).withColumn("last", last).where("first >= 0 and last < size and last >= first and not (d_first = 0 and d_last = 0)")
    return moved.withColumn("iou", iou(F.col("first"), F.col("last") + 1, F.col("tok"), F.col("tok") + F.col("n"))).where("iou > 0").drop("size")


def enclosing_negatives(spans: DataFrame, toks: DataFrame, least: int = 2, most: int = 8, longest: int = 10) -> DataFrame:
    """Spans that widen a gold one by `least` to `most` tokens in all, up to 4 on a side, no longer than `longest`; weight 1.5."""
    sizes = toks.groupBy(*KEY).agg((F.max("tok") + 1).alias("size"))
    steps = F.array(*[F.lit(d) for d in range(5)])
    grid = spans.select(*KEY, "tok", "n").join(sizes, KEY).withColumn("left", F.explode(steps)).withColumn("right", F.explode(steps))
    wide = grid.withColumn("first", F.col("tok") - F.col("left")).withColumn("last", F.col("tok") + F.col("n") - 1 + F.col("right"))
    ok = (F.col("left") + F.col("right")).between(least, most) & (F.col("first") >= 0) & (F.col("last") < F.col("size")) & (F.col("last") - F.col("first") + 1 <= longest)
    return wide.where(ok).select(*KEY, "tok", "n", "first", "last", F.lit(1.5).alias("weight"))


def adjacent_pairs(spans: DataFrame, most: int = 5) -> DataFrame:
    """Consecutive gold spans with a gap of 0 to `most` characters, as one over both; weight 2."""
    w = Window.partitionBy(*KEY).orderBy("start", "end")
    rows = spans.withColumn("next_start", F.lead("start").over(w)).withColumn("next_end", F.lead("end").over(w))
    return rows.where((F.col("next_start") - F.col("end")).between(0, most)).select(*KEY, "start", F.col("next_end").alias("end"), F.lit(2.0).alias("weight"))
