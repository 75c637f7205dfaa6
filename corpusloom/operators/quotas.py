"""Splits under quotas that rows with several labels share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .corpus import hash_key, presence, rarity
from .ordering import placed


def rare_quota_split(rows: DataFrame, id_col: str, labels: str, rare: int, quota: int, val_size: int, test_size: int, seed: int) -> DataFrame:
    """(id, split) with train, val and test: rare labels first get their quota in val and test, then both are filled up.

    Rare are labels in fewer than `rare` rows. In the order of their counts, then names, each takes of its rows that no
    label before has taken, the rarest rows first (sums of inverse frequencies to six places, then id): the quota, a third
    of its rows at most, into val, then as many into test. What is left of the sizes is filled in the order of a seeded
    digest of the id; sizes that quotas have used up already get no more. A row without labels is only ever filled in;
    ids are unique; no row, no result.

    A label can take no more than its own share and the shares of the labels before it, so only so many of its rows are
    candidates: their number depends on the quota and the rare labels, not on the rows. Each round, all labels choose at
    once among the rows that no earlier label held in the round before; the first label's choice is final after one
    round, and each round settles one more at least, so the rounds end at the sequential outcome.
    """
    rows = written(rows.select(id_col, F.array_distinct(labels).alias("labels")))
    counts = presence(rows, id_col, "labels").where(F.col("df") < rare)
    known = counts.orderBy("df", "label").collect()  # a row a rare label
    table = [(r.label, i, min(quota, r.df // 3)) for i, r in enumerate(known)]
    order = rows.sparkSession.createDataFrame(table, "label string, k int, share long")
    limit = 2 * sum(share for _, _, share in table)
    scored = rarity(rows, id_col, "labels").select(F.col(id_col).alias("__id"), F.round("score", 6).alias("score"))
    listed = rows.select(F.col(id_col).alias("id"), F.explode("labels").alias("label")).join(F.broadcast(order), "label").join(scored, F.col("id") == F.col("__id")).drop("__id")
    best = Window.partitionBy("k").orderBy(F.desc("score"), "id")
    candidates = written(listed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).drop("r", "label"))
    holder = written(candidates.select("id", F.lit(None).cast("int").alias("by")).limit(0))
    mark = None
    while True:
        free = candidates.join(holder, "id", "left").where(F.col("by").isNull() | (F.col("by") >= F.col("k"))).drop("by")
        chosen = free.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * F.col("share"))
        holder = written(chosen.groupBy("id").agg(F.min("k").alias("by"), F.min_by(F.col("r") <= F.col("share"), "k").alias("to_val")))
        now = holder.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "by", "to_val"))).first()
        if now == mark:
            break
        mark = now
    taken = holder.select(F.col("id").alias(id_col), F.when(F.col("to_val"), "val").otherwise("test").alias("split"))
    there = {r["split"]: r["count"] for r in taken.groupBy("split").count().collect()}
    need_val, need_test = max(0, val_size - there.get("val", 0)), max(0, test_size - there.get("test", 0))
    rest = placed(rows.select(id_col).join(taken, id_col, "left_anti").withColumn("__key", hash_key(seed, id_col)), [F.col("__key"), F.col(id_col)])
    filled = F.when(F.col("place") < need_val, "val").when(F.col("place") < need_val + need_test, "test").otherwise("train")
    return taken.union(rest.select(id_col, filled.alias("split")))
