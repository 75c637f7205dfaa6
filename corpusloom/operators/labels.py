"""Labels mapped to known ones: as they are, by case, or by the longest matching blocks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Least share of characters in matching blocks.
CUTOFF = 0.6


def _signs(label: Column) -> Column:
    """A label's characters, each with its number among equal ones, in a fixed order."""
    chars = F.split(label, "")
    return F.array_sort(F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string"))))


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said, known = batch.column("label").to_pylist(), batch.column("known").to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([SequenceMatcher(None, k, s).ratio() for s, k in zip(said, known, strict=True)], pa.float64())], ["label", "known", "ratio"])


def close_labels(said: DataFrame, known: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(label, known, ratio): pairs whose matching blocks make up at least `cutoff` of their characters. Both sides: distinct, not empty labels.

    Blocks can't match more characters than both labels have, so a pair needs o = cutoff * (n + m) / 2 common ones, each
    occurrence counted, and neither label may be much shorter. Of the characters in one order, then, the first n - o + 1
    of one label and m - o + 1 of the other have one in common, with o taken at the shortest partner there can be. Labels
    meet only through such a character; what is left is compared by its blocks.
    """
    def heads(side: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        shortest = F.ceil(F.round(n * cutoff / (2 - cutoff), 9))
        need = F.ceil(F.round((n + shortest) * cutoff / 2, 9))
        rows = side.select(F.col("label").alias(name)).where(n > 0).withColumn(f"{name}_signs", _signs(F.col(name)))
        return rows.withColumn("sign", F.explode(F.slice(f"{name}_signs", F.lit(1), F.greatest(F.lit(1), n - need + 1).cast("int"))))

    met = heads(said, "label").join(heads(known, "known"), "sign").select("label", "known", "label_signs", "known_signs").distinct()
    both = F.length("label") + F.length("known")
    common = F.size(F.array_intersect("label_signs", "known_signs"))
    able = met.where(2 * common >= F.round(both * cutoff, 9) - 1e-9)
    return able.select("label", "known").mapInArrow(_ratios, "label string, known string, ratio double").where(F.col("ratio") >= cutoff)


def map_labels(said: DataFrame, known: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(label, mapped, how) of distinct labels: same, case (the first known one by `place` but for case), close, or kept as it is.

    known: label, place. Of equally close ones the last by name is taken. A null label stays null.
    """
    said = written(said.select("label").distinct())
    same = known.select(F.col("label").alias("k")).distinct()
    cased = known.groupBy(F.lower("label").alias("low")).agg(F.min_by("label", "place").alias("c"))
    rows = said.join(same, F.col("label") == F.col("k"), "left").join(cased, F.lower("label") == F.col("low"), "left")
    left = rows.where("k IS NULL AND c IS NULL AND label IS NOT NULL").select("label")
    best = close_labels(left, same.withColumnRenamed("k", "label"), cutoff).groupBy(F.col("label").alias("l")).agg(F.max(F.struct("ratio", "known"))["known"].alias("near"))
    rows = rows.join(best, F.col("label") == F.col("l"), "left")
    how = F.when(F.col("k").isNotNull(), "same").when(F.col("c").isNotNull(), "case").when(F.col("near").isNotNull(), "close").otherwise("kept")
    return rows.select("label", F.coalesce("k", "c", "near", "label").alias("mapped"), how.alias("how"))
