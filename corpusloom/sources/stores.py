"""Keyed stores as tables: upserts, deletes, uniqueness, and documents mapped to records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Both tables' rows, of each key only that with the greatest `order`, and of equals the new one. A key's rows meet as one aggregate, so no window sorts them."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, "__new")).alias("r"))
    return latest.select(*[F.col(k) if k in key else F.col(f"r.{k}").alias(k) for k in stored.columns])


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without rows whose key is listed."""
    return stored.join(keys.distinct(), keys.columns, "left_anti")


def duplicates(stored: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, which a unique index would refuse."""
    return stored.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def without_nulls(metadata: Column) -> Column:
    """A map without entries whose value is null."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def sentence_records(documents: DataFrame) -> DataFrame:
    """Records of documents of type SENTENCE, which are the only ones stored: (docId, sentenceId, text, spanStart, spanEnd, isContent)."""
    of = documents.where("type = 'SENTENCE'")
    content = F.coalesce(F.try_element_at("metadata", F.lit("isContent")) == "true", F.lit(True))
    return of.select(F.coalesce("parent_id", "id").alias("docId"), F.col("id").alias("sentenceId"), "text", F.col("span.start").alias("spanStart"), F.col("span.end").alias("spanEnd"), content.alias("isContent"))


def element_records(documents: DataFrame) -> DataFrame:
    """One record an element of a document: (docId, elementIndex, type, text, page, parentId), page and parent from the element, else from the document."""
    rows = documents.select(F.col("id").alias("docId"), F.col("page").alias("doc_page"), F.posexplode("elements").alias("elementIndex", "e"))
    return rows.select("docId", "elementIndex", F.col("e.type").alias("type"), F.col("e.text").alias("text"), F.coalesce("e.page", "doc_page").alias("page"), F.coalesce("e.parent", "docId").alias("parentId"))


def payload(value: Column, kind: str) -> Column:
    """A payload value as stores take it: strings, longs, doubles and booleans as they are, all others as their text."""
    return value if kind in ("string", "bigint", "double", "boolean") else value.cast("string")
