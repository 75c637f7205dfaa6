"""Retrieval dataflow: chunk, embed, search, hydrate, filter, merge, rerank, answer. Order is a column, never implied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import ann as A


def chunk(documents: DataFrame, keep: str = "doc_id") -> DataFrame:
    """(keep, pos, id, text): non-blank pieces between full stops. pos counts blank ones too."""
    parts = documents.select(keep, F.posexplode(F.split("text", r"\.")).alias("pos", "text")).withColumn("text", T.trim(F.col("text")))
    return parts.where("text <> ''").select(keep, "pos", F.concat_ws("_", F.col(keep), F.lit("sent"), "pos").alias("id"), "text")


def filter_refs(df: DataFrame, refs: list[Column]) -> DataFrame:
    """Named filters, applied in order; Catalyst merges them."""
    return reduce(lambda d, f: d.where(f), refs, df)


def long_enough(least: int = 3) -> Column:
    return F.length("text") >= least


def metadata_filter(conditions: dict[str, object]) -> Column:
    """Equality on strings, integers and booleans; floats by range; anything else by its string. All must hold."""
    tests = []
    for name, value in conditions.items():
        if isinstance(value, float):
            tests.append((F.col(name) >= value) & (F.col(name) <= value))
        elif isinstance(value, bool | int | str):
            tests.append(F.col(name) == value)
        else:
            tests.append(F.col(name).cast("string") == str(value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def top_k(vectors: DataFrame, query: list[float] | None, k: int, id_col: str, vector_col: str, where: Column | None = None) -> DataFrame:
    """The k nearest rows by cosine, filtered before ranking: (id, score). Ties go to the smaller id."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query or []])
    return rows.select(id_col, V.cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def top_k_batched(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, id_col: str, vector_col: str) -> DataFrame:
    """The k nearest rows (by cosine, to nine places) of each query row: (query id, id, score, rank).

    Both sides are dealt in blocks of a fixed size; each pair of blocks is one group, which keeps its k best of a query.
    So no task holds more than two blocks, nothing passes the driver but two counts, and what is ranked is k rows a query
    and block. Rows without a vector are left out.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    row_blocks, query_blocks = max(1, -(-rows.count() // A.ROW_BLOCK)), max(1, -(-asked.count() // A.QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("row_block"), every(query_blocks).alias("query_block"))
    right = asked.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("query_block"), every(row_blocks).alias("row_block"))
    keys = ["row_block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(A.compared(None, None, k, True), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def hydrate(ids: DataFrame, documents: DataFrame, id_col: str, position: str) -> DataFrame:
    """Documents of an id list, in its order; ids without a document are dropped."""
    return ids.join(documents, id_col).orderBy(position)


def merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union without repeated keys: the left side's row wins, then the earlier one. Both need a `pos`."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    order = Window.partitionBy(key).orderBy("side", "pos")
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def rerank_by_length(docs: DataFrame, k: int, position: str = "pos") -> DataFrame:
    """The k longest texts; of equals, the earlier."""
    return docs.withColumn("score", F.length("text").cast("double")).orderBy(F.desc("score"), position).limit(k)


def rerank(docs: DataFrame, scorer: Column, k: int, position: str = "pos") -> DataFrame:
    """Top k by any scorer column; a missing score counts as minus infinity."""
    return docs.withColumn("score", F.coalesce(scorer, F.lit(float("-inf")))).orderBy(F.desc("score"), position).limit(k)


def answer(docs: DataFrame, question: str) -> DataFrame:
    """One row: the question and its first context, or that there is none."""
    best = docs.agg(F.min_by("text", F.struct(-F.col("score"), F.col("pos"))).alias("context"))
    return best.select(T.answer(F.lit(question), F.col("context")).alias("answer"))


def hydrate_elements(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Elements of a document joined in order under their parent, or alone."""
    group = F.coalesce("parent_id", "element_id")
    parts = F.array_sort(F.collect_list(F.struct("element_index", "text")))
    return elements.groupBy(*keys, group.alias("unit_id")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count("*").alias("n_elements"))


def hydrate_units(elements: DataFrame, ids: DataFrame, unit: str, keys: tuple[str, str] = ("doc_id", "element_index")) -> DataFrame:
    """(doc_id, unit_id, pos, text, n_elements) of the documents in an id list, by unit.

    elements: doc_id, element_index, element_id, parent_id, text, is_sentence. SENTENCE: each sentence, in order;
    DOCUMENT: all elements of a document as one text; any other: elements joined under their parent, or alone. Ids that
    have no element give no row, and repeated ones give theirs once. Texts are joined by line breaks, in order.
    """
    doc, index = keys
    wanted = elements.join(ids.select(doc).distinct(), doc, "left_semi")
    if unit == "SENTENCE":
        order = Window.partitionBy(doc).orderBy(index)
        return wanted.where("is_sentence").select(doc, F.col("element_id").cast("string").alias("unit_id"), F.row_number().over(order).cast("long").alias("pos"), "text", F.lit(1).cast("long").alias("n_elements"))
    group = F.lit("document") if unit == "DOCUMENT" else F.coalesce("parent_id", "element_id").cast("string")
    parts = F.array_sort(F.collect_list(F.struct(index, "text")))
    return wanted.groupBy(doc, group.alias("unit_id")).agg(F.min(index).cast("long").alias("pos"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count("*").alias("n_elements")).select(doc, "unit_id", "pos", "text", "n_elements")


def mean_vectors(df: DataFrame, group: str, vector_col: str) -> DataFrame:
    """Mean vector of each group, one row a dimension: (group, pos, mean)."""
    return df.select(group, F.posexplode(vector_col).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
