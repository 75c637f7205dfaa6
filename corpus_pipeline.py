"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.jaccard import first_of_each
from corpusloom.llm.language import UNKNOWN, fit, identify
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.secrets import redact_secrets
from corpusloom.llm.shared import held_out, shared_folder
from corpusloom.llm.wumanber import find_benchmark

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], kept: Column) -> DataFrame:
    """Rows of docs, with the table's own columns, that an operator's answer keeps: columns named like its answers stand aside meanwhile."""
    aside = {c: c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)}
    found = judge(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in aside.items()]))
    return found.where(kept).select(*[F.col(f"`{k}`").alias(c) for c, k in aside.items()])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised with a calibrated probability of one half at least; a null text, or one without letters, goes."""
    model = fit(docs, ~held_out(F.col("doc_id")))
    return _judged(docs, lambda rows: identify(rows, model), (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id; rows without an id or words stay."""
    return first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item stands; null and wordless texts are clean."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _judged(docs, lambda rows: find_benchmark(rows, items), F.size("hit_words") == 0)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with secrets in their texts replaced; null texts stay null, and n_chars is that of the new text."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in training sequences; a null text is one closing token. Columns other than doc_id and text play no part."""
    return pack_documents(docs, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what is between them is written to the folder that executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs


#: Language identification can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
