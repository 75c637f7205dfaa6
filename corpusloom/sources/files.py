"""Files: JSON lines in three error modes, JSON arrays, folders of unknown encoding, token-per-line sentences, wiki dumps, and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import words as W
from ..operators.ordering import placed_in
from ..storage import written

Schema = StructType | str


def read_jsonl(spark: SparkSession, path: str, schema: Schema, errors: str = "fail") -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. errors: `fail` on a malformed line, or `drop` it."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[errors]
    return spark.read.schema(schema).json(path, mode=mode)


def read_jsonl_reported(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """All lines that aren't blank, as file, line (from 1, in its file), row (null if malformed) and raw (the malformed text).

    Lines are numbered by ranges of their places, so a large file is many tasks' work.
    """
    lines = written(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"))
    numbered = placed_in(lines, "file", [F.col("block"), F.col("at")]).withColumn("line", F.col("place") + 1).where(F.trim("value") != "")
    plain = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_json("value", f"{plain}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return numbered.withColumn("row", parsed).select("file", "line", F.when(~bad, F.col("row").dropFields("_bad")).alias("row"), F.when(bad, F.col("value")).alias("raw"))


def read_json_rows(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Rows of files that hold either one JSON array or JSON lines, told apart by the first sign of each file.

    Lines are read as lines, so a large file is split; an array is parsed as a stream of its items. A malformed line is a
    row of nulls.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value")).where("value <> ''")
    arrays = written(lines.groupBy("file").agg(F.min_by(F.substring("value", 1, 1), F.struct("block", "at")).alias("sign")).where("sign = '['").select("file"))  # names of files only
    rows = lines.join(arrays, "file", "left_anti").select(F.from_json("value", kind).alias("row")).select("row.*")
    items = spark.read.schema(kind).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.unionByName(items.join(arrays, "file", "left_semi").drop("file"))


def read_decoded(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file, line) of text files that are UTF-8 or, where any line of theirs isn't valid, ISO-8859-1; blank lines go.

    Lines come as their bytes, and a file's encoding is told by all of them, so files of any size are split between tasks.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    valid = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    text = F.when(F.col("valid"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return lines.join(valid, "file").select("file", text.alias("line")).where(F.trim("line") != "")


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(words, labels) of sentences that blank lines part; a line's first column is the word, its last the label. A record is a sentence, so files are split between tasks."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return blocks.select(F.inline(F.arrow_udf(lambda value: W.cells(value), W.LABELLED)("value")))


def write_conll(sentences: DataFrame, path: str, compression: str = "none") -> None:
    """Writes (words, labels) one token a line, with blank lines between sentences. Compressed files (`gzip`) aren't split when they are read; there is one a task."""
    lines = F.zip_with("words", "labels", lambda w, t: F.concat_ws("\t", w, t))
    sentences.select(F.array_join(lines, "\n").alias("value")).write.option("lineSep", "\n\n").text(path, compression=compression)


def read_wiki_dump(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(title, body) of a dump's articles: no special pages, no redirects, bodies longer than `least`. Compressed dumps are read as they are."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, text string").load(path)
    special = F.col("title").contains(":")
    redirect = F.lower(F.trim("text")).startswith("#redirect")
    return pages.where(~special & ~redirect & (F.length("text") > least)).select("title", F.col("text").alias("body"))


def write_views(rows: DataFrame, path: str, views: dict[str, list[str]]) -> None:
    """Writes some projections of one table as JSON lines, each to its own folder; the table is computed once."""
    rows = rows.persist()
    try:
        for name, columns in views.items():
            rows.select(*columns).write.json(f"{path}/{name}")
    finally:
        rows.unpersist()


def write_versioned(rows: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the former ones, which stay; fails if it is there already."""
    place = f"{path}/version={version}"
    rows.write.mode("error").parquet(place)
    return place


def save_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Writes a model's weights, thresholds or settings as one JSON row."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


#: Fields of a record that a dataset keeps.
RECORD_FIELDS = ("id", "text", "spans")


def write_records(rows: DataFrame, path: str, keep: tuple[str, ...] = RECORD_FIELDS) -> None:
    """Writes rows as JSON lines with only the fields that a dataset keeps, in that order; a field that rows haven't stays out, as nulls do."""
    rows.select(*[c for c in keep if c in rows.columns]).write.json(path)
