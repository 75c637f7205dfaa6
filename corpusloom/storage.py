"""Where tables that a query writes and reads again are put."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; in local mode, where that is unset, a local one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share, so that its history isn't needed again.

    It is written by column and compressed: rows of tokens take a tenth of what checkpoints of them do. Files are small
    beside the rows in them, so that joins go by sorting and don't take their size for the table's.
    """
    path = scratch(df.sparkSession, "written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
