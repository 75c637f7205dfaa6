"""All registered queries of the library and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from . import queries as themes
from .registry import ORACLES, QUERIES, Query

for _module in pkgutil.iter_modules(themes.__path__):
    importlib.import_module(f"{themes.__name__}.{_module.name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rag_pipeline"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
