"""Makes the library importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Ships this package to the session's executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="corpusloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(place, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    context.addPyFile(str(place))
    _DONE.add(context.applicationId)
