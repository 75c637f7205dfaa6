"""Places in an order, without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place from 0 in the order of some columns; rows that are equal in them come in any order.

    Rows are dealt by ranges and sorted there; a place is the rows of the ranges before and the place inside the range.
    Only one count a range meets in one task.
    """
    laid = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    laid = laid.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return laid.join(F.broadcast(ranges), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__id", "__range", "__at", "__before")


def placed_in(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """The same inside each group: a place in the whole order less that of the group's first row. A group may hold most rows."""
    rows = written(placed(df, [F.asc_nulls_first(group), *order], name))
    first = rows.groupBy(group).agg(F.min(name).alias("__first")).withColumnRenamed(group, "__group")
    return rows.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col(name) - F.col("__first")).drop("__first", "__group")
