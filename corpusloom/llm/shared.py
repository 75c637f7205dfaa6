"""Helpers that several operators use."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import slices


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, a local one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return str(context.getCheckpointDir())


#: Whether a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder, so that a lost executor doesn't mean its whole history again.

    What was shuffled to make it isn't read again and leaves the executors' disks.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


#: Rows, and items of an array column, up to which a table of a few numbers a row counts as small: some 5 MB.
SMALL = 100_000


def settled(df: DataFrame, items: str | None = None) -> DataFrame:
    """cut_lineage, and a table that is counted to be small in one partition, to be broadcast where it is joined.

    For narrow tables of rounds that get small: what is then grouped or joined isn't shuffled. It changes how rows lie,
    not which there are. items: an array column, whose items count as rows do.
    """
    done = cut_lineage(df)
    held = done.count() if items is None else done.agg(F.coalesce(F.sum(1 + F.greatest(F.size(items), F.lit(0)).cast("long")), F.lit(0))).first()[0]
    return cut_lineage(done.coalesce(1)).hint("broadcast") if held <= SMALL else done


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order of some columns; rows that are equal in them come in any order.

    Rows are dealt by ranges of the order and sorted there, so that no task sees them all; a place is what stands in the
    ranges before plus the place inside the range. Only one count a range is summed up in one task.
    """
    laid = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    laid = laid.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return laid.join(F.broadcast(sums), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__id", "__part", "__at", "__before")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves remainder 1 by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sampled(rows: DataFrame, most: int, seed: int, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Of the rows of each group (all as one, without `by`), those with the least hashes of the key: `most` of them, or all there are.

    Counts tell about where the hash of the row in place `most` lies; what is well above leaves in the scan, so that only
    some rows more than wanted are ever ranked. The share that stays is a double, and so never rounds to nothing. Which
    of exactly repeated rows is taken makes no difference.
    """
    place = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 2).cast("double") / float(1 << 62)
    by = by or []
    sizes = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*by).count().collect()}  # one row a label
    share = F.lit(0.0)
    for group, n in sizes.items():
        wide = 1.0 if n <= most else min(1.0, (1.2 * most + 40) / n)  # some rows too many, to be ranked
        same = F.lit(True)
        for c, v in zip(by, group, strict=True):
            same &= F.col(c).eqNullSafe(F.lit(v))
        share = F.when(same, wide).otherwise(share)
    near = rows.withColumn("__place", place).where(F.col("__place") <= share)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__place", *key))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__place", "__rank")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for the nodes of (a, b) edges, by large-star and small-star rounds.

    Every round is a join and a minimum over (node, neighbour) rows; no component is gathered anywhere.
    """
    spark: SparkSession = edges.sparkSession
    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        single = now.rdd.getNumPartitions() == 1
        together = (lambda df: df.coalesce(1)) if single else (lambda df: df)
        both = together(both)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        small = together(small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a > b")).distinct()
        now = settled(small)
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.union(roots) if mark and mark[0] else spark.createDataFrame([], "node long, component long")


#: What a Python worker that is used again lets go of when another operator's work begins in it.
RELEASE: list[Callable[[], None]] = []


def released() -> None:
    while RELEASE:
        RELEASE.pop()()
    trimmed()


def trimmed() -> None:
    """Gives memory that is free, but still held for later, back to the system: a worker may wait long, or serve another operator, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(df: DataFrame, prepare: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], added: dict[str, str]) -> DataFrame:
    """df with columns computed from Arrow batches, cut to a bounded size by their text column.

    Columns of df that have an added name, in whatever case, give way. prepare runs once a task.
    """
    kept = [f for f in df.schema if f.name.lower() not in {a.lower() for a in added}]
    plain = df.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{k}` {v}" for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        work = prepare()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], [*part.schema.names, *added])
            trimmed()

    return plain.mapInArrow(run, schema)
