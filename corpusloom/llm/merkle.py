"""Merkle manifest of a table: a hash tree over each group's rows and one over the groups, kept as a node store.

Leaves get their places in a range-partitioned sort, so a group that holds most rows is many tasks' work. A level is
written as Parquet, one row a run of up to 16 sibling nodes; the next level reads what the one before has written, so
that memory holds a run and a lost executor costs one level at most. Proofs go down from the root: a run passes on to
each of its nodes what stands beside the path above, joined by (group, run). So the work above the leaves is one
sixteenth of the leaves', and no join key has more than 16 rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut_lineage, numbered, shared_folder

#: Siblings of a run.
ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, as lowercase hex, of fields told apart by their lengths: a dash for null, else the UTF-8 byte count, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """A node store: `folder`/tree=0 has the groups' trees and tree=1 the tree of their roots, each by level; heights are the numbers of levels."""

    spark: SparkSession
    folder: str
    heights: tuple[int, int]

    def level(self, tree: int, level: int) -> DataFrame:
        """Runs of a level: grp, n (nodes of the group on this level), run, nodes in order, parent (their digest)."""
        return self.spark.read.parquet(f"{self.folder}/tree={tree}/level={level}")

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/leaves")


def _grow(nodes: DataFrame, folder: str, tree: int) -> tuple[int, list[DataFrame]]:
    """Writes the levels over nodes (grp, n, pos, node, more). The number of levels, and the lone nodes (grp, node) that each of them leaves."""
    spark = nodes.sparkSession
    most, level = nodes.agg(F.max("n")).first()[0] or 0, 0
    lone = [nodes.where("n = 1").select("grp", "node")]
    while most > 1:
        more = [c for c in nodes.columns if c not in {"grp", "n", "pos", "node"}]
        runs = nodes.where("n > 1").groupBy("grp", "n", F.expr(f"pos div {ARITY}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "node", *more))).alias("nodes"))
        runs = runs.withColumn("parent", F.sha2(F.concat_ws("", "nodes.node"), 256))
        place = f"{folder}/tree={tree}/level={level}"
        runs.write.parquet(place)
        nodes = spark.read.parquet(place).select("grp", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.col("run").alias("pos"), F.col("parent").alias("node"))
        lone.append(nodes.where("n = 1").select("grp", "node"))
        most, level = -(-most // ARITY), level + 1
    return level, lone


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", now: dict[str, str] | None = None, folder: str | None = None) -> Manifest:
    """Writes the node store of docs: leaves by group in the order of the key, every 16 nodes hashed to one until one is left; likewise the groups' roots.

    fields are digested as text in the order given. now: for fields that may have changed since, the columns that hold
    today's values; prove() folds their leaves. Groups go in byte order, null first, as a group of its own; null keys
    come first in a group. Rows of one key go by their digests, so that the root doesn't depend on how the table lies;
    equal rows are a leaf each. A lone leaf is its group's root, a lone group's root is the root; no row: no root.
    Null and empty fields differ, whatever their length. Other columns of docs play no part.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    leaf = leaf_digest(*[F.col(f) for f in fields])
    names = [(now or {}).get(f, f) for f in fields]
    today = leaf_digest(*[F.col(f) for f in names])
    same = F.lit(True)
    for old, new in (now or {}).items():
        same &= F.col(old).eqNullSafe(F.col(new))
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("label"), leaf.alias("node"), F.when(~same, today).alias("today"))
    leaves.write.parquet(f"{folder}/digests")
    order = [F.asc_nulls_first("label"), F.asc_nulls_first("key"), F.asc("node"), F.asc_nulls_first("today")]
    placed = cut_lineage(numbered(spark.read.parquet(f"{folder}/digests"), order))
    groups = placed.groupBy("label").agg(F.min("position").alias("grp"), F.count("*").alias("n")).withColumnRenamed("label", "of")
    told = placed.join(groups, F.col("label").eqNullSafe(F.col("of"))).select("grp", "n", (F.col("position") - F.col("grp")).alias("pos"), "node", "key", "today")
    told.write.parquet(f"{folder}/leaves")
    low, lone = _grow(spark.read.parquet(f"{folder}/leaves"), folder, 0)
    roots = numbered(_union(lone), [F.asc("grp")])  # a group is known by the place of its first leaf, so groups stay in order
    roots = cut_lineage(roots.select(F.lit(0).cast("long").alias("grp"), F.col("position").alias("pos"), "node", F.col("grp").alias("of")))
    count = roots.count()
    high, lone = _grow(roots.withColumn("n", F.lit(count).cast("long")), folder, 1)
    _union(lone).write.parquet(f"{folder}/root")
    roots.write.parquet(f"{folder}/roots")
    return Manifest(spark, folder, (low, high))


def _down(store: Manifest, tree: int, leaves: DataFrame, top: DataFrame) -> DataFrame:
    """Each leaf of a tree with its path: what stands left and right of it, level by level.

    top: grp, path, more, one row a group, with the path above the group's root. leaves: the nodes that levels are over.
    """
    given = [c for c in top.columns if c not in {"grp", "path"}]
    more = [c for c in leaves.columns if c not in {"grp", "n", "pos", "node"}]
    below: DataFrame | None = None
    for level in reversed(range(store.heights[tree])):
        runs = store.level(tree, level).drop("parent")
        last = runs.where(f"n <= {ARITY}").join(top, "grp")
        if below is not None:
            above = below.select("grp", F.col("pos").alias("run"), "path", *given)
            last = last.unionByName(runs.where(f"n > {ARITY}").join(above, ["grp", "run"]))
        beside = F.expr("struct(concat_ws('', slice(nodes.node, 1, i)) AS left, concat_ws('', slice(nodes.node, i + 2, size(nodes))) AS right)")
        each = last.select("grp", "n", "nodes", "path", *given, F.posexplode("nodes").alias("i", "own"))
        below = each.select("grp", "n", "own.pos", "own.node", *([f"own.{c}" for c in more] if level == 0 else []), F.concat(F.array(beside), "path").alias("path"), *given)
    alone = leaves.where("n = 1").join(top, "grp").select("grp", "n", "pos", "node", *more, "path", *given)
    return alone if below is None else below.unionByName(alone)


def prove(store: Manifest) -> DataFrame:
    """A row for each leaf: doc_id (the key), leaf, subroot, root, proof (its siblings by level, left and right), proof_sha256, folded_root and verified.

    proof_sha256 digests the siblings from the leaf up to the root, left to right; without any, the empty text.
    folded_root is made of today's leaf, where its fields have changed, else of the leaf, and the siblings of the store.
    """
    spark = store.spark
    root = spark.read.parquet(f"{store.folder}/root").select("grp", F.col("node").alias("root"), F.expr(f"cast(array() as {PATH})").alias("path"))
    roots = spark.read.parquet(f"{store.folder}/roots")
    roots = roots.withColumn("n", F.lit(roots.count()).cast("long"))
    tops = _down(store, 1, roots, root).select(F.col("of").alias("grp"), F.col("node").alias("subroot"), "root", "path")
    found = _down(store, 0, store.leaves(), tops)
    siblings = F.flatten(F.transform("path", lambda p: F.array(p["left"], p["right"])))
    folded = F.aggregate("path", F.coalesce("today", "node"), lambda node, p: _digest(p["left"], node, p["right"]))
    out = found.select(F.col("key").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
