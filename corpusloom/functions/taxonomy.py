"""The labels of spans: coarse types, kinds, groups; lookups as column expressions, an export with checks, and its reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fine labels by coarse type, in their order; labels by kind; and the concrete ones.
COARSE = {
    "PER": ("hint_person_name", "hint_person_role", "hint_norp", "hint_group_role"),
    "LOC": ("hint_gpe", "hint_fac_name", "hint_loc_generic", "hint_infra"),
    "ORG": ("hint_org_name", "hint_inst_name", "hint_inst_role"),
    "TIME": ("hint_time_date", "hint_time_clock", "hint_time_duration"),
    "VALUE": ("hint_measure", "hint_percentage", "hint_count", "hint_money"),
    "OBJECT": ("hint_weapon", "hint_vehicle", "hint_substance", "hint_food", "hint_tool", "hint_object_generic", "hint_animal"),
    "EVENT": ("hint_event_nominal", "hint_event_named", "hint_disease"),
    "CONCEPT": ("hint_work_of_art", "hint_law", "hint_document", "hint_language", "hint_notion", "hint_field"),
}
NONE = "NONE"
KINDS = {
    "ENTITY": ("hint_person_name", "hint_gpe", "hint_org_name", "hint_inst_name", "hint_event_named", "hint_law", "hint_fac_name", "hint_object_name", "hint_work_of_art"),
    "MENTION_ROLE": ("hint_person_role", "hint_group_role", "hint_norp", "hint_inst_role"),
    "TRIGGER_INFO": ("hint_event_nominal",),
    "TRIGGER_ARG": (
        "hint_time_date", "hint_time_clock", "hint_time_duration", "hint_loc_generic", "hint_infra", "hint_object_generic", "hint_vehicle", "hint_substance", "hint_food", "hint_weapon", "hint_tool", "hint_disease", "hint_doctrine",
        "hint_state", "hint_notion", "hint_work_generic", "hint_document", "hint_language", "hint_field", "hint_measure", "hint_percentage", "hint_count", "hint_money", "hint_rate",
    ),
}
CONCRETE = (
    "hint_person_name", "hint_org_name", "hint_inst_name", "hint_gpe", "hint_fac_name", "hint_event_named", "hint_time_date", "hint_time_clock", "hint_time_duration", "hint_measure", "hint_percentage", "hint_count", "hint_money",
    "hint_work_of_art", "hint_law",
)


def _lookup(label: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for key, values in table.items() for v in values for x in (v, key)]), label)


def coarse_of(label: Column) -> Column:
    """A fine label's coarse type, NONE for one that has none."""
    return F.coalesce(_lookup(label, COARSE), F.lit(NONE))


def kind_of(label: Column) -> Column:
    """What a label stands for: an entity, a mention by role, a trigger, or what may be an argument; null for others."""
    return _lookup(label, KINDS)


def group_of(label: Column) -> Column:
    """concrete or abstract; null for labels without a coarse type."""
    return F.when(label.isin(*CONCRETE), "concrete").when(coarse_of(label) != NONE, "abstract")


def export(spark: SparkSession, counts: dict[str, int], path: str) -> None:
    """Writes the labels as one JSON record: coarse types and fine labels with ids, kinds, groups and the rows that use each.

    Nothing is written unless every fine label has one coarse type, every concrete label is a fine one, and counts are of known labels.
    """
    fine = [x for values in COARSE.values() for x in values]
    known = {*fine, *(x for values in KINDS.values() for x in values)}
    if len(fine) != len(set(fine)) or not set(CONCRETE) <= set(fine) or not set(counts) <= known:
        raise ValueError("labels don't fit together")
    of = {v: c for c, values in COARSE.items() for v in values}
    kind = {v: k for k, values in KINDS.items() for v in values}
    items = [(i, x, of[x], kind.get(x), "concrete" if x in CONCRETE else "abstract", counts.get(x, 0)) for i, x in enumerate(fine)]
    shape = "coarse struct<count:int,none_id:int,labels:array<struct<id:int,name:string>>>, fine struct<count:int,none_id:int,labels:array<struct<id:int,name:string,coarse:string,kind:string,grp:string,used:bigint>>>"
    names = [*COARSE, NONE]
    record = ((len(names), names.index(NONE), [(i, n) for i, n in enumerate(names)]), (len(fine), len(fine), items))
    spark.createDataFrame([record], shape).coalesce(1).write.json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, coarse, kind, grp, used) of an export; fails if its counts aren't those of its lists."""
    shape = "coarse struct<count:int,none_id:int,labels:array<struct<id:int,name:string>>>, fine struct<count:int,none_id:int,labels:array<struct<id:int,name:string,coarse:string,kind:string,grp:string,used:bigint>>>"
    record = spark.read.schema(shape).json(path)
    fits = (F.col("coarse.count") == F.size("coarse.labels")) & (F.col("fine.count") == F.size("fine.labels"))
    checked = record.withColumn("fits", F.when(fits, True).otherwise(F.raise_error(F.lit("an export's counts aren't those of its lists")).cast("boolean")))
    return checked.where("fits").select(F.explode("fine.labels").alias("x")).select("x.*")
