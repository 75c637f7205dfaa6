"""Relabelling rules on cases written out by hand, not by the tables that the queries' SQL is made from."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import roles
from corpusloom.functions import rules as R
from corpusloom.functions import text as T

CASES = {
    "value": [
        ("measure", "120 km/h", "", "rate"), ("measure", "trois soldats", "", "count"), ("measure", "environ dix", "", "count"), ("measure", "trente", "", "count"), ("measure", "perte", "", "DROP"), ("measure", "40 kg", "", "measure"),
        ("percentage", "12 % de chômage", "la croissance ralentit", "rate"), ("percentage", "12 %", "une part", "percentage"), ("rate", "3 GHz", "", "measure"), ("rate", "deux fois", "", "count"), ("rate", "deux fois par jour", "", "rate"),
        ("rate", "2/3", "", "percentage"), ("rate", "PIB", "", "notion"), ("rate", "seuil", "", "DROP"), ("notion", "seuil", "", "notion"),
    ],
    "weak": [("object_generic", "un rapport annuel", "", "document"), ("state", "grave", "", "DROP"), ("state", "crise sanitaire", "", "state"), ("state", "nationale", "", "state"), ("field", "grandes", "", "DROP"), ("notion", "majeures", "", "DROP"), ("doctrine", "stratégie", "", "DROP")],
    "quantity": [("quantity", "de", "", "DROP"), ("quantity", "beaucoup", "", "DROP"), ("quantity", "5 tonnes", "", "measure"), ("quantity", "trois cents", "", "count"), ("quantity", "rien du genre", "", "DROP")],
    "quantity_kinds": [("quantity", "30 points par match", "", "rate"), ("quantity", "5 tonnes", "", "measure"), ("quantity", "3-2", "", "count"), ("quantity", "2 contre 1", "", "count"), ("quantity", "1,000", "", "count"), ("quantity", "12 voix", "", "count"), ("quantity", "la première", "", "count"), ("quantity", "rien", "", "quantity")],
    "abstract": [("event_nominal", "traité de Rome", "", "law"), ("event_nominal", "l'armistice", "", "law"), ("event_nominal", "accord", "", "event_nominal"), ("event_nominal", "la grippe aviaire", "", "disease"), ("event_nominal", "Covid-19", "", "disease"), ("event_nominal", "choléra morbus", "", "event_nominal"), ("law", "la peste", "", "law")],
    "concept": [("concept", "Film", "", "work_generic"), ("concept", "idées", "", "notion"), ("concept", "cycle", "", "process"), ("concept", "chimie", "", "field"), ("concept", "conseil", "", "rule"), ("concept", "chimie fine", "", "concept")],
    "infra_tool": [("infra", "barricade", "", "object_generic"), ("infra", "escaliers", "", "loc_generic"), ("tool", "trappe", "", "weapon"), ("tool", "piano", "", "object_generic"), ("tool", "marteau", "", "tool")],
    "institution": [("group_role", "Police nationale", "", "inst_role"), ("group_role", "policiers", "", "group_role"), ("group_role", "ministre", "", "group_role"), ("inst_name", "gouvernement", "", "inst_role"), ("inst_name", "gouvernement Fillon", "", "inst_name"), ("inst_name", "ONU", "", "inst_name"), ("inst_name", "Parlement européen", "", "inst_name")],
    "generic_institution": [("inst_name", "le tribunal", "", "group_role"), ("inst_name", "le Tribunal", "", "inst_name")],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rules_by_hand(spark, name):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES[name])], "i int, label string, text string, line string, wanted string")
    for r in rows.withColumn("got", R.relabel(R.RULES[name])).collect():
        assert r.got == r.wanted, (r.label, r.text)


def test_every_set_of_rules_has_cases():
    assert set(CASES) == set(R.RULES)


def test_old_labels_by_hand(spark):
    cases = [("state", "event_nominal", "inanimate", "non_living", "abstract", "stative", "non_work"), ("vegetal", "animal", "inanimate", "living", "concrete", None, "non_work"), ("person_name", "person_name", "animate", "living", "concrete", None, "non_work"), ("work_generic", "work_of_art", "inanimate", "non_living", "abstract", None, "work"), ("disease", "disease", "inanimate", "non_living", "abstract", "stative", "non_work")]
    rows = spark.createDataFrame([(c[0],) for c in cases], "label string")
    got = rows.select("label", R.successor(F.col("label")), *R.attributes(F.col("label"))).collect()
    assert [tuple(r) for r in got] == cases


def test_wiki_markup_by_hand(spark):
    text = "{{Infobox|x}}\n'''Paris''' est la [[capitale|grande ville]] de la [[France]].<ref>note</ref>\n[[Catégorie:Ville]]"
    got = spark.createDataFrame([(text,)], "t string").select(T.strip_wiki(F.col("t"))).first()[0].strip()
    assert got == "Paris est la grande ville de la France.note\nCatégorie:Ville"  # links go before categories do


def test_case_markers_by_hand(spark):
    prefixes = ["le palais de la ", "rien "]
    rows = spark.createDataFrame([(p,) for p in prefixes], "p string").select(T.marker_relation(F.col("p")).alias("r")).collect()
    assert rows[1].r is None
    assert hasattr(roles, "__doc__")
