"""Nominal parents on sentences written by hand: each rule, each reason against an edge, and what a review is for."""

from __future__ import annotations

import pytest

from corpusloom.operators import nominal as N

SPAN = "doc_id long, sent_id long, pos long, start long, end long, text string, label string, coarse string, gender string, number string, role string"


def spans_of(line, marked):
    """Rows of (text, label[, coarse, gender, number, role]) found in the line from left to right, or inside the one before for a text with +."""
    rows, at = [], 0
    for i, (text, label, *more) in enumerate(marked):
        start = line.index(text.lstrip("+"), 0 if text.startswith("+") else at)
        text = text.lstrip("+")
        at = start + len(text)
        rows.append((1, 0, i, start, at, text, label, *(more + [None] * (4 - len(more)))))
    return rows


def judged(spark, line, marked):
    spans = spark.createDataFrame(spans_of(line, marked), SPAN)
    attempts, told = N.nominal_edges(spans, spark.createDataFrame([(1, 0, line)], "doc_id long, sent_id long, line string"))
    flags = N.review(spans, attempts, told).first()
    return {(r.rule, r.child_text, r.parent_text): (r.relation, r.reason, r.taken) for r in attempts.collect()}, flags


@pytest.mark.parametrize(("line", "marked", "wanted"), [
    ("PDG Bernard Arnault", [("PDG", "hint_person_role"), ("Bernard Arnault", "hint_person_name")], {(1, "Bernard Arnault", "PDG"): ("APPOS", None, True)}),
    ("journal Les Échos", [("journal", "hint_document"), ("Les Échos", "hint_org_name")], {(2, "Les Échos", "journal"): ("APPOS", None, True)}),
    ("salle du réacteur", [("salle", "hint_loc_generic"), ("réacteur", "hint_infra")], {(3, "réacteur", "salle"): ("NMOD", None, True)}),
    ("fondations solides", [("fondations solides", "hint_notion", None, "Fem"), ("+solides", "hint_notion", None, "Fem")], {(4, "solides", "fondations solides"): ("AMOD", None, True)}),
    ("Renault voit partir son PDG", [("Renault", "hint_org_name"), ("PDG", "hint_person_role")], {(5, "PDG", "Renault"): ("POSS", None, True)}),
    ("annonce de Renault", [("annonce", "hint_event_nominal"), ("Renault", "hint_org_name")], {(3, "Renault", "annonce"): ("SOURCE", None, True), (6, "Renault", "annonce"): ("SOURCE", None, False)}),
    ("PDG, Bernard Arnault", [("PDG", "hint_person_role"), ("Bernard Arnault", "hint_person_name")], {}),
    ("fondations solides", [("fondations solides", "hint_notion", None, "Fem"), ("+solides", "hint_notion", None, "Masc")], {}),
])
def test_rules_by_hand(spark, line, marked, wanted):
    assert judged(spark, line, marked)[0] == wanted


@pytest.mark.parametrize(("line", "marked", "reason"), [
    ("PDG 3 euros", [("PDG", "hint_person_role"), ("3 euros", "hint_org_name", "VALUE")], "measure_as_nominal_child"),
    ("taux de Renault", [("taux", "hint_rate"), ("Renault", "hint_org_name")], "measure_as_nominal_parent"),
    ("réunion du lundi", [("réunion", "hint_event_nominal"), ("lundi", "hint_time_date")], "time_as_nominal_child"),
    ("PDG Paris", [("PDG", "hint_person_role"), ("Paris", "hint_gpe")], "invalid_appos_compatibility"),
    ("ministre \"de\" Renault", [("ministre", "hint_group_role"), ("Renault", "hint_org_name")], None),
    ("3 marsLe groupe de Renault", [("3 mars", "hint_notion"), ("Le groupe", "hint_notion")], None),
])
def test_reasons_by_hand(spark, line, marked, reason):
    found, flags = judged(spark, line, marked)
    assert {r for _, r, _ in found.values()} == ({reason} if reason else set())
    assert flags.needs_review == (reason in N.CRITICAL or "marsLe" in line or '"' in line)


def test_glued_lines_and_sources(spark):
    line = "salle de mars marsLe salle du réacteur"
    found, flags = judged(spark, line, [("salle", "hint_infra"), ("mars marsLe", "hint_infra"), ("salle", "hint_infra"), ("réacteur", "hint_infra")])
    assert found[3, "mars marsLe", "salle"] == ("NMOD", None, True) and found[3, "réacteur", "salle"][1] is None
    assert flags.glued == line.index("Le salle") and flags.not_for_training and flags.needs_review
    line = "Le Monde : «la salle du réacteur», consulté le 3/4/2020, salle du port"
    found, flags = judged(spark, line, [("Le Monde", "hint_org_name"), ("salle", "hint_infra"), ("réacteur", "hint_infra"), ("salle", "hint_infra"), ("port", "hint_infra")])
    assert found[3, "réacteur", "salle"] == ("NMOD", "inside_source_block", False) and found[3, "port", "salle"] == ("NMOD", None, True)
    assert flags.blocks == 1 and flags.not_for_training


def test_appositions_without_an_edge_are_reviewed(spark):
    assert judged(spark, "Renault et lui", [("Renault", "hint_org_name", None, None, None, "APPOS")])[1].needs_review
    assert not judged(spark, "Renault et lui", [("Renault", "hint_org_name")])[1].needs_review


def test_odd_spans(spark):
    line = spark.createDataFrame([(1, 0, "a b"), (2, 0, None)], "doc_id long, sent_id long, line string")
    rows = [(1, 0, 0, None, 3, "a", "hint_gpe", None, None, None, None), (1, 0, 1, 2, 2, None, None, None, None, None, None), (2, 0, 0, 0, 1, "a", "hint_gpe", None, None, None, None)]
    attempts, told = N.nominal_edges(spark.createDataFrame(rows, SPAN), line)
    assert attempts.count() == 0 and told.count() == 2
    assert N.with_parents(spark.createDataFrame(rows, SPAN), attempts).count() == 3


def test_far_spans_meet_nobody(spark):
    """Spans meet by stretches: the same pairs as all of a sentence's spans by the definition."""
    import random

    rng = random.Random(2)
    rows = [(1, 0, i, s, s + rng.randrange(1, 300), "x", "hint_gpe", None, None, None, None) for i, s in enumerate(rng.sample(range(3000), 120))]
    ranked = [(r[3], r[4]) for r in sorted(rows, key=lambda r: (r[3], r[3] - r[4], r[2]))]
    wanted = {(a + 1, b + 1) for a in range(120) for b in range(a + 1, 120) if ranked[b][0] <= ranked[a][1] + N.REACH}
    described, _ = N.described(spark.createDataFrame(rows, SPAN), spark.createDataFrame([(1, 0, "x" * 4000)], "doc_id long, sent_id long, line string"))
    got = [(r.a_rank, r.b_rank) for r in N.near_pairs(described).collect()]
    assert set(got) == wanted and len(got) == len(wanted)
