"""Semantic roles and nominal relations as decision tables: the first row that fits decides, so a table is one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of labels and verbs, relations of dependencies, and the roles they lead to.
TIME = ("time_date", "time_clock", "time_duration")
PLACE = ("gpe", "fac_name", "loc_generic", "infra")
MEASURE = ("measure", "percentage", "count", "money", "rate")
DOMAIN = ("field", "doctrine", "notion", "language")
WORK = ("work_of_art", "law", "document", "work_generic")
EVENT = ("event_nominal", "event_named", "state")
INSTRUMENT = ("tool", "weapon", "vehicle")
THING = ("substance", "food", "object_generic", "object_name", "animal", "vegetal", "disease")
ORG = ("org_name", "inst_name", "inst_role")
HUMAN = ("person_name", "person_role", "norp", "group_role", *ORG)
SAYING, CAUSING = ("Communication", "Cognition"), ("Causality", "State_Change", "Conflict")
ANY = None
Row = tuple[str, tuple[str, ...] | None, tuple[str, ...] | None, str]

#: (syntactic role, labels, verb families, semantic role); SKIP: left unsupervised.
SEMANTIC: list[Row] = [
    *[(f"OBLIQUE_{r}", ANY, ANY, r) for r in ("AGENT", "CAUSE", "ADVERSARY", "BENEFICIARY", "COMITATIVE", "DOMAIN", "SOURCE")], ("APPOS", ANY, ANY, "IDENTITY"),
    ("SUBJECT", TIME, ANY, "TEMPORAL"), ("SUBJECT", (*EVENT, "law", "infra", "disease", "doctrine"), CAUSING, "CAUSE"), ("SUBJECT", ANY, ANY, "AGENT"),
    ("OBJECT", TIME, ANY, "TEMPORAL"), ("OBJECT", MEASURE, ANY, "MEASURE"), ("OBJECT", PLACE, ANY, "LOCATION"), ("OBJECT", (*EVENT, *WORK, *DOMAIN), SAYING, "CONTENT"), ("OBJECT", HUMAN, SAYING, "PATIENT"), ("OBJECT", ANY, SAYING, "CONTENT"), ("OBJECT", ANY, ANY, "PATIENT"),
    ("OBLIQUE", TIME, ANY, "TEMPORAL"), ("OBLIQUE", PLACE, ANY, "LOCATION"), ("OBLIQUE", MEASURE, ANY, "MEASURE"), ("OBLIQUE", DOMAIN, ANY, "DOMAIN"), ("OBLIQUE", WORK, SAYING, "CONTENT"), ("OBLIQUE", WORK, ANY, "SOURCE"),
    ("OBLIQUE", EVENT, ("Temporal",), "TEMPORAL"), ("OBLIQUE", EVENT, SAYING, "CONTENT"), ("OBLIQUE", EVENT, ANY, "CAUSE"), ("OBLIQUE", INSTRUMENT, ("Possession",), "PATIENT"), ("OBLIQUE", INSTRUMENT, SAYING, "DOMAIN"), ("OBLIQUE", INSTRUMENT, ANY, "INSTRUMENT"),
    ("OBLIQUE", THING, SAYING, "DOMAIN"), ("OBLIQUE", THING, ANY, "PATIENT"), ("OBLIQUE", ("norp",), ("Relation", "OTHER"), "DOMAIN"), ("OBLIQUE", ("norp",), ("Social",), "BENEFICIARY"), ("OBLIQUE", ("norp",), ANY, "PATIENT"),
    ("OBLIQUE", ORG, ("Relation",), "PART_OF"), ("OBLIQUE", ORG, ("Social",), "BENEFICIARY"), ("OBLIQUE", ("inst_name",), CAUSING, "LOCATION"), ("OBLIQUE", ORG, SAYING, "BENEFICIARY"), ("OBLIQUE", ORG, ANY, "PATIENT"),
    ("OBLIQUE", HUMAN, ("Social", *SAYING), "BENEFICIARY"), ("OBLIQUE", HUMAN, ("Possession",), "OWNER"), ("OBLIQUE", HUMAN, ("Relation",), "PART_OF"), ("OBLIQUE", HUMAN, (*CAUSING, "Perception", "OTHER"), "PATIENT"), ("OBLIQUE", ANY, ANY, "SKIP"),
]
NOMINAL = {"APPOS": "IDENTITY", "POSS": "OWNER", "SOURCE": "SOURCE", "MEDIUM": "SOURCE", "LOC": "LOCATION", "TIME": "TEMPORAL"}
RELATIONS = {
    "nmod": "NMOD", "nmod:poss": "POSS", "nmod:subj": "NMOD", "amod": "AMOD", "appos": "APPOS", "flat": "COMPOUND", "flat:name": "COMPOUND", "flat:foreign": "COMPOUND", "compound": "COMPOUND", "det": "AMOD", "nsubj": "SOURCE",
    "nsubj:pass": "NMOD", "obl": "MISC", "obl:mod": "MISC", "obl:agent": "MISC", "acl": "NMOD", "acl:relcl": "NMOD", "advmod": "MISC", "conj": "NMOD", "cc": "AMOD",
}


def listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def semantic_sql() -> str:
    """SEMANTIC as a CASE over role, label, family and voice, in the words that SQL engines share."""
    whens = ["WHEN role = 'SUBJECT' AND voice = 'passive' THEN 'PATIENT'"]
    for role, labels, families, out in SEMANTIC:
        more = (f" AND label IN {listed(labels)}" if labels else "") + (f" AND family IN {listed(families)}" if families else "")
        whens.append(f"WHEN role = '{role}'{more} THEN '{out}'")
    return f"CASE {' '.join(whens)} END"


def nominal_sql() -> str:
    """The role that follows from a nominal relation, for spans without a verb; over relation, label, parent_label, parent_end and end."""
    plain = " ".join(f"WHEN relation = '{a}' THEN '{b}'" for a, b in NOMINAL.items())
    of = f"WHEN relation = 'NMOD' THEN CASE WHEN label IN {listed(TIME)} THEN 'TEMPORAL' WHEN label IN {listed(PLACE)} THEN 'LOCATION' WHEN label IN {listed(ORG)} AND NOT coalesce(parent_label = label OR parent_end = \"end\", false) THEN 'PART_OF' ELSE 'DOMAIN' END"
    return f"CASE {plain} {of} WHEN relation IS NOT NULL THEN 'SKIP' END"


def semantic_role() -> Column:
    return F.expr(semantic_sql())


def nominal_role() -> Column:
    return F.expr(nominal_sql().replace('"end"', "end"))


def relation(deprel: Column, label: Column) -> Column:
    """The nominal relation of a dependency, by its whole name or its first part, refined by the label."""
    table = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    base = F.substring_index(deprel, ":", 1)
    found = F.coalesce(table[deprel], table[base], F.lit("MISC"))
    refined = found.isin("MISC", "NMOD") & base.isin("obl", "advmod", "nmod")
    return F.when(refined & label.isin(*TIME), "TIME").when(refined & label.isin(*PLACE), "LOC").otherwise(found)
