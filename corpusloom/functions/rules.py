"""Ordered rules that give a span another label, or DROP, by its label, its text and its sentence.

A rule is (labels, condition, outcome). A condition is an SQL predicate over text and line, in which `{name}` stands
for "text matches the pattern of that name" and `{line:name}` for the same on the sentence. The first rule that holds decides, so
a set of rules is one CASE expression: a projection without a join, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rule_values as V

Rule = tuple[tuple[str, ...], str, str]


Pairs = tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]


def _any(items: tuple[str, ...]) -> str:
    return "(" + "|".join(items) + ")"


def _either(items: tuple[str, ...]) -> str:
    return r"\b" + _any(items) + r"\b"


def _whole(items: tuple[str, ...]) -> str:
    return "^" + _any(items) + "$"


def _behind_article(*ways: str) -> str:
    return f"^{_any(V.ARTICLES)}?({'|'.join(ways)})"


def _pairs(pairs: Pairs) -> str:
    """A word and what may follow it behind a space."""
    return "|".join(f"{_any(words)} {_any(more)}" for words, more in pairs)


#: What conditions ask for, by name. Case doesn't count but for *_CASE.
PATTERNS = {
    "digit": r"\d", "most_four_words": r"^\s*\S+(\s+\S+){0,3}\s*$", "most_two_words": r"^\s*\S+(\s+\S+)?\s*$", "one_word": r"^\s*\S+\s*$", "short": r"^.{0,2}$",
    "speed": _either(V.SPEED_UNITS), "countable": _either(V.COUNTABLE), "approximate": _either(V.APPROXIMATE), "physical": _either(V.PHYSICAL_UNITS), "number_words": _either(V.NUMBER_WORDS),
    "abstract_only": f"^{_any(V.ABSTRACT_NOUNS)}" + r"\s*" + f"{_any(V.ABSTRACT_KINDS)}?$", "rate_context": _either(V.RATE_CONTEXT), "rate_text": r"%|taux|croissance|inflation|ch[oô]mage",
    "frequency": r"\b(GHz|MHz|kHz|Hz)\b", "times": r"\bfois\b", "per": r"\bpar\b", "fraction": r"^\d+/\d+$", "macro_acronym": _whole(V.MACRO_ACRONYMS), "vague_rate": _whole(V.VAGUE_RATES),
    "document_words": _either(V.DOCUMENT_WORDS), "state_adjective": f"^{_any(V.STATE_ADJECTIVES)}s?$", "adjective_ending": f"^.+{_any(V.ADJECTIVE_ENDINGS)}s?$", "lower_first_CASE": r"^\p{Ll}",
    "size_adjective": _whole(V.SIZES), "size_only": r"^(petites?|grandes?|moyennes?)\s+(et\s+)?(moyennes?|grandes?|petites?)?$", "notion_adjective": _whole(V.NOTION_ADJECTIVES), "vague_doctrine": _whole(V.VAGUE_DOCTRINES),
    "garbage": f"^{_any(V.GARBAGE)}" + r"\s*$", "any_unit": "|".join(V.ANY_UNITS), "quantity_words": _either(V.QUANTITY_WORDS),
    "rate_unit": "|".join(V.RATE_UNITS) + r"|par\s+" + _any(V.RATE_PERIODS), "measure_unit": "|".join(V.MEASURE_UNITS), "score": r"^\d+\s*[-]\s*\d+$|^\d+\s+(contre|vs)\.?\s+\d+$", "pure_number": r"^[\d\s,\.]+$",
    "number_phrase": "^[\"']*" + _any(V.NUMBER_PHRASES) + "[\"']*$", "count_unit": "|".join(V.COUNT_UNITS), "ordinal": "|".join(V.ORDINALS),
    "law": "|".join([_behind_article(_pairs(V.LAWS), *V.LAW_BEGINNINGS), f"^{_any(V.LAW_NAMES)}", f"^{_any(V.ARTICLES)}?{_any(V.LAW_WHOLE[:1])}$", _whole(V.LAW_WHOLE[1:]), *V.LAW_ANYWHERE]),
    "disease": "|".join([r"^\s*" + _any(V.DISEASES) + r"\s*$", _behind_article(f"{_any(V.DISEASES_WITH_MORE)}( .+)?$", f"{_any(V.DISEASES_ALONE)}$", _pairs(V.DISEASES_OF), *V.DISEASE_BEGINNINGS)]),
    "work": _whole(V.WORKS_OF_ART), "notion": _whole(V.NOTIONS), "process": _whole(V.PROCESSES), "field": _whole(V.FIELDS), "rule": _whole(V.RULE_WORDS),
    "infra_place": _whole(V.INFRA_PLACES), "infra_object": _whole(V.INFRA_OBJECTS), "tool_object": _whole(V.TOOL_OBJECTS), "tool_weapon": _whole(V.TOOL_WEAPONS),
    "person_prefix": f"^{_any(V.PERSON_PREFIXES)}", "institution": f"^{_any(V.INSTITUTION_PREFIXES)}($| |s|x)", "qualifier": "|".join(V.QUALIFIERS), "institution_root": f"^{_any(V.INSTITUTION_ROOTS)}($| |s|x)",
    "acronym_CASE": r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$", "later_capital_CASE": r"\s\p{Lu}", "no_capital_CASE": r"^[^\p{Lu}]+$",
}

_ANY: tuple[str, ...] = ()
RULES: dict[str, list[Rule]] = {
    "value": [
        (("measure",), "{speed}", "rate"), (("measure",), "{countable}", "count"), (("measure",), "{approximate}", "count"),
        (("measure",), "NOT {digit} AND NOT {physical} AND {number_words}", "count"), (("measure",), "NOT {digit} AND NOT {physical} AND {abstract_only}", "DROP"), (("measure",), "NOT {digit} AND NOT {physical} AND {most_four_words}", "DROP"),
        (("percentage",), "{line:rate_context} AND {rate_text}", "rate"), (("rate",), "{frequency}", "measure"), (("rate",), "{times} AND NOT {per}", "count"), (("rate",), "{fraction}", "percentage"),
        (("rate",), "{macro_acronym}", "notion"), (("rate",), "{vague_rate}", "DROP"),
    ],
    "weak": [
        (("object_generic",), "{document_words}", "document"), (("state",), "{most_two_words} AND NOT {digit} AND {state_adjective}", "DROP"), (("state",), "{one_word} AND NOT {digit} AND {lower_first_CASE} AND {adjective_ending}", "DROP"),
        (("field",), "{one_word} AND {size_adjective}", "DROP"), (("field",), "{size_only}", "DROP"), (("notion",), "{one_word} AND NOT {digit} AND {notion_adjective}", "DROP"), (("doctrine",), "{one_word} AND {vague_doctrine}", "DROP"),
    ],
    "quantity": [
        (("quantity",), "{short} OR {garbage}", "DROP"), (("quantity",), "{any_unit}", "measure"), (("quantity",), "{digit} OR {quantity_words}", "count"), (("quantity",), "TRUE", "DROP"),
    ],
    "quantity_kinds": [
        (("quantity",), "{rate_unit}", "rate"), (("quantity",), "{measure_unit}", "measure"), (("quantity",), "{score} OR {pure_number} OR {number_phrase}", "count"), (("quantity",), "{digit} AND {count_unit}", "count"), (("quantity",), "{ordinal}", "count"),
    ],
    "abstract": [(("law", "disease", "concept", "language", "work_of_art"), "TRUE", "="), (_ANY, "{law}", "law"), (_ANY, "{disease}", "disease")],
    "concept": [(("concept",), f"{{{p}}}", o) for p, o in (("work", "work_generic"), ("notion", "notion"), ("process", "process"), ("field", "field"), ("rule", "rule"))],
    "infra_tool": [(("infra",), "{infra_object}", "object_generic"), (("infra",), "{infra_place}", "loc_generic"), (("tool",), "{tool_weapon}", "weapon"), (("tool",), "{tool_object}", "object_generic")],
    "institution": [
        (("group_role",), "NOT {folded:person_prefix} AND {folded:institution}", "inst_role"),
        (("inst_name",), "NOT {folded:qualifier} AND NOT {acronym_CASE} AND NOT {later_capital_CASE} AND {folded:institution_root}", "inst_role"),
    ],
    "generic_institution": [(("inst_name",), "{no_capital_CASE}", "group_role")],
}

# Old labels' successors, and the labels with an attribute.
SUCCESSORS = {"state": "event_nominal", "doctrine": "notion", "work_generic": "work_of_art", "object_name": "object_generic", "rate": "measure", "vegetal": "animal"}
ANIMATE = ("person_name", "person_role", "norp", "group_role", "animal")
ABSTRACT = ("work_of_art", "law", "document", "language", "notion", "field", "disease")
WORKS = ("work_of_art", "law", "document")
EVENTS = ("event_nominal", "event_name", "disease")


def predicate(condition: str, match: str = "{c} RLIKE r\"{p}\"", flags: str = "(?iu)", quote: Callable[[str], str] = lambda p: p.replace('"', r"\x22"), folded: str = "translate(lower(text), 'àâäçéèêëîïôöùûü''’-', 'aaaceeeeiioouuu   ')") -> str:
    """A condition with its patterns put in; match, flags and quote tell how an engine writes a match."""

    def one(m: re.Match) -> str:
        where, name = m.groups()
        c = {"line:": "line", "folded:": folded}.get(where or "", "text")
        return "(" + match.format(c=c, p=("" if name.endswith("_CASE") else flags) + quote(PATTERNS[name])) + ")"

    return re.sub(r"\{(line:|folded:)?(\w+)\}", one, condition)


def ladder(rules: list[Rule], **dialect: object) -> str:
    """A CASE over label, text and line; outcome `=` keeps the label."""
    whens = []
    for labels, condition, outcome in rules:
        of = f"label IN ({', '.join(repr(x) for x in labels)}) AND " if labels else ""
        whens.append(f"WHEN {of}({predicate(condition, **dialect)}) THEN {'label' if outcome == '=' else repr(outcome)}")  # type: ignore[arg-type]
    return f"CASE {' '.join(whens)} ELSE label END"


def relabel(rules: list[Rule]) -> Column:
    """The new label of rows with label, text and line."""
    return F.expr(ladder(rules))


def successor(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUCCESSORS.items() for x in pair])
    return F.coalesce(table[label], label)


def attributes(label: Column) -> list[Column]:
    """Five attributes that follow from the label a span first had."""
    new = successor(label)
    pick = lambda on, yes, no: F.when(on, yes).otherwise(no)
    stative = (label == "state") | (new == "disease")
    return [
        pick(label.isin(*ANIMATE), "animate", "inanimate").alias("animacy"),
        pick(label.isin(*ANIMATE, "vegetal"), "living", "non_living").alias("living"),
        pick(new.isin(*ABSTRACT) | (label == "state"), "abstract", "concrete").alias("abstract"),
        F.when(new.isin(*EVENTS), pick(stative, "stative", "dynamic")).alias("dynamicity"),
        pick(new.isin(*WORKS), "work", "non_work").alias("work"),
    ]
