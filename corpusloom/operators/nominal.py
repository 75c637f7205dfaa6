"""Nominal parents by rules: edges proposed in the order of six rules, refused for the first of sixteen reasons, put on their spans.

Spans: (doc_id, sent_id, pos, start, end, text, label, coarse, gender, number, role); lines: (doc_id, sent_id, line).
Spans meet through stretches of the line: one stands for all the stretches that it or its reach touches, the other for the
one it starts in, so a sentence's spans aren't paired with each other but with those nearby. Where a sentence's spans and
its line lie beside each other (`laid_edges`), the same is worked out in place, and only edges leave.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .beside import codes, firsts, kinds, numbers, spread_out, worked

KEY = ["doc_id", "sent_id"]
# Labels by kind, words of communication, prepositions and possessives, and what sources and glued lines look like.
NOT_NOMINAL = ("verb_trigger", "pron_subj", "pron_obj")
ROLES = ("hint_person_role", "hint_group_role", "hint_inst_role")
PROPER = ("hint_person_name", "hint_org_name", "hint_inst_name", "hint_event_named", "hint_gpe", "hint_object_name")
ORGANISATIONS = ("hint_org_name", "hint_inst_name")
DOCUMENTS = ("hint_document", "hint_work_of_art", "hint_law", "hint_work_generic")
GENERIC = ("hint_org_generic", "hint_company_generic", "hint_object_generic")
COMMUNICATION = ("hint_event_nominal", "hint_document")
COMMUNICATION_WORDS = (
    "déclarations", "déclaration", "annonce", "annonces", "rapport", "rapports", "communiqué", "communiqués", "lettre", "lettres", "note", "notes", "avis", "discours", "allocution",
    "conférence", "interview", "entretien", "message", "décret", "arrêté", "propos",
)
PREPOSITIONS = ("de", "du", "des", "d'", "d’")
POSSESSIVES = ("son", "sa", "ses", "leur", "leurs", "mon", "ma", "mes", "ton", "ta", "tes", "notre", "votre", "nos", "vos")
MEASURES = ("hint_measure", "hint_rate", "hint_money", "hint_value")
TIMES = ("hint_time_date", "hint_time_duration", "hint_time_clock")
PLACES = ("hint_fac_name", "hint_gpe", "hint_loc_generic", "hint_infra")
ABSTRACT = ("hint_notion", "hint_field", "hint_state")
OBJECTS = ("hint_object_name", "hint_vehicle", "hint_tool", "hint_substance")
GLUED = r"(heure|heures|h|mSv/h|Sv/h|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)(Le|La|Les|L'|L’)\b"
QUOTED = r"[\"«“].+?[\"»”]"
CONSULTED = r"(?i)\bconsult[ée]?\s+le\s+\d{1,2}/\d{1,2}/\d{2,4}"
BESIDE = r"^[\s\-–—'«»\"“”]*$"
WHITE = " \t\n\x0b\f\r"
BESIDE_SIGNS = WHITE + "-–—'«»\"“”"
#: Reasons that call for a review.
CRITICAL = (
    "verb_or_pron_endpoint", "parent_not_nominal", "child_not_nominal", "measure_as_nominal_parent", "measure_as_nominal_child", "invalid_appos_compatibility", "inside_source_block",
    "crosses_source_block", "crosses_suspicious_boundary", "child_contains_parent_fragment",
)
#: Signs of a stretch, how far a rule looks behind a span, and how far one reads what stands there.
STRETCH, REACH, READ = 128, 100, 35


def coarse_of(label: Column, given: Column) -> Column:
    """The type that is given, else that of the label, or null."""
    own = (
        F.when(label.startswith("hint_person") | label.isin("hint_norp", "hint_group_role"), "PER").when(label.isin("hint_org_name", "hint_inst_name", "hint_inst_role"), "ORG").when(label.isin(*PLACES), "LOC").when(label.isin(*TIMES), "TIME")
        .when(label.isin(*MEASURES), "VALUE").when(label.startswith("hint_event"), "EVENT").when(label.isin(*DOCUMENTS), "WORK").when(label.isin(*ABSTRACT), "ABSTRACT").when(label.isin(*OBJECTS), "OBJECT")
    )
    return F.coalesce(F.when(given != "", given), own)


def glued_at(line: Column) -> Column:
    """Where a word is glued to the one before it, as in lines read by machine; null where none is."""
    at = F.regexp_instr(line, F.lit(GLUED))
    return F.when(at > 0, at - 1 + F.length(F.regexp_extract(line, GLUED, 1)))


def quotations(line: Column) -> Column:
    """Quotations (from, to, upto): upto is the end of a date of consultation behind, or that of the quotation."""
    quotes, gaps = F.regexp_extract_all(line, F.lit(QUOTED), F.lit(0)), F.split(line, QUOTED)
    upto = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, s: a + F.length(s))
    places = F.transform(quotes, lambda q, i: F.struct((upto(gaps, i + 1) + upto(quotes, i)).alias("from"), (upto(gaps, i + 1) + upto(quotes, i + 1)).alias("to")))

    def whole(p: Column) -> Column:
        behind = F.substring(line, p["to"] + 1, F.lit(140))
        at = F.regexp_instr(behind, F.lit(CONSULTED))
        end = F.when(at > 0, p["to"] + at - 1 + F.length(F.regexp_extract(behind, CONSULTED, 0))).otherwise(p["to"])
        return F.struct(p["from"].cast("long").alias("from"), p["to"].cast("long").alias("to"), end.cast("long").alias("upto"))

    return F.transform(places, whole)


def source_blocks(line: Column, sources: Column) -> Column:
    """Quotations (start, end, quote_start, quote_end), from the source before them, if it ends at most 90 signs before, up to a date of consultation behind.

    sources: array of (end, size, start) of the spans that may be one; of several the last counts, of these the longest.
    """

    def block(p: Column) -> Column:
        source = F.array_max(F.filter(sources, lambda s: (s["end"] <= p["from"]) & (p["from"] - s["end"] <= 90)))
        return F.struct(F.coalesce(source["start"], p["from"]).alias("start"), p["upto"].alias("end"), p["from"].alias("quote_start"), p["to"].alias("quote_end"))

    return F.transform(quotations(line), block)


def known() -> dict[str, Column]:
    """A span's label, whether it is nominal, and its type."""
    label = F.coalesce("label", F.lit(""))
    return {"label": label, "nominal": F.coalesce(~label.isin(*NOT_NOMINAL) & (F.col("end") > F.col("start")), F.lit(False)), "coarse": coarse_of(label, F.col("coarse"))}


def described(spans: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans with rank, nominal and coarse; a row a sentence with line, glued and blocks)."""
    order = Window.partitionBy(*KEY).orderBy("start", F.col("start") - F.col("end"), "pos")
    rows = spans.withColumns(known()).withColumn("rank", F.row_number().over(order))
    rows = written(rows)
    source = F.when(F.col("nominal") & F.col("coarse").isin("ORG", "WORK"), F.struct(F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("size"), F.col("start").cast("long").alias("start")))
    told = lines.select(*KEY, "line").join(rows.groupBy(*KEY).agg(F.collect_list(source).alias("sources")), KEY, "left")
    sources = F.coalesce("sources", F.array().cast("array<struct<end:bigint,size:bigint,start:bigint>>"))
    return rows, written(told.select(*KEY, "line", glued_at(F.col("line")).alias("glued"), source_blocks(F.col("line"), sources).alias("blocks")))


def _side(rows: DataFrame, name: str) -> DataFrame:
    told = [c for c in ("behind", "owned", "glued", "place") if c in rows.columns]
    return rows.select(*KEY, *[F.col(c).alias(f"{name}_{c}") for c in ("rank", "start", "end", "text", "label", "coarse", "nominal", "gender", "number", *told)])


def near_pairs(rows: DataFrame) -> DataFrame:
    """Pairs a, b of a sentence's spans of which b starts inside a or at most REACH signs behind it, a before b in order."""
    stretches = F.sequence(F.floor(F.col("a_start") / STRETCH), F.floor((F.greatest("a_start", "a_end") + REACH) / STRETCH))
    a = _side(rows, "a").withColumn("stretch", F.explode(stretches))
    b = _side(rows, "b").withColumn("stretch", F.floor(F.col("b_start") / STRETCH))
    return a.join(b, [*KEY, "stretch"]).where((F.col("a_rank") < F.col("b_rank")) & (F.col("b_start") <= F.col("a_end") + REACH)).drop("stretch")


def read(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Spans with what rules read of their line: behind, the signs after a span; owned, whether a possessive stands before it; glued; place, the number of the first block that its middle lies in, or null.

    So that no pair of spans has the line itself, which may be long.
    """
    start, end = F.col("start"), F.col("end")
    before = F.lower(F.trim(F.substring("line", (F.greatest(F.lit(0), start - 8) + 1).cast("int"), F.least(F.lit(8), start).cast("int"))))
    middle = F.floor((start + end) / 2)
    place = F.array_min(F.transform("blocks", lambda b, i: F.when((b["start"] <= middle) & (middle < b["end"]), i)))
    known = {"behind": F.substring("line", (end + 1).cast("int"), F.lit(READ)), "owned": before.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(POSSESSIVES)})$"), "place": place}
    return rows.join(told, KEY).select(*rows.columns, "glued", *[c.alias(n) for n, c in known.items()])


def refusal(relation: Column) -> Column:
    """The first reason against an edge from child_ to parent_ (with zone, what stands between them if the parent is first, glued, and each one's place), or null."""
    c, p = (lambda n: F.col(f"child_{n}")), (lambda n: F.col(f"parent_{n}"))
    measure = lambda s: s("label").isin(*MEASURES) | F.coalesce(s("coarse") == "VALUE", F.lit(False))
    same = (c("start") == p("start")) & (c("end") == p("end"))
    holds = lambda x, y: (x("start") <= y("start")) & (x("end") >= y("end")) & ~same
    middle = lambda s: F.floor((s("start") + s("end")) / 2)
    crossed = F.col("glued").isNotNull() & (((middle(c) < F.col("glued")) & (F.col("glued") <= middle(p))) | ((middle(p) < F.col("glued")) & (F.col("glued") <= middle(c))))
    c_block, p_block = c("place"), p("place")
    overlap = F.least(c("end"), p("end")) > F.greatest(c("start"), p("start"))
    gap = F.when(overlap, 0).when(p("end") <= c("start"), c("start") - p("end")).otherwise(p("start") - c("end"))
    alike = p("coarse").isNotNull() & c("coarse").isNotNull() & (((p("coarse") == c("coarse")) & p("coarse").isin("PER", "ORG", "LOC", "WORK", "OBJECT")) | ((p("coarse") == "WORK") & c("coarse").isin("ORG", "WORK")))
    appos = F.coalesce(alike & ~measure(p) & ~measure(c), F.lit(False))
    amod = ~measure(p) & ~measure(c) & (holds(p, c) | (~holds(c, p) & (gap <= 3)))
    local = ("APPOS", "NMOD", "AMOD", "COMPOUND")
    against = [
        (relation.isNull(), "missing_relation"), (~c("nominal"), "child_not_nominal"), (~p("nominal"), "parent_not_nominal"), (same, "same_span"), (c("label").isin(*NOT_NOMINAL) | p("label").isin(*NOT_NOMINAL), "verb_or_pron_endpoint"),
        (crossed, "crosses_suspicious_boundary"), (~c_block.eqNullSafe(p_block), "crosses_source_block"), (c_block.isNotNull() | p_block.isNotNull(), "inside_source_block"),
        (measure(p) & ~relation.isin("UNIT", "QUALIFIER", "TIME", "COMPARE_TO"), "measure_as_nominal_parent"), (measure(c) & relation.isin(*local, "POSS"), "measure_as_nominal_child"),
        ((c("label").isin(*TIMES) | F.coalesce(c("coarse") == "TIME", F.lit(False))) & relation.isin(*local), "time_as_nominal_child"), (holds(c, p) & relation.isin(*local), "child_contains_parent_fragment"),
        ((relation == "APPOS") & ~appos, "invalid_appos_compatibility"), ((relation == "AMOD") & ~amod, "invalid_amod_shape"), (relation.isin("NMOD", "SOURCE", "POSS", "LOC", "MEDIUM", "MISC") & (gap > 120), "edge_too_far"),
        (relation.isin(*local) & F.col("zone").rlike(r"[.;:\n]"), "hard_punctuation_between"),
    ]
    return F.coalesce(*[F.when(when, reason) for when, reason in against])


Rule = tuple[int, Column, Column, float, bool]


def _rules() -> list[Rule]:
    """(rule, when, relation, confidence, whether edges go by their child first) of the rules over pairs a, b with zone; b is the child. The rule of possessives is apart."""
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    apart, between = b("start") - a("end"), F.col("zone")
    words = F.lower(F.regexp_replace(between, r"^\s+|\s+$", ""))
    beside = (apart >= 0) & (apart <= 5) & between.rlike(BESIDE)
    of = words.isin(*PREPOSITIONS) | reduce(lambda x, y: x | y, [words.startswith(f"{p} ") for p in PREPOSITIONS])
    nominals = a("nominal") & b("nominal")
    speech = a("label").isin(*COMMUNICATION) & F.lower(F.coalesce(a("text"), F.lit(""))).isin(*COMMUNICATION_WORDS)
    said = b("coarse").isin("PER", "ORG", "WORK")
    agree = lambda n: F.coalesce(a(n) == b(n), F.lit(True))
    holds = (a("end") >= b("end")) & ((a("start") < b("start")) | (a("end") > b("end")))
    role_first, name_first = a("label").isin(*ROLES) & b("label").isin(*PROPER), a("label").isin(*PROPER) & b("label").isin(*ROLES)
    return [
        (1, beside & role_first, F.lit("APPOS"), 0.95, False), (1, beside & name_first, F.lit("APPOS"), 0.88, False), (2, beside & a("label").isin(*DOCUMENTS, *GENERIC) & b("label").isin(*ORGANISATIONS, *PROPER), F.lit("APPOS"), 0.90, False),
        (3, nominals & (apart <= 35) & of & ~between.rlike("[,;.:]"), F.when(speech & said, "SOURCE").otherwise("NMOD"), 0.78, False),
        (4, nominals & holds & (b("start") > a("start")) & ~b("label").isin(*PROPER) & agree("gender") & agree("number"), F.lit("AMOD"), 0.88, True),
        (6, speech & b("nominal") & (apart >= 0) & (apart <= 30) & of & said, F.lit("SOURCE"), 0.85, False),
    ]


SIDES = ("rank", "start", "end", "text", "label", "coarse", "nominal", "place")


def nominal_edges(spans: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts, sentences): every edge that a rule proposes, with reason (null if it may stand) and taken; and described()'s sentences.

    Rules: a role and a name beside it, a generic head and a name beside it, a nominal behind de or the like (a source, if
    the head is a word of communication), what a span holds and agrees with, a possessive and the last owner before it,
    and the source of a communication. Of the edges of a child's place that may stand, the first in the order of rules
    and spans is taken. Spans without bounds, and sentences without a line, propose nothing.
    """
    rows, told = described(spans.where("start IS NOT NULL AND end IS NOT NULL"), lines)
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    apart = b("start") - a("end")
    # no rule reads more than READ signs behind a span, and only the one of possessives looks farther
    pairs = near_pairs(read(rows, told)).where((apart <= READ) | b("owned")).withColumn("zone", F.when(apart >= 0, F.substring(a("behind"), F.lit(1), apart.cast("int"))).otherwise(""))
    pairs = written(pairs.drop("a_behind", "b_behind", "a_owned", "b_glued"))

    def proposed(df: DataFrame, rule: int, when: Column, relation: Column, confidence: float, by_child: bool) -> DataFrame:
        first, second = ("b", "a") if by_child else ("a", "b")
        sides = [F.col(f"{side}_{c}").alias(f"{name}_{c}") for side, name in (("b", "child"), ("a", "parent")) for c in SIDES]
        return df.where(when).select(*KEY, F.lit(rule).alias("rule"), F.col(f"{first}_rank").alias("one"), F.col(f"{second}_rank").alias("two"), *sides, relation.alias("relation"), F.lit(confidence).alias("confidence"), F.col("a_glued").alias("glued"), "zone")

    owner = b("nominal") & a("nominal") & (apart >= 0) & (apart <= REACH) & a("coarse").isin("ORG", "PER") & (b("label").isin(*ROLES) | b("coarse").isin("PER", "ORG"))
    owned = owner & b("owned")
    last = Window.partitionBy(*KEY, "b_rank").orderBy(F.desc("a_end"), F.desc(F.greatest(F.lit(1), a("end") - a("start"))), "a_rank")
    owners = pairs.where(owned).withColumn("r", F.row_number().over(last)).where("r = 1")
    attempts = [proposed(pairs, *rule) for rule in _rules()] + [proposed(owners, 5, F.lit(True), F.lit("POSS"), 0.70, True)]
    every = reduce(DataFrame.unionByName, attempts)
    judged = every.withColumn("reason", refusal(F.col("relation"))).drop("zone", "glued", "child_place", "parent_place")
    first = Window.partitionBy(*KEY, "child_start", "child_end", F.col("reason").isNull()).orderBy("rule", "one", "two")
    return judged.withColumn("taken", F.col("reason").isNull() & (F.row_number().over(first) == 1)), told


_BEHIND = tuple(f"{p} " for p in PREPOSITIONS)


def _owned(line: str, start: int) -> bool:
    """Whether a possessive stands right before a place."""
    before = line[max(0, start - 8) : start].strip(" ").lower()
    if not before.endswith(POSSESSIVES):
        return False
    return any(before.endswith(p) and (len(before) == len(p) or unicodedata.category(before[-len(p) - 1])[0] not in "LN" and before[-len(p) - 1] != "_") for p in POSSESSIVES)


def _near(batch: pa.RecordBatch, sentence: np.ndarray) -> pa.RecordBatch:
    """The edges that rules propose in some sentences, the spans (as parents) and the lines, a sentence's rows beside each other."""
    is_line = np.asarray(pc.equal(batch.column("side"), "line"))
    there = ~is_line & np.asarray(batch.column("start").is_valid()) & np.asarray(batch.column("end").is_valid())
    line_of = np.full(int(sentence[-1]) + 1, -1)
    line_of[sentence[is_line]] = np.flatnonzero(is_line)
    start, end, pos = (numbers(batch.column(c)) for c in ("start", "end", "pos"))
    own = np.flatnonzero(there & (line_of[sentence] >= 0))
    own = own[np.lexsort((pos[own], (start - end)[own], start[own], sentence[own]))]
    s, low, high = sentence[own], start[own], end[own]
    rank = np.arange(len(own)) - np.searchsorted(s, s) + 1
    lines, quotes = batch.column("line"), batch.column("quotes")
    within = lambda c, values: np.asarray(pc.is_in(batch.column(c), pa.array(values)))[own]
    nominal = np.asarray(pc.fill_null(batch.column("nominal"), False))[own]
    person, source, role, proper = within("coarse", ["ORG", "PER"]), within("coarse", ["ORG", "WORK"]) & nominal, within("label", list(ROLES)), within("label", list(PROPER))
    place, blocks = np.full(len(own), -1), np.zeros(len(line_of), np.int64)
    middle = (low + high) // 2
    for of in np.flatnonzero((line_of >= 0) & (numbers(quotes.value_lengths())[line_of] > 0)).tolist():
        a, b = np.searchsorted(s, [of, of + 1])
        mine = np.flatnonzero(source[a:b]) + a
        for i, q in enumerate(quotes[int(line_of[of])].as_py()):
            able = mine[(high[mine] <= q["from"]) & (q["from"] - high[mine] <= 90)]
            begin = low[able[np.lexsort((low[able], (high - low)[able], high[able]))[-1]]] if len(able) else q["from"]
            inside = (begin <= middle[a:b]) & (middle[a:b] < q["upto"]) & (place[a:b] < 0)
            place[a:b][inside] = i
            blocks[of] += 1
    texts = dict(zip(np.flatnonzero(line_of >= 0).tolist(), lines.take(pa.array(line_of[line_of >= 0])).to_pylist(), strict=True))
    owned = np.array([_owned(texts[x] or "", y) for x, y in zip(s.tolist(), low.tolist(), strict=True)], bool)
    width = int(max(high.max(initial=0), low.max(initial=0))) + REACH + 2
    x, y = spread_out(np.arange(len(own)) + 1, np.searchsorted(s * width + low, s * width + high + REACH, "right") - 1)
    apart = low[y] - high[x]
    able = np.flatnonzero((apart >= 0) & nominal[x] & nominal[y] & person[x] & owned[y] & (role | person)[y])
    owner = np.zeros(len(x), bool)
    owner[able[firsts(y[able], -high[x[able]], -np.maximum(1, (high - low)[x[able]]), rank[x[able]], by=1)]] = True
    held = (apart < 0) & (high[x] >= high[y]) & (low[y] > low[x]) & nominal[x] & nominal[y] & ~proper[y]
    read = np.flatnonzero(owner | held | ((apart >= 0) & ((apart <= 5) | ((apart <= READ) & nominal[y]))))
    x, y, apart, owner, held = x[read], y[read], apart[read], owner[read], held[read]
    zone = [texts[of][a : a + min(n, READ)] if n > 0 and texts[of] else "" for of, a, n in zip(s[x].tolist(), high[x].tolist(), apart.tolist(), strict=True)]
    beside = (apart >= 0) & (apart <= 5)
    beside[beside] = [not zone[i].strip(BESIDE_SIGNS) for i in np.flatnonzero(beside).tolist()]
    words = [z.strip(WHITE).lower() for z in zone]
    behind = (apart >= 0) & (apart <= READ) & np.array([w in PREPOSITIONS or w.startswith(_BEHIND) for w in words], bool)
    plain = np.array([not set(",;.:").intersection(z) for z in zone], bool)
    generic, text = within("label", [*DOCUMENTS, *GENERIC]), pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
    speech = within("label", list(COMMUNICATION)) & np.asarray(pc.is_in(text, pa.array(COMMUNICATION_WORDS)))[own]
    said = within("coarse", ["PER", "ORG", "WORK"])
    gender, number = codes(batch.column("gender"))[own], codes(batch.column("number"))[own]
    agree = lambda c: (c[x] == c[y]) | (c[x] < 0) | (c[y] < 0)
    source_said = speech[x] & said[y]
    # (rule, pairs, relation, confidence, whether edges go by their child first), as _rules says them of columns
    found = [
        (1, beside & role[x] & proper[y], "APPOS", 0.95, False), (1, beside & proper[x] & role[y], "APPOS", 0.88, False), (2, beside & generic[x] & proper[y], "APPOS", 0.90, False),
        (3, nominal[x] & nominal[y] & behind & plain & source_said, "SOURCE", 0.78, False), (3, nominal[x] & nominal[y] & behind & plain & ~source_said, "NMOD", 0.78, False),
        (4, held & agree(gender) & agree(number), "AMOD", 0.88, True), (5, owner, "POSS", 0.70, True), (6, nominal[y] & (apart <= 30) & behind & source_said, "SOURCE", 0.85, False),
    ]
    at = [np.flatnonzero(when) for _, when, *_ in found]
    pair, many = np.concatenate(at), [len(i) for i in at]
    told = lambda i: np.repeat([f[i] for f in found], many)
    x, y, by_child = x[pair], y[pair], told(4).astype(bool)
    # a sentence's edges, spans and line beside each other
    at_span, at_line = np.flatnonzero(~is_line), np.flatnonzero(is_line)
    edges, n = len(pair), len(pair) + len(at_span) + len(at_line)
    order = np.argsort(np.concatenate([s[x], sentence[at_span], sentence[at_line]]), kind="stable")
    one = lambda values, rest: np.concatenate([values, rest])[order]
    masked = lambda v: pa.array(v, mask=v < 0)
    none = np.full(n - edges, -1)
    parent, child = masked(one(own[x], np.concatenate([at_span, np.full(len(at_line), -1)]))), masked(one(own[y], none))
    places = np.full(batch.num_rows, -1)
    places[own] = place
    places, every = masked(places), one(own[x], np.concatenate([at_span, at_line]))
    line = masked(line_of[sentence[every]])
    edge = masked(one(np.arange(edges), none))
    columns = {k: batch.column(k).take(pa.array(every)) for k in KEY} | {"side": pa.array(["edge", "span", "line"]).take(pa.array(one(np.zeros(edges, int), np.repeat([1, 2], [len(at_span), len(at_line)]))))}
    columns |= {"rule": pa.array(told(0).astype(np.int32)).take(edge), "one": pa.array(np.where(by_child, rank[y], rank[x])).take(edge), "two": pa.array(np.where(by_child, rank[x], rank[y])).take(edge)}
    columns |= {f"{name}_{c}": (places if c == "place" else batch.column(c)).take(at) for name, at in (("child", child), ("parent", parent)) for c in SIDES if c != "rank"}
    columns |= {"relation": pa.array(told(2).tolist(), pa.string()).take(edge), "confidence": pa.array(told(3).astype(float)).take(edge), "zone": pa.array([zone[i] for i in pair.tolist()], pa.string()).take(edge)}
    columns |= {"pos": batch.column("pos").take(parent), "role": batch.column("role").take(parent), "glued": batch.column("glued").take(line), "blocks": pa.array(blocks[sentence[every]])}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def laid_edges(rows: DataFrame) -> DataFrame:
    """The edges of nominal_edges, with reason, as rows of side edge beside the spans and lines of their sentence, for taken_edges and those after it.

    rows: side (span or line); spans have pos, start, end, text, label, coarse, gender, number and role, lines have line.
    """
    is_line = F.col("side") == "line"
    given = rows.withColumns(known()).withColumns({"glued": F.when(is_line, glued_at(F.col("line"))).cast("long"), "quotes": F.when(is_line & F.col("line").rlike(QUOTED), quotations(F.col("line")))})
    side = ", ".join(f"{p}_{c} {t}" for p in ("child", "parent") for c, t in (("start", "bigint"), ("end", "bigint"), ("text", "string"), ("label", "string"), ("coarse", "string"), ("nominal", "boolean"), ("place", "bigint")))
    near = worked(given, _near, f"{kinds(rows, *KEY)}, side string, rule int, one bigint, two bigint, {side}, relation string, confidence double, zone string, pos bigint, role string, glued bigint, blocks bigint")
    return near.withColumn("reason", F.when(F.col("side") == "edge", refusal(F.col("relation")))).drop("zone", "child_place", "parent_place")


def _taken(batch: pa.RecordBatch, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, those of them that are taken), as places in the batch."""
    edges = np.flatnonzero(np.asarray(pc.equal(batch.column("side"), "edge")))
    able = edges[np.asarray(batch.column("reason").is_null())[edges]]
    low, high, rule, one, two = (numbers(batch.column(c))[able] for c in ("child_start", "child_end", "rule", "one", "two"))
    return edges, able[firsts(sentence[able], low, high, rule, one, two, by=3)]


def _edges_at(batch: pa.RecordBatch, sentence: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each span the taken edge of its place, or -1."""
    _, taken = _taken(batch, sentence)
    low, high = numbers(batch.column("parent_start")), numbers(batch.column("parent_end"))
    c_low, c_high = numbers(batch.column("child_start")), numbers(batch.column("child_end"))
    width = int(max(low.max(initial=0), high.max(initial=0), c_low.max(initial=0), c_high.max(initial=0))) + 1
    keys = np.append((sentence[taken] * width + c_low[taken]) * width + c_high[taken], -1)
    order = np.argsort(keys)
    wanted = (sentence[spans] * width + low[spans]) * width + high[spans]
    at = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
    return np.where(keys[at] == wanted, np.append(taken, -1)[at], -1)


def taken_edges(edges: DataFrame) -> DataFrame:
    """laid_edges as the attempts of nominal_edges, with taken."""

    def work(batch: pa.RecordBatch, sentence: np.ndarray) -> pa.RecordBatch:
        every, taken = _taken(batch, sentence)
        rows = batch.take(pa.array(every))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.isin(every, taken))], [*rows.schema.names, "taken"])

    rows = edges.where("side = 'edge'")
    return worked(rows, work, f"{kinds(rows, *rows.columns)}, taken boolean")


def laid_parents(edges: DataFrame) -> DataFrame:
    """with_parents of the spans that lie beside their edges: (key, pos, start, end, label) and the parent's columns."""
    told = {"nominal_parent_start": "parent_start", "nominal_parent_end": "parent_end", "nominal_parent_text": "parent_text", "nominal_relation": "relation", "nominal_parent_confidence": "confidence"}

    def work(batch: pa.RecordBatch, sentence: np.ndarray) -> pa.RecordBatch:
        spans = np.flatnonzero(np.asarray(pc.equal(batch.column("side"), "span")))
        edge = _edges_at(batch, sentence, spans)
        own, at = pa.array(spans), pa.array(edge, mask=edge < 0)
        columns = [batch.column(c).take(own) for c in (*KEY, "pos", "parent_start", "parent_end", "parent_label")]
        return pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(at) for c in told.values())], [*KEY, "pos", "start", "end", "label", *told])

    return worked(edges, work, f"{kinds(edges, *KEY)}, pos bigint, start bigint, end bigint, label string, nominal_parent_start bigint, nominal_parent_end bigint, nominal_parent_text string, nominal_relation string, nominal_parent_confidence double")


def laid_review(edges: DataFrame) -> DataFrame:
    """review of the sentences whose lines lie beside their edges."""

    def work(batch: pa.RecordBatch, sentence: np.ndarray) -> pa.RecordBatch:
        lines = np.flatnonzero(np.asarray(pc.equal(batch.column("side"), "line")))
        flagged = np.zeros(int(sentence[-1]) + 1, bool)
        flagged[sentence[np.asarray(pc.is_in(batch.column("reason"), pa.array(CRITICAL)))]] = True
        spans = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(batch.column("role"), "APPOS"), False)) & np.asarray(pc.equal(batch.column("side"), "span")))
        flagged[sentence[spans[_edges_at(batch, sentence, spans) < 0]]] = True
        glued, blocks = batch.column("glued").take(pa.array(lines)), batch.column("blocks").take(pa.array(lines))
        odd = np.asarray(glued.is_valid()) | (np.asarray(blocks) > 0)
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(lines)) for k in KEY), glued, blocks, pa.array(odd | flagged[sentence[lines]]), pa.array(odd)], [*KEY, "glued", "blocks", "needs_review", "not_for_training"])

    return worked(edges, work, f"{kinds(edges, *KEY)}, glued bigint, blocks bigint, needs_review boolean, not_for_training boolean")


def with_parents(spans: DataFrame, attempts: DataFrame) -> DataFrame:
    """spans with nominal_parent_start, _end and _text, nominal_relation and nominal_parent_confidence of their place's edge."""
    edges = attempts.where("taken").select(*KEY, F.col("child_start").alias("start"), F.col("child_end").alias("end"), F.col("parent_start").alias("nominal_parent_start"), F.col("parent_end").alias("nominal_parent_end"), F.col("parent_text").alias("nominal_parent_text"), F.col("relation").alias("nominal_relation"), F.col("confidence").alias("nominal_parent_confidence"))
    return spans.join(edges, [*KEY, "start", "end"], "left")


def review(spans: DataFrame, attempts: DataFrame, told: DataFrame) -> DataFrame:
    """(key, glued, blocks, needs_review, not_for_training) of every sentence with a line.

    A glued line or a source block keeps a sentence from training. A review is needed for these, for an edge refused for a
    critical reason, and for an apposition by its role whose place has no edge.
    """
    refused = attempts.groupBy(*KEY).agg(F.bool_or(F.col("reason").isin(*CRITICAL)).alias("refused"))
    taken = attempts.where("taken").select(*KEY, F.col("child_start").alias("start"), F.col("child_end").alias("end"))
    open_ones = spans.where("role = 'APPOS'").join(taken, [*KEY, "start", "end"], "left_anti").select(*KEY, F.lit(True).alias("open")).distinct()
    odd = F.col("glued").isNotNull() | (F.size("blocks") > 0)
    rows = told.join(refused, KEY, "left").join(open_ones, KEY, "left")
    return rows.select(*KEY, F.col("glued").cast("long").alias("glued"), F.size("blocks").cast("long").alias("blocks"), (odd | F.coalesce("refused", F.lit(False)) | F.coalesce("open", F.lit(False))).alias("needs_review"), odd.alias("not_for_training"))
