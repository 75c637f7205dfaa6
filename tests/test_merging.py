"""Entities merged with parses made by hand, and odd rows."""

from __future__ import annotations

import pytest
from conftest import SF_DIR

from corpusloom.operators import merging as M
from corpusloom.queries import merging as Q

TOKEN = "doc_id long, sent_id long, tok_id long, head long, word string, upos string, deprel string, start long, end long"
SPAN = "doc_id long, sent_id long, start long, end long, type string"


def tokens(number, line, parsed):
    rows, at = [], 0
    for i, (word, head, upos, deprel) in enumerate(parsed, 1):
        at = line.index(word, at)
        rows.append((number, 0, i, head, word, upos, deprel, at, at + len(word)))
        at += len(word)
    return rows


CASES = [
    ("général De Gaulle", "per", [("général", 0, "NOUN", "root"), ("De", 1, "PROPN", "flat:name"), ("Gaulle", 2, "PROPN", "flat:name")], {"role": "général", "name": "De Gaulle"}),
    ("Général de Gaulle", "PER", [("Général", 0, "NOUN", "root"), ("de", 3, "ADP", "case"), ("Gaulle", 1, "PROPN", "nmod")], {"role": "Général", "name": "de Gaulle"}),
    ("président Hollande", "per", [("président", 0, "NOUN", "root"), ("Hollande", 1, "PROPN", "appos")], {"role": "président", "name": "Hollande"}),
    ("Premier ministre Jean Castex", "per", [("Premier", 2, "ADJ", "amod"), ("ministre", 0, "NOUN", "root"), ("Jean", 2, "PROPN", "appos"), ("Castex", 3, "PROPN", "flat:name")], {"role": "Premier ministre", "name": "Jean Castex"}),
    ("Assemblée nationale", "per", [("Assemblée", 0, "NOUN", "root"), ("nationale", 1, "ADJ", "amod")], {"role": None, "name": None, "trimmed": "Assemblée nationale"}),
    ("Cour de cassation", "per", [("Cour", 0, "NOUN", "root"), ("de", 3, "ADP", "case"), ("cassation", 1, "NOUN", "nmod")], {"role": None, "trimmed": "Cour de cassation"}),
    ("la place de la République", "loc", [("la", 2, "DET", "det"), ("place", 0, "NOUN", "root"), ("de", 5, "ADP", "case"), ("la", 5, "DET", "det"), ("République", 2, "PROPN", "nmod")], {"trimmed": "place de la République"}),
    ("vol AF447 annulé", "object", [("vol", 0, "NOUN", "root"), ("AF447", 1, "PROPN", "flat"), ("annulé", 1, "ADJ", "acl")], {"trimmed": "vol AF447 annulé", "reconstructed": "vol AF447"}),
    ("la police,", "org", [("la", 2, "DET", "det"), ("police", 0, "NOUN", "root"), (",", 2, "PUNCT", "punct")], {"trimmed": "police"}),
    ("mange", "per", [("mange", 0, "VERB", "root")], None),
    ("elle", "org", [("elle", 0, "PRON", "root")], None),
    ("elle", "per", [("elle", 0, "PRON", "root")], {"trimmed": "elle"}),
    ("de la", "org", [("de", 0, "ADP", "case"), ("la", 1, "DET", "det")], None),
]


def test_entities_parsed_by_hand(spark):
    rows = [r for i, (line, _, parsed, _) in enumerate(CASES) for r in tokens(i, line, parsed)]
    spans = [(i, 0, 0, len(line), kind) for i, (line, kind, _, _) in enumerate(CASES) for _ in range(2)]  # each twice: one
    got: dict = {}
    for r in M.merge_entities(spark.createDataFrame(rows, TOKEN), spark.createDataFrame(spans, SPAN)).collect():
        assert r.source not in got.setdefault(r.doc_id, {})
        got[r.doc_id][r.source] = CASES[r.doc_id][0][r.start : r.end]
    for i, (line, _, _, wanted) in enumerate(CASES):
        if wanted is None:
            assert i not in got, line
        else:
            assert {k: got[i].get(k) for k in wanted} == wanted, (line, got[i])


@pytest.mark.parametrize(("parsed", "line", "source", "span", "wanted"), [
    ([("place", 0, "NOUN", "root"), ("de", 4, "ADP", "case"), ("la", 4, "DET", "det"), ("République", 1, "PROPN", "nmod")], "place de la République", "noun_de_chain", (0, 5), "place de la République"),
    ([("vol", 0, "NOUN", "root"), ("AF447", 1, "X", "appos"), ("du", 4, "ADP", "case"), ("soir", 1, "NOUN", "nmod")], "vol AF447 du soir", "noun_code", (0, 3), "vol AF447"),
    ([("ministre", 0, "NOUN", "root"), ("Jean", 1, "PROPN", "appos"), ("Castex", 2, "PROPN", "flat:name")], "ministre Jean Castex", "reconstructed", (0, 8), "ministre Jean Castex"),
])
def test_spans_grow_along_the_tree(spark, parsed, line, source, span, wanted):
    found = M.merge_entities(spark.createDataFrame(tokens(1, line, parsed), TOKEN), spark.createDataFrame([(1, 0, *span, "object")], SPAN)).collect()
    grown = {line[r.start : r.end]: r.source for r in found}
    assert wanted in grown and (grown[wanted] == source or M.SOURCES.index(grown[wanted]) < M.SOURCES.index(source))


def test_odd_spans(spark):
    df = spark.createDataFrame(tokens(1, "la police", [("la", 2, "DET", "det"), ("police", 0, "NOUN", "root")]), TOKEN)
    spans = [(1, 0, 100, 108, "loc"), (1, 0, 5, 5, "loc"), (2, 0, 0, 3, "per"), (1, 0, 4, 6, "org")]
    got = {(r.doc_id, r.start, r.end, r.source) for r in M.merge_entities(df, spark.createDataFrame(spans, SPAN)).collect()}
    assert got == {(1, 100, 108, "unchanged"), (1, 5, 5, "unchanged"), (2, 0, 3, "unchanged"), (1, 3, 9, "trimmed")}
    assert M.merge_entities(df.limit(0), spark.createDataFrame(spans, SPAN)).count() == 4
    assert M.merge_entities(df, spark.createDataFrame([], SPAN)).count() == 0


def test_uncovered_places(spark):
    import random

    rng = random.Random(3)
    make = lambda n: [(d, 0, s, s + rng.randrange(1, 9)) for d in range(6) for s in rng.sample(range(60), n)]
    rows, cover = make(12), make(4)
    shape = "doc_id long, sent_id long, start long, end long"
    got = {tuple(r) for r in M.not_covered(spark.createDataFrame(rows, shape), spark.createDataFrame(cover, shape)).collect()}
    assert got == {r for r in rows if not any(c[0] == r[0] and c[2] < r[3] and c[3] > r[2] for c in cover)}


def test_sentences_are_read_once(spark, monkeypatch):
    """Both branches take the parse from one written table: its parsing runs for one job, and the plan reads no document for it."""
    parse = Q.parsed(spark, SF_DIR)
    reads = []
    monkeypatch.setattr(M, "written", lambda df, put=M.written: reads.append(df) or put(df))
    ents = spark.createDataFrame([(1, 0, 0, 5, "per")], SPAN)
    simple = spark.createDataFrame([(1, 0, 6, 9, "GPE")], SPAN.replace("type", "label"))
    found = M.candidates(parse, ents, simple)
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in reads]
    assert scans[0] == 1 and sum(scans) == 1  # later tables come from written ones
    assert "Relation [" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0
