"""What the findings of the third round were about."""

from __future__ import annotations

import os
import urllib.parse

from corpusloom.functions import text as T
from corpusloom.operators import expansions as X
from corpusloom.operators import nominal as N
from corpusloom.operators import spans as S
from corpusloom.storage import written
from pyspark.sql import functions as F


def test_capital_of_several_letters_stays(spark):
    rows = spark.createDataFrame([("ßa b",), ("éa",), ("x",), ("",), (None,)], "text string")
    assert [r[0] for r in rows.select(T.capitalised(F.col("text"))).collect()] == ["ßa b", "Éa", "X", "", None]


def test_tokens_and_runs_are_made_without_a_shuffle(spark):
    text = "  ".join(f"w{i}é" for i in range(200))
    rows = spark.createDataFrame([(1, 0, text), (2, 0, " a\tbc "), (3, 0, " "), (4, 1, None)], "doc_id long, sent_id int, text string")
    toks = S.tokens(rows)
    assert "Exchange" not in toks._jdf.queryExecution().executedPlan().toString()
    at = 0
    for i, r in enumerate(toks.where("doc_id = 1").orderBy("tok").collect()):
        assert (r.tok, r.word, r.start, r.end) == (i, f"w{i}é", at, at + len(r.word))
        at = r.end + 1
    found = {(r.doc_id, r.tok, r.n, r.start, r.end, r.text) for r in S.runs(rows, 3, lambda tok, n: (tok + n) % 2 == 0).collect()}
    assert found == {(r.doc_id, r.tok, r.n, r.start, r.end, r.text) for r in S.ngrams(toks, 3).where("(tok + n) % 2 = 0").collect()}


def test_walks_below_spans_need_no_join_a_step(spark):
    chain = [(1, 0, i, i - 1, "nmod", "NOUN") for i in range(2, 60)] + [(1, 0, 1, 0, "root", "NOUN"), (1, 0, 60, 61, "nmod", "NOUN"), (1, 0, 61, 60, "nmod", "NOUN")]
    tokens = spark.createDataFrame(chain, "doc_id long, sent_id int, tok_id long, head long, deprel string, upos string")
    seeds = spark.createDataFrame([(1, 0, 5, 5), (1, 0, 60, 60), (1, 0, 7, 9)], "doc_id long, sent_id int, first long, tok_id long")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    rows = X.below(tokens, seeds, F.col("deprel") == "nmod", lambda span, new: new["tok_id"] != span["first"] + 30)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    found = {}
    for r in rows.collect():
        found.setdefault(r.first, []).append(r.tok_id)
    assert {k: sorted(v) for k, v in found.items()} == {5: list(range(5, 35)), 60: [60, 61], 7: list(range(9, 37))}


def test_pairs_of_spans_dont_carry_their_line(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "written", lambda df: seen.append(set(df.columns)) or df)
    spans = spark.createDataFrame([(1, 0, 0, 0, 3, "abc", "hint_person_role", None, None, None, None)], "doc_id long, sent_id int, pos long, start long, end long, text string, label string, coarse string, gender string, number string, role string")
    N.nominal_edges(spans, spark.createDataFrame([(1, 0, "abc def")], "doc_id long, sent_id int, line string"))
    assert not any({"a_start", "line"} <= columns for columns in seen)
    assert any("a_start" in columns for columns in seen)


def test_written_tables_are_compressed(spark):
    rows = spark.range(200_000).select(F.col("id"), F.lit("NOUN").alias("upos"), F.lit(None).cast("string").alias("none"))
    files = written(rows).inputFiles()
    assert files and sum(os.path.getsize(urllib.parse.urlparse(f).path) for f in files) < 2_000_000
    assert sorted(written(rows.limit(3)).collect()) == sorted(rows.limit(3).collect()) and written(rows.limit(0)).count() == 0
