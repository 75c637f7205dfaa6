"""Round 4: what belongs to a sentence meets where it lies, so a query deals its sentences once and writes no table."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog, storage
from corpusloom.operators import beside as B
from corpusloom.operators import nominal as N
from corpusloom.operators.corpus import downsample, hash_key
from corpusloom.queries import learned
from corpusloom.queries.nominal import LABELS

SPAN = "doc_id long, sent_id long, pos long, start long, end long, text string, label string, coarse string, gender string, number string, role string"
SF_DIR = "/root/testdata/sf0.001"


def test_no_sentence_is_parted():
    rows = [(d, s, i) for d in (1, None, 2) for s in range(3) for i in range((s * 5 + (d or 0)) % 7 + 1)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "sent_id": s, "i": i} for d, s, i in rows])
    for size in (1, 2, 5, 100):
        parts = list(B.whole(batch.slice(i, size) for i in range(0, len(rows), size)))
        assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == rows
        ends = [[(r["doc_id"], r["sent_id"]) for r in (p.to_pylist()[0], p.to_pylist()[-1])] for p in parts]
        assert all(a[1] != b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert list(B.whole(iter([batch.slice(0, 0)]))) == []


def test_first_of_equals():
    kept = B.firsts(np.array([2, 1, 1, 2, 1]), np.array([0, 5, 5, 0, 4]), np.array([9, 8, 7, 6, 5]), by=2)
    assert kept.tolist() == [4, 2, 3]


@pytest.mark.parametrize("name", ["candidates_assembled", "entities_merged", "candidates_from_parse", "nominal_edges_judged", "nominal_parents", "sentences_for_review", "token_contexts", "word_labels_to_spans", "pieces_to_words", "nominal_groups"])
def test_sentences_are_dealt_once(spark, monkeypatch, name):
    """Before, each step shuffled all tokens again and some were written in between."""
    monkeypatch.setattr(storage, "scratch", lambda *_: pytest.fail("a table is written"))
    plan = catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan ") == 1


def test_edges_in_place_are_those_of_joins(spark):
    """Random spans over odd lines: what is worked out where a sentence lies is what joins and windows give."""
    rng = random.Random(5)
    words = ["de ", "du", "son ", "Son", ", ", " ", "Rapport", "«mots» ", "d'", "a", "_leur ", "3 marsLe ", "\u00a0de ", "é", ".", '"b" consulté le 3/4/2020 ']
    lines, spans = [], []
    for i in range(30):
        line = "".join(rng.choice(words) for _ in range(60))
        lines.append((i, 0, line))
        for j in range(40):
            at = rng.randrange(len(line))
            end = min(len(line), at + rng.randrange(12))
            spans.append((i, 0, j, at, end, rng.choice([line[at:end], "Rapport", None]), rng.choice(LABELS), rng.choice([None, None, "PER", "WORK"]), rng.choice([None, "Masc", "Fem"]), rng.choice([None, "Sing"]), rng.choice([None, "APPOS"])))
    spans, lines = spark.createDataFrame(spans, SPAN), spark.createDataFrame(lines, "doc_id long, sent_id long, line string")
    attempts, told = N.nominal_edges(spans, lines)
    edges = N.laid_edges(B.together(span=spans, line=lines))
    names = ["doc_id", "rule", "one", "two", "child_start", "child_end", "child_text", "parent_start", "parent_end", "relation", "confidence", "reason", "taken"]
    same = lambda a, b: Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    ours, theirs = (Counter(map(tuple, x.select(names).collect())) for x in (N.taken_edges(edges), attempts))
    assert ours == theirs and {r[1] for r in ours} == {1, 2, 3, 4, 5, 6}, ([*(ours - theirs)][:4], [*(theirs - ours)][:4], len(ours), {r[1] for r in ours})
    assert same(N.review(spans, attempts, told), N.laid_review(edges))
    parents = N.laid_parents(edges)
    assert same(N.with_parents(spans, attempts).withColumn("label", F.coalesce("label", F.lit(""))).select(parents.columns), parents)


def test_rows_beside_positives(spark):
    """Those kept beside positives are the first in hash order, though only one bucket of hashes is put in order."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 10 == 0).alias("named"))
    kept = downsample(rows, F.col("named"), 3, 42, "key")
    others = sorted((r.h, r.key) for r in rows.where("NOT named").select(hash_key(42, "key").alias("h"), "key").collect())
    assert {r.key for r in kept.collect()} == {k for _, k in others[:900]} | {str(i) for i in range(0, 3000, 10)}
    assert downsample(rows.where("NOT named"), F.col("named"), 3, 42, "key").count() == 0


def test_examples_are_made_where_a_sentence_lies(spark):
    plan = learned.token_examples(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan ") == 1
