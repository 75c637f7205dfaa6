"""Labels, exports and unions of spans that are made where a sentence lies, against plain loops."""

from __future__ import annotations

import random
import re

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pytest
from corpusloom import derived as D
from corpusloom.functions import words as W
from corpusloom.operators import sequences as Q
from corpusloom.sources import files as X
from corpusloom.storage import scratch
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
ODD = ["a  b\tc", "", None, " \n", "é\x0bß\f𝄞x\r", "a b c\x1cd  e", "x", " y "]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _bilou(text, value, most, wanted, kind):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    runs = [(k, n) for n in range(1, most + 1) for k in range(len(words) - n + 1) if value is not None and wanted(k, n, value)]
    labels, reach = ["O"] * len(words), 0
    for k, n in sorted(runs, key=lambda x: (x[0], -x[1])):
        if k >= reach:
            signs = "U" if n == 1 else "B" + "I" * (n - 2) + "L"
            labels[k : k + n] = [f"{sign}-{'PQR'[kind(k, n, value)]}" for sign in signs]
        reach = max(reach, k + n)
    return [{"words": words, "labels": labels}] if runs else []


def test_labels_of_free_runs(monkeypatch):
    rng = random.Random(22)
    texts = ["cut off", *ODD, *[" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 40, 700]))) for _ in range(60)]]
    values = [None if i % 5 == 4 else i for i in range(len(texts))]
    kind = lambda tok, n, value: (tok + n * 2 + value) % 3
    for share in (0, 2, 5, 7):
        wanted = lambda tok, n, value: (tok * 5 + n * 3 + tok // 3 + value) % 7 < share  # noqa: B023, E731
        for size in (7, 1 << 20):
            monkeypatch.setattr(W, "SLICE", size)
            got = W.labelled(pa.array(texts, pa.string())[1:], 4, wanted, kind, ("P", "Q", "R"), pa.array(values, pa.int64())[1:]).to_pylist()
            assert got == [_bilou(t, v, 4, wanted, kind) for t, v in zip(texts[1:], values[1:], strict=True)]
    assert len(W.labelled(pa.array([], pa.string()), 3, wanted, kind, ("P", "Q", "R"), pa.array([], pa.int64()))) == 0


def test_sentences_are_exported_and_read_without_joins_and_lambdas(spark):
    labelled = D.bilou(spark, SF_DIR, 1, 10)
    assert _optimized(labelled).count("Relation") == 1 and "Join" not in _optimized(labelled)
    expected = sorted(map(repr, labelled.select("words", "labels").collect()))
    for compression in ("none", "gzip"):
        place = scratch(spark, "conll")
        X.write_conll(labelled, place, compression)
        read = X.read_conll(spark, place)
        assert "lambdafunction" not in _optimized(labelled) + _optimized(read)
        assert sorted(map(repr, read.collect())) == expected
    assert all(f.endswith(".gz") for f in entry.queries()["conll_round_trip"](spark, SF_DIR).inputFiles())


def test_columns_of_odd_lines(spark, monkeypatch):
    blocks = ["a\tb", "a b c\n\t\n   \nx", "\n one\ttwo\t\nlone", "é 𝄞\tz\r\n  ", "q"]
    expected = []
    for block in blocks:
        cells = [re.split("\t| ", line) for line in block.split("\n") if line.strip(" ")]
        expected.append({"words": [c[0] for c in cells], "labels": [c[-1] for c in cells]})
    for size in (1, 1 << 20):
        monkeypatch.setattr(W, "SLICE", size)
        assert W.cells(pa.array(["cut off", *blocks])[1:]).to_pylist() == [[x] for x in expected]
    assert W.cells(pa.array([], pa.string())).to_pylist() == []


BIO = ("O", "B-P", "I-P", "B-Q", "I-Q")


def _greedy(rows):
    done = ["O"]
    for row in rows or []:
        may = [x[0] != "I" or done[-1] in (f"B-{x[2:]}", x) for x in BIO]
        best = [s if ok and s is not None else float("-inf") for s, ok in zip(row or [None] * 5, may, strict=True)]
        done.append(BIO[best.index(max(best))])
    return None if rows is None else done[1:]


def test_constrained_labels_of_long_lists(spark):
    rng = random.Random(23)
    row = lambda most: [rng.choice([None, 0.0, 1.0, rng.random(), rng.random() * most]) for _ in range(5)]
    inside = lambda n: [[0.0, 1.0, 0.5, 0.2, 0.1]] + [[0.5, 0.0, 1.0, 0.0, 1.0]] * n
    lists = [None, [], [None, [1.0, None, 2.0, None, None], None], inside(3000), inside(1)[1:], [[0.0, 0.0, 0.0, 1.0, 0.0], *inside(1000)[1:]], *[[row(most) for _ in range(n)] for n in (1, 2, 7, 300) for most in (1, 9)]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, s array<array<double>>").repartition(3)
    labels = df.select("id", Q.constrained_labels(F.col("s"), BIO).alias("x"))
    assert "lambdafunction" not in _optimized(labels)
    assert {r.id: r.x for r in labels.collect()} == {i: _greedy(x) for i, x in enumerate(lists)}


def test_constrained_labels_in_slices(monkeypatch):
    rng = random.Random(24)
    lists = [None if n == 3 else [[rng.random() for _ in range(5)] for _ in range(n)] for n in (5, 3, 0, 40, 1, 0, 9)]
    allowed = np.array([[x[0] != "I" or last in (f"B-{x[2:]}", x) for x in BIO] for last in ("O", *BIO)])
    for size in (1, 6, 1 << 20):
        monkeypatch.setattr(W, "SLICE", size)
        assert W.decoded(pa.array([[], *lists], pa.list_(pa.list_(pa.float64())))[1:], BIO, allowed).to_pylist() == [_greedy(x) for x in lists]
    assert W.decoded(pa.array([], pa.list_(pa.list_(pa.float64()))), BIO, allowed).to_pylist() == []


def test_labels_are_constrained_without_lists_of_tokens(spark):
    plan = _optimized(entry.queries()["labels_constrained"](spark, SF_DIR))
    assert "Aggregate" not in plan and "lambdafunction" not in plan


def test_candidates_of_both_sides_lie_together_by_start(spark):
    """A sentence's rows are in one partition, in the order of their starts whatever their side, and its words are read once."""
    rows = entry.queries()["candidates_united"](spark, SF_DIR)
    assert _optimized(rows).count("Relation") == 1
    got = rows.withColumn("part", F.spark_partition_id()).collect()
    assert [tuple(r[:3]) for r in got] == [k[1:] for k in sorted((r.part, *r[:3]) for r in got)]
    mixed = {}
    for r in got:
        mixed.setdefault((r.doc_id, r.sent_id), set()).add(r.part)
    assert {len(x) for x in mixed.values()} == {1} and {r.side for r in got} == {"a", "b"}
    for side, seed, share in (("a", 1, 10), ("b", 2, 6)):
        single = D.spans(spark, SF_DIR, seed, share).select("doc_id", "sent_id", "start", "end").collect()
        assert sorted(map(tuple, single)) == sorted(tuple(r[:4]) for r in got if r.side == side)


def test_runs_without_text_are_the_same(spark):
    texts = pa.array(ODD, pa.string())
    runs = W.runs(texts, 3, lambda tok, n: (tok + n) % 2 == 0).to_pylist()
    assert W.runs(texts, 3, lambda tok, n: (tok + n) % 2 == 0, None, False).to_pylist() == [[{k: v for k, v in r.items() if k != "text"} for r in x] for x in runs]


@pytest.mark.parametrize("name", ["distinct_by_type_and_place", "edges_united"])
def test_copies_are_made_in_place(spark, name):
    """Spans are made once, and copies meet before they are shuffled."""
    plan = _optimized(entry.queries()[name](spark, SF_DIR))
    assert plan.count("Relation") == 1 and "Union" not in plan
