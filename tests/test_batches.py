"""Batches, contexts and exact search by blocks against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ann as A
from corpusloom.operators import corpus as C
from corpusloom.operators import retrieval as R
from corpusloom.operators import sequences as Q


def plain_batches(rows, most, most_bytes):
    out, batch, count, size = [], 0, 0, 0
    for o, n in sorted(rows):
        if count and (count >= most or size + n > most_bytes):
            batch, count, size = batch + 1, 0, 0
        out.append((o, batch))
        count, size = count + 1, size + n
    return out


@pytest.mark.parametrize(("most", "most_bytes"), [(8, 100), (3, 10_000), (5, 1), (1, 50)])
def test_batches_of_long_groups(spark, monkeypatch, most, most_bytes):
    """Groups of many stretches, one of them hot, with rows larger than a batch."""
    monkeypatch.setattr(Q, "STRETCH", 16)
    rng = random.Random(most)
    groups = {"hot": 700, "few": 3, "sixteen": 16, "seventeen": 17, None: 40}
    rows = [(g, i, rng.choice([1, 5, 20, 60, 300])) for g, n in groups.items() for i in range(n)]
    got: dict = {}
    for r in Q.packed_batches(spark.createDataFrame(rows, "g string, i long, size long").repartition(5), "g", "i", F.col("size"), most, most_bytes).collect():
        got.setdefault(r.g, []).append((r.i, r.batch))
    assert {g: sorted(v) for g, v in got.items()} == {g: plain_batches([(i, n) for x, i, n in rows if x == g], most, most_bytes) for g in groups}


def test_no_rows_no_batches(spark):
    assert Q.packed_batches(spark.createDataFrame([], "g string, i long, size long"), "g", "i", F.col("size"), 8, 100).count() == 0


def test_contexts_of_a_frequent_key(spark):
    rows = [("hot", i, f"t{i}") for i in range(500)] + [(None, 1, "n"), ("one", 2, "o")]
    got = {r.k: (r.n, r.contexts) for r in C.first_contexts(spark.createDataFrame(rows, "k string, i int, t string").repartition(6), ["k"], [F.col("i")], F.col("t")).collect()}
    assert got == {"hot": (500, "t0 / t1"), None: (1, "n"), "one": (1, "o")}


def test_exact_search_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "ROW_BLOCK", 40)
    monkeypatch.setattr(A, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 5)), np.zeros((3, 5)), np.repeat(rng.normal(size=(1, 5)), 60, 0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(4)
    got: dict = {}
    for r in R.top_k_batched(df.where("id % 9 = 0").withColumnRenamed("id", "q"), df, 4, "q", "id", "v").orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    u = A.units(x.astype(np.float64))
    s = np.round(u @ u.T, 9)
    assert got == {q: np.lexsort((np.arange(len(x)), -s[q]))[:4].tolist() for q in range(0, len(x), 9)}
