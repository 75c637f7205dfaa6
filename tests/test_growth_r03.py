"""What findings of the third round on time and tasks were about."""

from __future__ import annotations

import re

import __spark_entry__ as entry
import pyarrow as pa
import pytest
from corpusloom import derived as D
from corpusloom.functions import text as T
from corpusloom.functions import words as W
from corpusloom.queries import annotation as A
from corpusloom.storage import scratch
from corpusloom.streaming import feeds
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
ODD = ["a  b\tc", "", None, " \n", "é\x0bß\f𝄞x\r", "a b c\x1cd  e", "x", " y "]


def _expected(text):
    at, out = 0, []
    for i, w in enumerate(w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w):
        out.append((i, w, at, at + len(w)))
        at += len(w) + 1
    return out


def test_words_of_odd_texts_and_slices(monkeypatch):
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(W, "SLICE", size)
        for texts in (ODD, ODD[1:4], [], [None], ["a"] * 50):
            given = pa.array(["cut off", *texts], pa.string())[1:]
            got = [[(t["tok"], t["word"], t["end"] - len(t["word"]), t["end"]) for t in x] for x in W.tokens(given).to_pylist()]
            assert got == [_expected(x) for x in texts]
            values = pa.array([None if i % 3 == 2 else i for i in range(len(texts))], pa.int64())
            runs = W.runs(given, 3, lambda tok, n, value: (tok + n + value) % 2 == 0, values).to_pylist()
            for i, (text, found) in enumerate(zip(texts, runs, strict=True)):
                t = _expected(text)
                want = [(k, n, t[k][2], t[k + n - 1][3], " ".join(x[1] for x in t[k : k + n])) for n in (1, 2, 3) for k in range(len(t) - n + 1) if i % 3 != 2 and (k + n + i) % 2 == 0]
                assert [tuple(r.values()) for r in found] == want


def test_tokens_and_spans_need_no_lambda_a_word(spark):
    """Lambdas of columns are interpreted for each word."""
    for rows in (D.tokens(spark, SF_DIR), D.spans(spark, SF_DIR, 1, 10), D.sentences(spark, SF_DIR)):
        assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_trim_takes_white_space_only(spark):
    rows = spark.createDataFrame([(" \ta b\r\n\x0b\f ",), ("a  ",), (" a",), (" ",), (None,)], "text string")
    assert [r[0] for r in rows.select(T.trim(F.col("text"))).collect()] == ["a b", "a  ", " a", "", None]


@pytest.mark.parametrize("name", ["events_annotated", "appositions_patched", "event_assembly", "null_subjects_filled", "triplets_by_place", "roles_reviewed", "review_outcomes", "relaxed_scores", "labels_matched", "span_extensions_applied"])
def test_spans_that_are_read_several_times_are_made_once(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") <= 1


def test_no_task_writes_a_whole_feed(spark, tmp_path):
    rows = [(i, f"Entry {i} of a feed that has sentences long enough to count. And short ones.", "en", f"src{i % 2}", 70) for i in range(400)] + [(400, "x", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    folder = A.feed_files(spark, str(tmp_path))
    for place in [r[0] for r in spark.read.json(folder).select(feeds.PARTS).collect()]:
        assert len(spark.read.json(place).inputFiles()) == 4
    direct = scratch(spark, "direct")
    for part in (0, 1):
        A.feed_entries(spark, str(tmp_path)).where(F.col("feed") == part).coalesce(1).write.mode("append").json(direct)
    got, plain = (sorted(map(tuple, feeds.collect_until(spark, f, A.FEED, scratch(spark, "o"), scratch(spark, "c"), 250, A.LANGS, 40, 300).collect())) for f in (folder, direct))
    assert got == plain and len(got) == 250 and {r[0] for r in got} == {0, 1}


def test_first_of_very_many_equal_sentences_is_found_before_they_meet(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("feed"), F.col("id").alias("entry"), F.lit(0).alias("pos"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, "en").alias("lang"), F.lit("same").alias("text"))
    found = feeds.first_new(rows, None, [F.col("feed"), F.col("entry")])
    assert found.columns == rows.columns and sorted((r.feed, r.entry, r.lang or "") for r in found.collect()) == [(0, 0, "en"), (0, 7, "")]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
