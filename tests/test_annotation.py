"""Quotas, label maps, offsets, extensions and feeds against plain definitions, with odd rows."""

from __future__ import annotations

import difflib
import random
from collections import Counter

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from corpusloom.operators import labels as B
from corpusloom.operators import offsets as O
from corpusloom.operators import quotas
from corpusloom.operators.ordering import placed, placed_in
from corpusloom.queries import annotation as A
from corpusloom.storage import scratch
from corpusloom.streaming import feeds


def plain_quotas(rows, rare, quota):
    """Label by label; what quotas give to val and test."""
    counts = Counter(x for _, labels in rows for x in set(labels))
    score = {i: round(sum(len(rows) / (counts[x] * 1000) for x in set(labels)), 6) for i, labels in rows}
    val, test = set(), set()
    for label in sorted((x for x in counts if counts[x] < rare), key=lambda x: (counts[x], x)):
        share, a, b = min(quota, counts[label] // 3), 0, 0
        for i in sorted((i for i, labels in rows if label in labels), key=lambda i: (-score[i], i)):
            if i in val or i in test:
                continue
            if a < share:
                val.add(i)
                a += 1
            elif b < share:
                test.add(i)
                b += 1
    return val, test


@pytest.mark.parametrize("seed", range(4))
def test_quotas_of_the_sequential_definition(spark, seed):
    """Labels that share most of their rows, so that what one takes moves the next."""
    rng = random.Random(seed)
    names = [f"l{i}" for i in range(12)]
    rows = [(i, [x for k, x in enumerate(names) if rng.random() < (0.03 + 0.05 * k if seed < 3 else 0.25)]) for i in range(300)]
    val, test = plain_quotas(rows, 80, 9)
    got = {r.id: r.split for r in quotas.rare_quota_split(spark.createDataFrame(rows, "id long, labels array<string>"), "id", "labels", 80, 9, len(val) + 20, len(test) + 5, 1).collect()}
    assert len(got) == 300 and val and test
    assert val <= {i for i, s in got.items() if s == "val"} and test <= {i for i, s in got.items() if s == "test"}
    assert Counter(got.values()) == {"val": len(val) + 20, "test": len(test) + 5, "train": 300 - len(val) - len(test) - 25}
    small = Counter(r.split for r in quotas.rare_quota_split(spark.createDataFrame(rows, "id long, labels array<string>"), "id", "labels", 80, 9, 1, 0, 1).collect())
    assert small == {"val": len(val), "test": len(test), "train": 300 - len(val) - len(test)}


def test_quotas_of_odd_rows(spark):
    schema = "id long, labels array<string>"
    split = lambda rows: {r.id: r.split for r in quotas.rare_quota_split(spark.createDataFrame(rows, schema), "id", "labels", 10, 2, 1, 1, 1).collect()}
    assert split([]) == {}
    assert Counter(split([(1, None), (2, []), (3, ["a", "a"]), (4, ["b"])]).values()) == {"val": 1, "test": 1, "train": 2}


def test_labels_as_close_matches_finds_them(spark):
    rng = random.Random(2)
    known = ["PERSON", "PLACE", "ORG_NAME", "ORG_ROLE", "TIME", "EVENT", "OBJECT", "aab", "aba", "é"]
    said = {"PERSON", "person", "Org_name", "", "x", "PLACES", "ORGNAME", "abab", "ba", "É", "EVEN", "TIMER OBJECT"}
    for _ in range(400):
        x = list(rng.choice(known))
        for _ in range(rng.randrange(1, 5)):
            x.insert(rng.randrange(len(x) + 1), rng.choice("AEORT_ab")) if rng.random() < 0.5 else x and x.pop(rng.randrange(len(x)))
        said.add("".join(x))
    got = {r.label: (r.mapped, r.how) for r in B.map_labels(spark.createDataFrame([(x,) for x in [*said, *said, None]], "label string"), spark.createDataFrame([(x, i) for i, x in enumerate(known)], "label string, place int")).collect()}
    assert set(got) == said | {None}
    for x in said:
        case = next((k for k in known if k.lower() == x.lower()), None)
        close = difflib.get_close_matches(x, known, n=1, cutoff=0.6)
        assert got[x] == ((x, "same") if x in known else (case, "case") if case else (close[0], "close") if close else (x, "kept")), x


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.75, 1.0])
def test_blocks_lose_no_pair(spark, cutoff):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    said, known = words[::2], words[1::2]
    got = {(r.label, r.known) for r in B.close_labels(*(spark.createDataFrame([(w,) for w in side], "label string") for side in (said, known)), cutoff).collect()}
    assert got == {(a, b) for a in said for b in known if difflib.SequenceMatcher(None, b, a).ratio() >= cutoff}


def plain_repair(text, spans):
    """Row by row with a cursor."""
    starts = [s for _, s, _, _ in spans if s is not None]
    shift = int(bool(starts) and min(starts) >= 1)
    squeezed = lambda x: " ".join(x.split())

    def find(own, at):
        exact = text.find(own, at)
        return exact if exact >= 0 else text.lower().find(own.lower(), at)

    out, cursor = [], 0
    for label, s, e, own in spans:
        begin = end = None
        if s is not None and e is not None:
            if e > s:
                begin, end = s - shift, e - shift
                if own is not None and squeezed(own) != squeezed(text[begin:end]):
                    at = find(own, cursor) if own else -1
                    if at >= 0:
                        begin, end = at, at + len(own)
                        cursor = end
                else:
                    cursor = end
        elif own:
            at = find(own, cursor)
            if at >= 0:
                begin, end = at, at + len(own)
                cursor = end
        if begin is None and own:
            at = find(own, 0)
            if at >= 0:
                begin, end = at, at + len(own)
        if begin is not None:
            out.append((label, begin, end, text[begin:end]))
    return out


def test_offsets_by_cursor(spark):
    rng = random.Random(4)
    text = "Paul saw  Paul and anna, then ANNA saw é Paul 😀 x."
    cases = [[], [("a", 1, 5, "Paul")], [("a", 0, 4, "Paul"), ("a", 11, 3, "Paul"), ("b", None, None, "Paul"), ("c", 2, 9, "anna"), ("c", 2, 9, "Anna"), ("d", 3, 4, ""), ("e", 5, 8, None), ("f", None, 3, None), ("g", 4, 4, "nowhere"), ("h", 0, 90, "saw Paul")]]
    for _ in range(60):
        cases.append([(rng.choice("ab"), rng.choice([None, rng.randrange(0, 45)]), rng.choice([None, rng.randrange(0, 50)]), rng.choice([None, "", "Paul", "paul", "ANNA", "saw  Paul", "saw Paul", "😀", "zz"])) for _ in range(rng.randrange(1, 7))])
    df = spark.createDataFrame([(i, text, c) for i, c in enumerate(cases)], f"id int, text string, spans array<{O.SPAN}>")
    for r in df.select("id", O.repaired_spans(df.text, df.spans).alias("out")).collect():
        assert [(x.label, x.start, x.end, x.text) for x in r.out] == plain_repair(text, cases[r.id]), cases[r.id]
    nothing = df.limit(1).selectExpr("cast(null AS string) AS t", f"cast(null AS array<{O.SPAN}>) AS s")
    assert nothing.select(O.repaired_spans(F.col("t"), F.col("s")).alias("o")).first().o == []


def plain_extend(text, spans, able, neighbour, apart):
    now = [list(s) for s in spans]
    for _ in range(10):
        done = False
        for i, p in enumerate(now):
            if p[2] not in able or p[2] in apart:
                continue
            for j, q in enumerate(now):
                if i == j or q[2] != neighbour or (p[0] <= q[0] and p[1] >= q[1]):
                    continue
                if p[1] <= q[0]:
                    gap, low, high = text[p[1] : q[0]], p[0], q[1]
                elif q[1] <= p[0]:
                    gap, low, high = text[q[1] : p[0]], q[0], p[1]
                else:
                    continue
                if len(gap) > 2 or gap.strip() or any(s[0] < high and s[1] > low for k, s in enumerate(now) if k not in (i, j)):
                    continue
                p[0], p[1], done = low, high, True
                break
            if done:
                break
        if not done:
            break
    return [tuple(s) for s in now]


def test_spans_extended_step_by_step(spark):
    rng = random.Random(6)
    text = "ab cd  ef\tgh ij, kl   mn op qr st uv wx yz"
    words = [(m, m + 2) for m in (0, 3, 7, 10, 13, 17, 22, 25, 28, 31, 34, 37, 40)]
    labels = [*A.EXTENSIBLE[:3], A.NORP, A.NORP, A.NORP, A.APART[0], "other"]
    cases = [[(a, b, rng.choice(labels)) for a, b in sorted(rng.sample(words, rng.randrange(0, 12)))] for _ in range(120)]
    cases += [[(a, b, A.EXTENSIBLE[0] if i == 5 else A.NORP) for i, (a, b) in enumerate(words)], [(0, 2, A.EXTENSIBLE[0]), (0, 2, A.EXTENSIBLE[0]), (3, 5, A.NORP)], [(3, 3, A.NORP), (0, 2, A.EXTENSIBLE[0])]]
    df = spark.createDataFrame([(i, text, c) for i, c in enumerate(cases)] + [(-1, None, [(0, 2, "x")]), (-2, text, None)], "id int, line string, s array<struct<start:bigint,end:bigint,label:string>>")
    got = {r.id: r.s for r in O.extended_spans(df, "line", "s", A.EXTENSIBLE, A.NORP, A.APART).collect()}
    for i, c in enumerate(cases):
        assert [tuple(x) for x in got[i]] == plain_extend(text, c, A.EXTENSIBLE, A.NORP, A.APART), c
    assert got[-2] is None and [tuple(x) for x in got[-1]] == [(0, 2, "x")]


def test_a_broken_stream_goes_on(spark):
    """A run stopped in the middle and begun again gives the rows of one that wasn't, and no file beyond the target is taken."""
    folder = A.feed_files(spark, SF_DIR)
    run = lambda out, mark, target, after=None: feeds.collect_until(spark, folder, A.FEED, out, mark, target, A.LANGS, 40, 300, after)
    whole = sorted(map(tuple, run(scratch(spark, "o"), scratch(spark, "c"), 400).collect()))
    assert len(whole) == 400
    out, mark, seen = scratch(spark, "o"), scratch(spark, "c"), []

    def breaks(number):
        seen.append(number)
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(out, mark, 400, breaks)
    assert seen == [0, 1]
    assert sorted(map(tuple, run(out, mark, 400).collect())) == whole
    assert sorted(map(tuple, run(out, mark, 400).collect())) == whole  # and again: nothing new
    assert run(scratch(spark, "o"), scratch(spark, "c"), 0).count() == 0
    everything = run(scratch(spark, "o"), scratch(spark, "c"), 10**9)
    assert everything.count() == everything.select(*feeds.KEY).distinct().count() > 400


def test_places_without_a_hot_task(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}" if i % 2 else None, i % 50, i) for i in range(500)]
    df = spark.createDataFrame(rows, "grp string, k long, id long").repartition(6)
    got = [r.place for r in placed(df, [F.col("k"), F.col("id")]).orderBy("place").collect()]
    assert got == list(range(500)) and placed(df.limit(0), [F.col("k")]).count() == 0
    by: dict = {}
    for r in placed_in(df, "grp", [F.col("k"), F.col("id")]).collect():
        by.setdefault(r.grp, []).append((r.place, r.k, r.id))
    for g, found in by.items():
        assert [(k, i) for _, k, i in sorted(found)] == sorted((k, i) for x, k, i in rows if x == g) and sorted(p for p, _, _ in found) == list(range(len(found)))
