"""Importance resampling, repetition rules and the manifest: brute force, odd rows, ties, repeated rows, empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from test_operators import ROWS, SCHEMA, documents, rows_of

from corpusloom.llm import importance, merkle, repetition
from corpusloom.llm.licenses import TEMPLATES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIGNED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = [("Short text about a license 日本語",), (None,), ("",), ("the the THE",)]


def plain_features(text, longest=2):
    words = SIGNED.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_draw(docs, target, buckets=10_000, longest=2):
    """By row: n_features, weight, score, rank as the definition says them."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [plain_features(t, longest) for _, t in docs]
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    out, able = [], []
    for i, ((doc_id, _), (words, fs)) in enumerate(zip(docs, found, strict=True)):
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            able.append(i)
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for r, i in enumerate(able[: 25 * len(able) // 100]):
        out[i][4] = r + 1
    return Counter(map(tuple, out))


MANY = [(i % 40 if i % 7 else None, f"{'Alpha beta gamma ' * 8} w{i % 11} v{i % 13}") for i in range(90)]  # repeated rows, ids and texts


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("rows", [[r[:2] for r in ROWS], MANY], ids=["odd", "many"])
def test_resampling_by_the_definition(spark, rows, longest):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame(TARGET, "text string")
    scored = importance.importance_scores(docs, target, longest=longest)
    able = scored.selectExpr("doc_id", "if(n_words >= 20, 39, 0) AS n_features", "weight", "n_features AS counted")
    got = Counter((r["doc_id"], r["counted"], r["weight"], r["score"], r["rank"]) for r in rows_of(importance.draw(able)))
    wanted = plain_draw(rows, [t for (t,) in TARGET], longest=longest)
    drop = lambda c: Counter((x[:4] for x in c.elements()))  # noqa: E731  rows alike in score and id get their ranks in any order
    assert drop(got) == drop(wanted) and Counter(x[3:] for x in got.elements()) == Counter(x[3:] for x in wanted.elements())


def test_resampling_without_target_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = {r["doc_id"]: (r["n_features"], r["weight"]) for r in rows_of(importance.importance_scores(docs, none))}
    assert got == {1: (3, math.floor(1000 * math.log(10003 / 20000))), 2: (0, 0)}
    assert importance.draw(importance.importance_scores(docs.limit(0), none)).count() == 0


def test_resampling_gives_way_to_added_names_only(spark):
    scored = importance.importance_scores(documents(spark).selectExpr("*", "1 AS Weight"), spark.createDataFrame(TARGET, "text string"))
    drawn = importance.draw(scored)
    assert drawn.count() == len(ROWS) and {"key", "media", "rank"} <= set(drawn.columns) and "Weight" not in drawn.columns


def plain_repetition(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    lines, seen, line_chars = 0, set(), 0
    for line in text.split("\n"):
        found = WORD.findall(line)
        if found and line in seen:
            lines, line_chars = lines + 1, line_chars + sum(map(len, found))
        seen.add(line)
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": lines, "dup_line_chars": line_chars}
    good = 100 * line_chars <= 20 * chars
    for n in range(2, 11):
        places: dict = {}
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
        if n == 5:
            out["n_repeat_words"] = len({k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + n)})
        if n >= 5:
            out[f"dup_chars_{n}"] = sum(len(words[k]) for k in {k for at in places.values() for i in at[1:] for k in range(i, i + n)})
            good &= 100 * out[f"dup_chars_{n}"] <= repetition.MOST_REPEATED[n] * chars
        else:
            out[f"top_chars_{n}"] = max((len(at) * sum(map(len, w)) for w, at in places.items() if len(at) > 2), default=0)
            good &= 100 * out[f"top_chars_{n}"] <= repetition.MOST_IN_TOP[n] * chars
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    return out | {"kept": good and not out["base_failed"]}


LINED = "one two\nthree\n\none two\n one two\r\none two\nthree\n"
TEXTS = [
    *[r[1] for r in ROWS], LINED, LINED * 3, "\n", "a\n" * 30, " \n \nx\n \nx", "é　ü # $ | <b>", "last line\nlast line", *[" ".join(f"t{(i * i) % k}" for i in range(300)) for k in (7, 31, 64, 97, 151)],
    " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 90}" for i in range(100)),
]


def test_repetition_by_the_definition(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    for r in rows_of(repetition.score_repetition(docs)):
        assert {k: v for k, v in r.items() if k not in ("doc_id", "text")} == plain_repetition(TEXTS[r["doc_id"]]), r["doc_id"]


def test_repetition_of_odd_tables(spark):
    got = rows_of(repetition.score_repetition(documents(spark)))
    assert len(got) == len(ROWS) and all(r["key"] == "clash" and isinstance(r["n_words"], int) for r in got)
    assert repetition.score_repetition(documents(spark, [])).count() == 0


def test_repetition_just_at_its_limit(spark):
    text = " ".join([f"a{i:03d}" for i in range(90)] + [f"a{i:03d}" for i in range(10)])  # 10 of 100 words stood before
    kept = lambda **limits: repetition.score_repetition(spark.createDataFrame([(text,)], "text string"), top={}, **limits).first()["kept"]
    assert kept(repeated={10: 10}) and not kept(repeated={10: 9})


def plain_tree(nodes):
    """The root of a list of digests, and each leaf's siblings by level as (left, right)."""
    paths, now = [[] for _ in nodes], [(n, [i]) for i, n in enumerate(nodes)]
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for run in runs:
            for k, (_, under) in enumerate(run):
                for i in under:
                    paths[i].append(("".join(n for n, _ in run[:k]), "".join(n for n, _ in run[k + 1 :])))
        now = [(hashlib.sha256("".join(n for n, _ in run).encode()).hexdigest(), [i for _, u in run for i in u]) for run in runs]
    return now[0][0], paths


def plain_leaf(row):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()


def plain_manifest(rows, now):
    """rows and today's rows (doc_id, source, lang, n_chars, text)."""
    both = [(r, plain_leaf(r), plain_leaf(n)) for r, n in zip(rows, now, strict=True)]
    groups: dict = {}
    for r, leaf, today in sorted(both, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])):
        groups.setdefault(r[1], []).append((r[0], leaf, today))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([leaf for _, leaf, _ in groups[s]]) for s in order]
    root, above = plain_tree([t[0] for t in trees])
    out = Counter()
    for s, (subroot, paths), up in zip(order, trees, above, strict=True):
        for (doc_id, leaf, folded), path in zip(groups[s], paths, strict=True):
            for left, right in path + up:
                folded = hashlib.sha256((left + folded + right).encode()).hexdigest()
            proof = hashlib.sha256("".join(left + right for left, right in path + up).encode()).hexdigest()
            out[(doc_id, leaf, subroot, root, proof, folded, folded == root)] += 1
    return out


def manifest(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("grp", "n", "pos", "node", "label", "key", "path", "today", "of", "root")})
    tampered = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    found = merkle.prove(merkle.build_manifest(docs.withColumn("text_now", tampered), now={"text": "text_now"}))
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows_of(found))


def both_ways(rows):
    given = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    now = [(*g[:4], g[4].translate(LOWER) if g[4] is not None and g[0] is not None and g[0] % 3 == 0 else g[4]) for g in given]
    return given, now


SIZED = [(i, f"Text {i}", "en", source, i) for k, (source, n) in enumerate([("a", 1), (None, 2), ("B", 16), ("é", 17), ("z", 33), ("hot", 273), ("", 3)]) for i in range(k * 1000, k * 1000 + n)]
LONE = [(7, "Only", None, "a", None)]
SOURCES = [(i, f"T{i}", "en", f"s{i}", 1) for i in range(40)]


@pytest.mark.parametrize("rows", [ROWS, ROWS * 3, SIZED, LONE, SOURCES], ids=["odd", "repeated", "sized", "lone", "sources"])
def test_manifest_by_the_definition(spark, rows):
    assert manifest(spark, rows) == plain_manifest(*both_ways(rows))


def test_manifest_of_nothing(spark):
    assert not manifest(spark, [])


def test_manifest_finds_what_changed(spark):
    got = manifest(spark, SIZED)
    assert {r[0] for r in got if not r[-1]} == {r[0] for r in SIZED if r[0] % 3 == 0}


def test_manifest_keeps_its_levels(spark, tmp_path):
    store = merkle.build_manifest(spark.createDataFrame(SIZED, SCHEMA), folder=str(tmp_path / "store"))
    assert store.heights == (3, 1)
    assert [store.level(0, i).count() for i in range(3)] == [1 + 1 + 2 + 3 + 18 + 1, 1 + 1 + 2, 1]
    assert store.leaves().count() == len(SIZED)


def test_samples_have_their_size(spark):
    """As many rows as asked for, or all there are, however small the share is."""
    from pyspark.sql import functions as F

    from corpusloom.llm.shared import sampled

    rows = spark.range(30_000_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 29_999_000, "many").when(F.col("id") < 29_999_990, "some").otherwise("few").alias("lang"))
    got = {r["lang"]: r["count"] for r in rows_of(sampled(rows, 100, 3, ["doc_id"], ["lang"]).groupBy("lang").count())}
    assert got == {"many": 100, "some": 100, "few": 10}
    assert sampled(rows, 500, 3, ["doc_id"]).count() == 500
    same = spark.range(5000).selectExpr("7L AS doc_id", "'a' AS lang")
    assert sampled(same, 100, 3, ["doc_id"], ["lang"]).count() in (0, 100)
    assert sampled(rows.limit(0), 100, 3, ["doc_id"], ["lang"]).count() == 0 == sampled(rows.limit(0), 100, 3, ["doc_id"]).count()


@pytest.mark.parametrize("count", [10**9, 10**10, 10**13])
def test_samples_of_a_counted_corpus(spark, monkeypatch, count):
    """Stubbed counts: the share that stays in the scan leaves the sample and little more, and never nothing."""
    from corpusloom.llm import shared

    rows, many = spark.range(10), spark.createDataFrame([(count,)], "count long")
    kept, where = [], type(rows).where
    monkeypatch.setattr(type(rows.groupBy()), "count", lambda _: many)
    monkeypatch.setattr(type(rows), "where", lambda df, c: kept.append(c) or where(df, c))
    shared.sampled(rows, 800, 3, ["id"])
    monkeypatch.undo()
    places = spark.createDataFrame([(800 / count,), (1.1 * 800 / count,), (1.4 * 800 / count,)], "__place double")
    assert [r.stays for r in places.select(kept[0].alias("stays")).collect()] == [True, True, False]


NOTICE = dict(TEMPLATES)  # the longest of each label


@pytest.mark.parametrize(("label", "phrase", "times"), [("mit", "permission is hereby", 200), ("bsd", "redistribution and use", 300), ("all-rights-reserved", "all rights reserved", 100), ("gpl", "this program is free software", 150)])
def test_licenses_beside_repeated_phrases(spark, label, phrase, times):
    from corpusloom.llm.licenses import license_spans, scan_licenses

    text, noise = NOTICE[label], " ".join([phrase] * times)
    n, before = len(SIGNED.findall(text.lower())), len(SIGNED.findall(noise))
    docs = spark.createDataFrame([(1, f"{noise} {text}"), (2, f"{text} {noise}"), (3, f"{noise} {text} {noise} {text} {noise}"), (4, noise)], "doc_id long, text string")
    spans = [(r["doc_id"], r["first_word"], r["end_word"]) for r in rows_of(license_spans(docs)) if r["label"] == label and r["cover"] == 1]
    assert {(1, before, before + n), (2, 0, n), (3, before, before + n), (3, 2 * before + n, 2 * before + 2 * n)} <= set(spans)
    labels = {r["doc_id"]: r["labels"].split(",") for r in rows_of(scan_licenses(docs))}
    assert all(label in labels[i] for i in (1, 2, 3)) and label not in labels[4]


def test_licenses_of_one_id(spark):
    from corpusloom.llm.licenses import scan_licenses

    rows = [(1, NOTICE["isc"]), (1, "no license"), (1, NOTICE["isc"]), (None, NOTICE["isc"]), (None, None), (2, "")]
    got = Counter((r["doc_id"], r["labels"]) for r in rows_of(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == {(1, "isc"): 2, (1, ""): 1, (None, "isc"): 1, (None, ""): 1, (2, ""): 1}


def test_media_of_bad_files(spark):
    from corpusloom.llm.media import load_media, store_texts

    docs = spark.createDataFrame([(1, "a text"), (2, "other " * 900)], "doc_id long, text string")
    good = {r["doc_id"]: bytes(r["media"]) for r in rows_of(store_texts(docs))}
    files = [(1, good[1]), (3, None), (4, b""), (5, b"not a picture"), (6, good[2][: len(good[2]) // 2]), (2, good[2]), (7, b"\xff\xd8\xff\xd9"), (8, good[1][:30] + b"\x00" * 400), (1, good[1])]
    stored = spark.createDataFrame([(i, 0, None if f is None else bytearray(f)) for i, f in files], "doc_id long, n_bytes long, media binary").coalesce(1)
    for pixels in (True, False):
        got = rows_of(load_media(stored, with_pixels=pixels))
        assert [r["doc_id"] for r in got] == [i for i, _ in files]
        for r, (_, f) in zip(got, files, strict=True):
            assert r["media_bytes"] == (None if f is None else len(f)) and r["media_sha256"] == (None if f is None else hashlib.sha256(f).hexdigest())
        assert [r["doc_id"] for r in got if r["payload_sha256"]] == [1, 2, 1] and all(r["feature"] for r in got if r["payload_sha256"])
        assert all(r["feature"] is None for r in got if r["doc_id"] in (3, 4, 5, 7))


def test_pipeline_leaves_a_tables_own_columns(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["score", "lang_pred", "n_words", "hit_words", "item_ids", "Text 2", "row", "found", "component_id"]
    wide = docs.selectExpr("*", *[f"concat('own ', doc_id) AS `{c}`" for c in names])
    for name, stage in P.STAGES[:-1]:
        plain = {r["doc_id"] for r in rows_of(stage(spark, docs, sf))}
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns, name
        rows = rows_of(got)
        assert {r["doc_id"] for r in rows} == plain and plain, name
        assert all(r[c] == f"own {r['doc_id']}" for r in rows for c in names), name


def test_windows_that_items_share_are_one_pattern():
    """Windows of the same words once, with all their items; suffixes that many patterns share; finds of all items by a plain search."""
    import random

    import pyarrow as pa

    from corpusloom.llm import wumanber as W
    from corpusloom.llm.words import cut

    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(14))
    items = [" ".join([*(f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 20))), common if k % 3 else "", f"e{k % 4} tail of five words"]) for k in range(60)] + [common] * 5 + ["", "one"]
    tables = W.build(list(range(len(items))), items, 10)
    assert sum(len(g.first) for g in tables.groups) < sum(max(1, len(t.split()) - 9) for t in items if t)
    texts = [" ".join(rng.choices([*items, "x y z", *common.split()], k=6)) for _ in range(40)] + [common, "", "one", f"a {common[:-4]}"]
    words = cut(pa.array(texts), True, True)
    first, length, doc, item = W.search(words, tables)
    windows = {k: [tuple(t.split()[i : i + 10]) for i in range(max(1, len(t.split()) - 9))] for k, t in enumerate(items) if t}
    wanted, hits = set(), set()
    for d, text in enumerate(texts):
        w = text.split()
        for k, ws in windows.items():
            for x in set(ws):
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        wanted.add((d, k))
                        hits |= {(d, j) for j in range(i, i + len(x))}
    assert set(zip(doc.tolist(), item.tolist(), strict=True)) == wanted and len(doc) == len(wanted)
    assert {(int(words.doc[f]), int(f - words.offsets[words.doc[f]]) + j) for f, n in zip(first, length, strict=True) for j in range(n)} == hits


def test_passes_add_up(spark, monkeypatch):
    """Many passes over rows of one id, null ids and repeated rows give what one pass gives, and leave clashing names alone."""
    from corpusloom.llm import wumanber as W

    bench = spark.createDataFrame([(i, f"{'a b c d e f g h i j'[: 2 * i + 1]} k{i % 3}") for i in range(9)] + [(9, "k1 l m"), (9, "x y")], "item_id long, text string")
    rows = [(1, "a b c d e f g h i j k1 l m"), (1, "x y z"), (1, "x y z"), (None, "a k0 b"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS row", "'own' AS key", "1 AS N_WORDS")
    read = lambda: Counter((r["doc_id"], r["text"], r["row"], r["key"], r["n_words"], tuple(r["hit_words"]), tuple(r["item_ids"])) for r in rows_of(W.find_benchmark(docs, bench)))
    whole = read()
    monkeypatch.setattr(W, "PASS_WORDS", 1)
    assert read() == whole and sum(whole.values()) == len(rows) and any(k[5] for k in whole)


def plain_ngrams(text):
    """Counts by slot of a text's 1- to 3-grams, in a dictionary."""
    from corpusloom.llm.language import FEATURES

    signs, kept = [c if c.isalpha() else " " for c in text.lower()], []
    for i, c in enumerate(signs):
        if c != " " or (i and signs[i - 1] != " "):
            kept.append(c)
    chars = [ord(c) for c in [" ", *kept, " "]]
    out: Counter = Counter()
    for a, b, c in zip(chars, chars[1:], chars[2:], strict=False):
        uni = b * 0x9E3779B97F4A7C15
        bi = uni + (c + 1) * 0xC2B2AE3D27D4EB4F
        for x in (uni, bi, bi + (a + 1) * 0x165667B19E3779F9):
            x %= 1 << 64
            x ^= x >> 29
            out[(x * 0xBF58476D1CE4E5B9) % (1 << 64) >> 50] += 1
    assert all(k < FEATURES for k in out)
    return out


def test_languages_by_dictionaries(spark):
    """Document frequencies and predictions of the fitted model, against dictionaries of n-grams and plain sums."""
    from pyspark.sql import functions as F

    from corpusloom.llm.language import fit, identify
    from corpusloom.llm.shared import held_out

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, "Ünïcode, 日本語 😀!", "xx"), (9002, "...", "xx"), (9003, None, "xx"), (9004, "a", None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").union(odd)
    model = fit(rows, ~held_out(F.col("doc_id")))
    every = rows.collect()
    grams = {r.doc_id: plain_ngrams(r.text) if r.text and any(c.isalpha() for c in r.text) else None for r in every}
    learned = [r for r in every if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None and grams[r.doc_id]]
    df = Counter(k for r in learned for k in grams[r.doc_id])
    assert model.classes == sorted({r.lang for r in every if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None})
    for k in (*list(df)[:50], next(i for i in range(len(model.idf)) if i not in df)):
        assert abs(model.idf[k] - (math.log((1 + len(learned)) / (1 + df[k])) + 1)) < 1e-12
    for r in rows_of(identify(rows, model)):
        counts = grams[r["doc_id"]]
        if not counts:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x = {k: (1 + math.log(n)) * model.idf[k] for k, n in counts.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        logits = [(sum(v / size * model.weights[k][c] for k, v in x.items()) + model.bias[c]) / model.temperature for c in range(len(model.classes))]
        p = [math.exp(z - max(logits)) for z in logits]
        best = max(range(len(p)), key=lambda c: p[c])
        assert r["lang_pred"] == model.classes[best] and abs(r["score"] - p[best] / sum(p)) < 1e-9


def test_both_decoders_agree():
    """The reader of own files and the scan-by-scan decoder give the same pixels; the feature by plain sums over them."""
    import random

    from corpusloom.llm import jpeg
    from corpusloom.llm.media import describe

    rng = random.Random(4)
    payloads = [bytes(64), bytes(range(256)) * 2, *(rng.randbytes(64 * rng.randrange(1, 80)) for _ in range(6)), ("prose " * 400).encode()[:2368]]
    files = jpeg.write(payloads)
    own, images = jpeg.read(files)
    assert own == payloads
    for data, image in zip(files, images, strict=True):
        general = jpeg.pixels(jpeg.coefficients(data))
        assert general.shape == image.shape and (general == image).all()
        h, w, _ = image.shape
        px = image.tolist()
        means = [sum(px[y][x][c] for y in range(h) for x in range(w)) * 1000 // (h * w) for c in range(3)]
        down = sum(abs(px[y + 1][x][1] - px[y][x][1]) for y in range(h - 1) for x in range(w)) * 1000 // (h * w)
        across = sum(abs(px[y][x + 1][1] - px[y][x][1]) for y in range(h) for x in range(w - 1)) * 1000 // (h * w)
        assert describe(image) == ";".join(map(str, (h, w, *means, down, across)))


def test_only_what_is_counted_small_is_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpusloom.llm import shared

    monkeypatch.setattr(shared, "SMALL", 100)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few, many = spark.range(90), spark.range(101)
    lists = spark.range(5).select("id", F.sequence(F.lit(1), F.lit(40)).alias("x"))
    assert hinted(shared.settled(few)) and not hinted(shared.settled(many)) and hinted(shared.settled(lists)) and not hinted(shared.settled(lists, "x"))
    assert hinted(shared.settled(lists.limit(0), "x")) and shared.settled(lists, "x").count() == 5
