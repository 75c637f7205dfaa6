"""Further corpus steps: keys and priorities, thresholds in three dimensions, shares, pieces of words, audits, feeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derived as D
from ..functions import text as T
from ..operators import metrics as M
from ..operators import sequences as Q
from ..operators import spans as S
from ..plans.runner import tokens_chunker
from ..registry import query, table
from ..sources.stores import without_nulls

K = "doc_id, sent_id"
ONE = D.with_spans(("ent", 1, 10))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 1, 10)


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, len(w), 50)) AS first FROM w) SELECT doc_id, first // 50 AS pos, doc_id || '_sent_' || (first // 50) AS id, array_to_string(w[first + 1:first + 50], ' ') AS text FROM p")
def chunks_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 50 tokens."""
    return tokens_chunker(50)(_docs(spark, sf_dir).select("doc_id", "text"))


@query(f"WITH {ONE}, u AS (SELECT {K}, coarse, \"start\", \"end\", lower(text) AS key, row_number() OVER (PARTITION BY {K}, coarse, \"start\", \"end\", lower(text) ORDER BY score DESC, fine) AS r, fine FROM ent) SELECT {K}, coarse, \"start\", \"end\", key, fine FROM u WHERE r = 1")
def distinct_by_type_and_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans once by type, place and lower-case text, the surest of each."""
    rows = _ent(spark, sf_dir).withColumns({"key": F.lower("text"), "score": F.explode(F.array(F.col("score"), F.col("score") - 1))})
    found = rows.groupBy(*S.KEY, "start", "end", "coarse", "key").agg(F.max_by("fine", F.struct("score", "fine")).alias("fine"))  # numbers first: strings are compared only where these are equal
    return found.select(*S.KEY, "coarse", "start", "end", "key", "fine")


@query(f"WITH {D.SENTENCES_SQL} SELECT lower(text) AS key, min(text) AS text, count(*) AS n FROM sentences GROUP BY lower(text)")
def distinct_by_lower_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences once whatever their case."""
    return D.sentences(spark, sf_dir).groupBy(F.lower("text").alias("key")).agg(F.min("text").alias("text"), F.count("*").alias("n"))


@query(r"WITH u AS (SELECT doc_id AS id, text, 0 AS priority FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id + 1000000, upper(substr(text, 1, 1)) || substr(text, 2) || '  ', 1 FROM documents), k AS (SELECT *, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS key FROM u) SELECT key, arg_min(id, (priority, id)) AS id, min(priority) AS priority FROM k GROUP BY key")
def corpora_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known corpus and a new one, each normalised text once; the known one wins."""
    docs = _docs(spark, sf_dir)
    changed = F.concat(T.capitalised(F.col("text")), F.lit("  "))
    both = docs.where("lang = 'en'").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("priority")).union(docs.select(F.col("doc_id") + 1000000, changed, F.lit(1)))
    return both.groupBy(T.normalize(F.col("text")).alias("key")).agg(F.min_by("id", F.struct("priority", "id")).alias("id"), F.min("priority").alias("priority"))


@query("SELECT doc_id FROM documents WHERE trim(text) NOT IN (SELECT trim(text) FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL)")
def held_out_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose trimmed text no held-out document (every tenth) has."""
    docs = _docs(spark, sf_dir).withColumn("key", F.trim("text"))
    return docs.join(docs.where("doc_id % 10 = 0").select("key").distinct(), "key", "left_anti").select("doc_id")


@query(f"WITH {ONE}, s AS (SELECT doc_id, sum(1.0 / (1 + n)) AS score FROM ent GROUP BY doc_id), r AS (SELECT *, percent_rank() OVER (ORDER BY round(score, 6)) AS p FROM s) SELECT doc_id FROM s WHERE round(score, 6) >= (SELECT quantile_disc(round(score, 6), 0.7) FROM s) AND score >= 2")
def rarest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tenths of documents with the highest scores, and at least 2: a threshold is computed, and no rows are ranked."""
    scores = _ent(spark, sf_dir).groupBy("doc_id").agg(F.sum(1 / (1 + F.col("n"))).alias("score"))
    bound = scores.agg(F.expr("percentile_disc(0.7) WITHIN GROUP (ORDER BY round(score, 6))").alias("bound"))  # one row
    return scores.join(F.broadcast(bound)).where((F.round("score", 6) >= F.col("bound")) & (F.col("score") >= 2)).select("doc_id")


@query(
    f"""WITH {ONE}, g AS (SELECT score, ((tok * 13 + doc_id) % 100) / 100.0::DOUBLE AS b, ((tok * 29 + n * 7 + doc_id) % 100) / 100.0::DOUBLE AS f, (doc_id + tok) % 3 = 0 AS gold FROM ent), t AS (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS x), c AS (SELECT tb.x AS tb, tc.x AS tc, tf.x AS tf, count(*) FILTER (gold AND ok) AS tp, count(*) FILTER (NOT gold AND ok) AS fp, count(*) FILTER (gold AND NOT ok) AS fn FROM (SELECT *, 1 FROM t) tb, t tc, t tf, LATERAL (SELECT gold, b >= tb.x AND score >= tc.x AND f >= tf.x AS ok FROM g) GROUP BY ALL)
    SELECT tb, tc, tf, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM c"""
)
def threshold_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over a grid of three thresholds. Rows are first counted by which thresholds they pass, so the grid meets a few counts."""
    rows = _ent(spark, sf_dir).select("score", F.expr("((tok * 13 + doc_id) % 100) / 100.0D").alias("b"), F.expr("((tok * 29 + n * 7 + doc_id) % 100) / 100.0D").alias("f"), F.expr("(doc_id + tok) % 3 = 0").alias("gold"))
    grid = (0.2, 0.5, 0.8)
    passed = lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in grid]), lambda x: F.col(c) >= x))
    counts = rows.groupBy(passed("b").alias("pb"), passed("score").alias("pc"), passed("f").alias("pf"), "gold").agg(F.count("*").alias("n"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in range(3) for j in range(3) for k in range(3)])
    met = counts.withColumn("c", F.explode(cells)).withColumn("ok", (F.col("pb") > F.col("c.i")) & (F.col("pc") > F.col("c.j")) & (F.col("pf") > F.col("c.k")))
    total = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    sums = met.groupBy("c").agg(total(F.col("gold") & F.col("ok")).alias("tp"), total(~F.col("gold") & F.col("ok")).alias("fp"), total(F.col("gold") & ~F.col("ok")).alias("fn"))
    of = lambda name: F.get(F.array(*[F.lit(x) for x in grid]), F.col(f"c.{name}"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return sums.select(of("i").alias("tb"), of("j").alias("tc"), of("k").alias("tf"), F.round(f1, 9).alias("f1"))


@query(f"WITH {ONE}, g AS (SELECT *, ((tok * 13 + doc_id) % 100) / 100.0::DOUBLE AS b, (tok + n) % 4 = 0 AS anchored FROM ent) SELECT {K}, tok, n, round(b * score, 9) AS product FROM g WHERE b >= CASE WHEN anchored THEN 0.5::DOUBLE * 0.6::DOUBLE ELSE 0.5::DOUBLE END AND score >= CASE WHEN anchored THEN 0.4::DOUBLE * 0.85::DOUBLE ELSE 0.4::DOUBLE END")
def anchored_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that spans anchored by an argument pass with less."""
    rows = _ent(spark, sf_dir).withColumns({"b": F.expr("((tok * 13 + doc_id) % 100) / 100.0D"), "anchored": F.expr("(tok + n) % 4 = 0")})
    ok = F.expr("b >= CASE WHEN anchored THEN 0.5D * 0.6D ELSE 0.5D END AND score >= CASE WHEN anchored THEN 0.4D * 0.85D ELSE 0.4D END")
    return rows.where(ok).select(*S.KEY, "tok", "n", F.round(F.col("b") * F.col("score"), 9).alias("product"))


@query("SELECT vec_id, round(exp(embedding[1]::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 9) AS first, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 9) AS sigmoid FROM embeddings")
def plain_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax without a shift, and the sigmoid."""
    x = F.get("embedding", F.lit(0)).cast("double")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.exp(v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.exp(x) / total, 9).alias("first"), F.round(1 / (1 + F.exp(-x)), 9).alias("sigmoid"))


@query("WITH u AS (SELECT doc_id, ('0x' || substr(md5('11' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, source FROM documents), m AS (SELECT *, min(u) OVER (PARTITION BY source) AS least FROM u) SELECT doc_id, CASE WHEN u < 0.2 OR u = least THEN 'val' ELSE 'train' END AS split FROM m")
def split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of rows, and at least one of each source, held out by a seeded hash."""
    from ..operators.corpus import hash_unit

    rows = _docs(spark, sf_dir).select("doc_id", "source", hash_unit(11, "doc_id").alias("u"))
    least = rows.groupBy("source").agg(F.min("u").alias("least"))
    return rows.join(least, "source").select("doc_id", F.when((F.col("u") < 0.2) | (F.col("u") == F.col("least")), "val").otherwise("train").alias("split"))


@query(f"WITH {D.SENTENCES_SQL}, {D.TOKENS_SQL} SELECT {K}, word, tok % 3 AS label FROM toks")
def pieces_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut in pieces of three signs, the first marked, put together again with the first piece's label."""
    toks = D.tokens(spark, sf_dir)
    starts = F.sequence(F.lit(0), F.length("word") - 1, F.lit(3))
    pieces = toks.select(*S.KEY, "tok", "word", F.posexplode(starts).alias("p", "at"))
    piece = F.concat(F.when(F.col("p") == 0, "▁").otherwise(""), F.expr("substring(word, at + 1, 3)"))
    rows = pieces.select(*S.KEY, piece.alias("piece"), F.when(F.col("p") == 0, F.col("tok") % 3).alias("label"))
    return Q.words_of_pieces(rows)


WORDS = ("tion", "que", "ment")


@query(
    r"""WITH f AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents), h AS (SELECT doc_id, t, unnest(['tion', 'que', 'ment']) AS word FROM f), n AS (SELECT *, instr(t, word) AS place FROM h WHERE contains(t, word)), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, t) AS r FROM n)
    SELECT word, count(*) AS n, list(substr(t, greatest(place - 35, 1), least(place - 1, 35) + length(word) + 35) ORDER BY doc_id, t) FILTER (r <= 2) AS contexts FROM r GROUP BY word"""
)
def keyword_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with folded accents: in how many documents, and two contexts of 35 signs on each side. A task keeps its two first."""
    rows = _docs(spark, sf_dir).select("doc_id", T.fold_accents(F.col("text")).alias("t")).withColumn("word", F.explode(F.array(*[F.lit(w) for w in WORDS]))).where(F.contains("t", F.col("word")))
    at = F.instr("t", F.col("word"))
    context = F.substring("t", F.greatest(at - 35, F.lit(1)), F.least(at - 1, F.lit(35)) + F.length("word") + 35)
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("word").orderBy("doc_id", "t")
    first = rows.select("word", "doc_id", "t", context.alias("c")).withColumn("r", F.row_number().over(w)).where("r <= 2")
    lists = first.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: x["c"]).alias("contexts"))
    return counts.join(lists, "word")


@query("SELECT doc_id, text, lang AS label FROM documents")
def rows_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name their text and label in three ways, in one schema."""
    docs = _docs(spark, sf_dir)
    k = F.col("doc_id") % 3
    raw = docs.select("doc_id", F.when(k == 0, F.col("text")).alias("text"), F.when(k == 1, F.col("text")).alias("phrase"), F.when(k == 2, F.struct(F.col("text").alias("sentence"))).alias("data"), F.when(k == 0, F.col("lang")).alias("label"), F.when(k != 0, F.col("lang")).alias("hint"))
    return raw.select("doc_id", F.coalesce("text", "phrase", "data.sentence").alias("text"), F.coalesce("label", "hint").alias("label"))


@query("SELECT 'http://feed/' || source AS url, min(lang) AS lang FROM documents GROUP BY source")
def feeds_from_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of OPML outlines, each address once."""
    rows = _docs(spark, sf_dir).groupBy("source").agg(F.min("lang").alias("lang"))
    outline = F.concat(F.lit('<outline type="rss" xmlUrl="http://feed/'), "source", F.lit('" language="'), "lang", F.lit('"/>'))
    lines = rows.select(outline.alias("line")).union(rows.select(outline.alias("line")))
    return lines.select(F.regexp_extract("line", 'xmlUrl="([^"]*)"', 1).alias("url"), F.regexp_extract("line", 'language="([^"]*)"', 1).alias("lang")).dropDuplicates(["url"])


@query("SELECT doc_id, lang AS lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents")
def metadata_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata maps without null values."""
    meta = without_nulls(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))))
    return _docs(spark, sf_dir).select("doc_id", F.try_element_at(meta, F.lit("lang")).alias("lang"), F.try_element_at(meta, F.lit("source")).alias("source"))


@query("SELECT id, weight FROM (SELECT doc_id AS id, greatest(0.1::DOUBLE, 1 + (1.5::DOUBLE - 1) * 0.5::DOUBLE) * CASE WHEN doc_id % 4 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM documents)")
def epoch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example weights carried from one epoch to the next: all decay towards 1, those mined again are boosted."""
    docs = _docs(spark, sf_dir)
    state = docs.select(F.col("doc_id").alias("id"), F.lit(1.5).alias("weight"))
    mined = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.lit(2.0).alias("boost"))
    decayed = F.greatest(F.lit(0.1), 1 + (F.col("weight") - 1) * 0.5)
    return state.join(mined, "id", "left").select("id", (decayed * F.coalesce("boost", F.lit(1.0))).alias("weight"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, len(embedding) AS size FROM embeddings")
def float_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as little-endian bytes and back, by Arrow batches."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<f4"))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", unpack(pack("embedding")).alias("v"))
    return rows.select("vec_id", F.get("v", F.lit(0)).cast("double").alias("first"), F.size("v").cast("long").alias("size"))


SEARCH = (0.2, 0.4, 0.6, 0.8)
_MACRO = lambda name, truth, guess, where, n: f"""{name} AS (SELECT a, b, c, sum(2.0 * tp / al) / {n or "count(*)"} AS f1 FROM (SELECT a, b, c, label, sum(CASE WHEN own AND hit THEN 1 ELSE 0 END) AS tp, count(*) AS al FROM (SELECT a, b, c, unnest([{truth}, {guess}]) AS label, unnest([true, false]) AS own, coalesce({truth} = {guess}, false) AS hit FROM judged WHERE {where}) WHERE label IS NOT NULL GROUP BY a, b, c, label) GROUP BY a, b, c)"""


@query(
    f"""WITH {ONE}, r AS (SELECT ((tok * 13 + doc_id) % 100) / 100.0::DOUBLE AS p_ent, ((tok * 29 + n * 7 + doc_id) % 100) / 100.0::DOUBLE AS p_none, score AS p_top, CASE WHEN (doc_id + tok) % 3 = 0 THEN 1 ELSE 0 END AS b_true, CASE WHEN (doc_id + tok) % 3 = 0 THEN coarse ELSE 'NONE' END AS c_true, CASE WHEN (tok + n) % 4 = 0 THEN 'PER' ELSE coarse END AS c_top, fine AS f_true, CASE WHEN (tok * 3 + n) % 5 = 0 THEN 'PER_0' ELSE fine END AS f_top FROM ent),
    g AS (SELECT unnest(range(0, 4)) AS i, unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS t), judged AS (SELECT x.i AS a, y.i AS b, z.i AS c, b_true, c_true, f_true, CASE WHEN p_ent >= x.t THEN 1 ELSE 0 END AS b_pred, CASE WHEN p_ent >= x.t AND p_none < y.t AND p_top >= z.t THEN c_top ELSE 'NONE' END AS c_pred, CASE WHEN p_ent >= x.t AND p_none < y.t AND p_top >= z.t THEN f_top END AS f_pred FROM r, g x, g y, g z),
    {_MACRO("mb", "b_true", "b_pred", "true", None)}, {_MACRO("mc", "c_true", "c_pred", "true", 6)}, {_MACRO("mf", "f_true", "f_pred", "b_true = 1", 10)},
    s AS (SELECT a, b, c, mb.f1 AS boundary_f1, mc.f1 AS coarse_f1, coalesce(mf.f1, 0) AS fine_f1, round((mb.f1 + mc.f1 + coalesce(mf.f1, 0)) / 3, 9) AS score FROM mb JOIN mc USING (a, b, c) LEFT JOIN mf USING (a, b, c) ORDER BY score DESC, a, b, c LIMIT 10)
    SELECT x.t AS tau_boundary, y.t AS tau_none, z.t AS tau_coarse, round(boundary_f1, 9) AS boundary_f1, round(coarse_f1, 9) AS coarse_f1, round(fine_f1, 9) AS fine_f1, score FROM s JOIN g x ON x.i = a JOIN g y ON y.i = b JOIN g z ON z.i = c"""
)
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of a grid of three thresholds, by the mean of three macro F1: a report."""
    rows = _ent(spark, sf_dir).select(
        F.expr("((tok * 13 + doc_id) % 100) / 100.0D").alias("p_ent"), F.expr("((tok * 29 + n * 7 + doc_id) % 100) / 100.0D").alias("p_none"), F.col("score").alias("p_top"), F.expr("int((doc_id + tok) % 3 = 0)").alias("b_true"),
        F.expr("CASE WHEN (doc_id + tok) % 3 = 0 THEN coarse ELSE 'NONE' END").alias("c_true"), F.expr("CASE WHEN (tok + n) % 4 = 0 THEN 'PER' ELSE coarse END").alias("c_top"), F.col("fine").alias("f_true"), F.expr("CASE WHEN (tok * 3 + n) % 5 = 0 THEN 'PER_0' ELSE fine END").alias("f_top"),
    )
    return M.threshold_search(rows, SEARCH, 6, 10, 10)
