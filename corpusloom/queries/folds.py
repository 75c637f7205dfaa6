"""Ordered folds over a sentence's spans, training rows, and graph features of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derived as D
from ..operators import graph as G
from ..operators import spans as S
from ..registry import query
from .graphs import UD, _ud

K = "doc_id, sent_id"
ONE, BOTH = D.with_spans(("ent", 1, 10)), D.with_spans(("ent", 1, 10), ("arg", 2, 6))
SPAN = 'STRUCT("start" BIGINT, "end" BIGINT, score DOUBLE, coarse VARCHAR)'


def _ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 1, 10)


def replace_fold(spans: DataFrame, delta: float) -> DataFrame:
    """Spans by start; one that overlaps the last kept one of its type takes its place if surer by more than `delta`, or else, unless less sure by as much, if longer."""
    listed = S.islands(spans, [*S.KEY, "coarse"]).groupBy(*S.KEY, "coarse", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("s"))
    none = F.filter("s", lambda x: F.lit(False))

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = (c["end"] - c["start"]) > (last["end"] - last["start"])
        wins = F.when(c["score"] > last["score"] + delta, True).when(last["score"] > c["score"] + delta, False).otherwise(longer)
        swapped = F.when(wins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(c))).otherwise(acc)
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > c["start"]), swapped).otherwise(F.concat(acc, F.array(c)))

    return listed.select(*S.KEY, "coarse", F.explode(F.aggregate("s", none, step)).alias("x")).select(*S.KEY, "coarse", "x.*")


_D = "0.02::DOUBLE"


@query(
    f"""WITH {ONE}, l AS (SELECT {K}, coarse, list({{'start': "start", 'end': "end", 'score': score, 'coarse': coarse}}::{SPAN} ORDER BY "start", "end", score) AS s FROM ent GROUP BY {K}, coarse),
    f AS (SELECT {K}, coarse, list_reduce(s, lambda a, c: CASE WHEN len(a) > 0 AND a[-1]."end" > c."start" THEN CASE WHEN c.score > a[-1].score + {_D} OR (NOT a[-1].score > c.score + {_D} AND c."end" - c."start" > a[-1]."end" - a[-1]."start") THEN list_append(a[1:len(a) - 1], c) ELSE a END ELSE list_append(a, c) END, []::{SPAN}[]) AS kept FROM l)
    SELECT {K}, coarse, x."start", x."end", x.score FROM (SELECT {K}, coarse, unnest(kept) AS x FROM f)"""
)
def overlaps_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans of one type: the surer, and of about equally sure ones the longer."""
    return replace_fold(_ent(spark, sf_dir), 0.02)


@query(
    f"""WITH {ONE}, z AS (SELECT {K}, max("end") AS size FROM toks GROUP BY {K}), e AS (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id, e.sent_id, fine ORDER BY e."end" - e."start" DESC, score DESC, e."start") AS r FROM ent e JOIN z USING ({K}) WHERE e."end" - e."start" <= 0.85 * size) SELECT {K}, fine, "start", "end" FROM e WHERE r = 1"""
)
def longest_of_each_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest span of each label in a sentence, without those that cover more than 85 percent of it."""
    sizes = D.tokens(spark, sf_dir).groupBy(*S.KEY).agg(F.max("end").alias("size"))
    rows = _ent(spark, sf_dir).join(sizes, S.KEY).where(F.col("end") - F.col("start") <= F.expr("0.85BD * size"))
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), "score", -F.col("start")))
    return rows.groupBy(*S.KEY, "fine").agg(best.alias("b")).select(*S.KEY, "fine", "b.*")


@query(
    f"""WITH {ONE}, r AS (SELECT *, max(tok + n) OVER (PARTITION BY {K}, coarse ORDER BY tok, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ent), i AS (SELECT *, sum(CASE WHEN coalesce(tok > reach, true) THEN 1 ELSE 0 END) OVER (PARTITION BY {K}, coarse ORDER BY tok, n ROWS UNBOUNDED PRECEDING) AS island FROM r),
    m AS (SELECT {K}, coarse, min(tok) AS first, max(tok + n) - 1 AS last, max(score) AS best, avg(score) AS mean FROM i GROUP BY {K}, coarse, island) SELECT {K}, coarse, first, last, best, round(mean, 9) AS mean FROM m WHERE last - first < 12"""
)
def contiguous_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching or overlapping spans of one label as one of at most 12 tokens, with the best and the mean score."""
    w = Window.partitionBy(*S.KEY, "coarse").orderBy("tok", "n")
    reach = F.max(F.col("tok") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = _ent(spark, sf_dir).withColumn("new", F.coalesce(F.col("tok") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*S.KEY, "coarse", "island").agg(F.min("tok").alias("first"), (F.max(F.col("tok") + F.col("n")) - 1).alias("last"), F.max("score").alias("best"), F.round(F.avg("score"), 9).alias("mean"))
    return merged.where("last - first < 12").drop("island")


_ARG = f"a AS (SELECT * FROM arg WHERE score >= 0.3), z AS (SELECT {K}, max(tok) + 1 AS size FROM toks GROUP BY {K})"


@query(
    f"""WITH {BOTH}, {_ARG}, g AS (SELECT a.doc_id, a.sent_id, tok, n, tok + df AS first, tok + n - 1 + dl AS last, size FROM a JOIN z USING ({K}), (SELECT unnest(range(-2, 3)) AS df), (SELECT unnest(range(-2, 3)) AS dl) WHERE NOT (df = 0 AND dl = 0)), o AS (SELECT *, greatest(0, least(last + 1, tok + n) - greatest(first, tok)) AS ov FROM g WHERE first >= 0 AND last < size AND last >= first)
    SELECT DISTINCT {K}, first, last FROM o WHERE ov > 0 AND NOT EXISTS (SELECT 1 FROM arg b WHERE b.doc_id = o.doc_id AND b.sent_id = o.sent_id AND b.tok = o.first AND b.tok + b.n - 1 = o.last)"""
)
def argument_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near misses of sure argument spans that are no argument themselves."""
    args = D.spans(spark, sf_dir, 2, 6)
    near = S.boundary_negatives(args.where("score >= 0.3"), D.tokens(spark, sf_dir)).select(*S.KEY, "first", "last").distinct()
    gold = args.select(*S.KEY, F.col("tok").alias("first"), (F.col("tok") + F.col("n") - 1).alias("last"))
    return near.join(gold, [*S.KEY, "first", "last"], "left_anti")


@query(
    f"""WITH {BOTH}, r AS (SELECT {K}, tok, n, 'gold' AS kind, 1.0::DOUBLE AS w FROM ent UNION ALL SELECT {K}, tok, n, 'argument', 0.8::DOUBLE FROM arg UNION ALL SELECT {K}, tok, 1, 'random', 0.5::DOUBLE FROM toks WHERE tok % 10 = 9)
    SELECT {K}, tok, n, kind, w * CASE WHEN doc_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, count(*) OVER (PARTITION BY {K}, kind) AS of_kind FROM r"""
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all kinds with the weight of kind and source, and how many of a kind the sentence has."""
    kind = lambda rows, name, w: rows.select(*S.KEY, "tok", F.col("n").cast("long").alias("n"), F.lit(name).alias("kind"), F.lit(w).alias("w"))
    rows = kind(_ent(spark, sf_dir), "gold", 1.0).union(kind(D.spans(spark, sf_dir, 2, 6), "argument", 0.8)).union(kind(D.tokens(spark, sf_dir).where("tok % 10 = 9").withColumn("n", F.lit(1)), "random", 0.5))
    source = F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(1.0)
    return rows.select(*S.KEY, "tok", "n", "kind", (F.col("w") * source).alias("weight"), F.count("*").over(Window.partitionBy(*S.KEY, "kind")).alias("of_kind"))


@query(f"WITH {UD} SELECT {K}, tok_id, upos IN ('NOUN', 'PROPN', 'ADJ') AND NOT deprel IN ('flat:name', 'amod') AS eligible FROM ud")
def heads_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens may head an entity: no function words or verbs, no parts of names and no attributes."""
    ok = F.col("upos").isin("NOUN", "PROPN", "ADJ") & ~F.col("deprel").isin("flat:name", "amod")
    return _ud(spark, sf_dir).select(*G.KEY, "tok_id", ok.alias("eligible"))


@query(
    f"""WITH {UD}, v AS (SELECT {K}, tok_id AS verb, tok_id + tok_id % 3 AS last FROM ud WHERE upos = 'VERB'), p AS (SELECT u.doc_id, u.sent_id, u.tok_id, greatest(1, u.tok_id - u.tok_id % 4) AS gov FROM ud u WHERE deprel IN ('nsubj', 'obj', 'obl')),
    m AS (SELECT p.*, v.verb, row_number() OVER (PARTITION BY p.doc_id, p.sent_id, p.tok_id ORDER BY v.verb) AS r FROM p LEFT JOIN v ON v.doc_id = p.doc_id AND v.sent_id = p.sent_id AND p.gov BETWEEN v.verb AND v.last) SELECT {K}, tok_id, verb, CASE WHEN verb IS NULL THEN 'dropped' WHEN verb = gov THEN 'exact' ELSE 'snapped' END AS how FROM m WHERE r = 1"""
)
def governors_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers to governing verbs: those inside a verb's range are moved to its start, dangling ones dropped."""
    ud = _ud(spark, sf_dir)
    verbs = ud.where("upos = 'VERB'").groupBy(*G.KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("tok_id").alias("verb"), F.expr("tok_id + tok_id % 3").alias("last")))).alias("v"))
    rows = ud.where(F.col("deprel").isin("nsubj", "obj", "obl")).select(*G.KEY, "tok_id", F.greatest(F.lit(1), F.expr("tok_id - tok_id % 4")).alias("gov")).join(verbs, G.KEY, "left")
    found = F.get(F.filter("v", lambda x: (x["verb"] <= F.col("gov")) & (F.col("gov") <= x["last"])), F.lit(0))["verb"]
    rows = rows.withColumn("verb", found)
    return rows.select(*G.KEY, "tok_id", "verb", F.when(F.col("verb").isNull(), "dropped").when(F.col("verb") == F.col("gov"), "exact").otherwise("snapped").alias("how"))


@query(f"WITH {UD}, f AS (SELECT *, CASE WHEN tok_id % 3 = 0 THEN 'Gender=' || upos || '|Number=' || tok_id % 2 END AS feats FROM ud), g AS MATERIALIZED (SELECT {K}, tok_id, feats, unnest(range(greatest(1, tok_id - 3), tok_id + 1)) AS first FROM f WHERE upos IN ('NOUN', 'PROPN') AND feats IS NOT NULL), m AS (SELECT {K}, first, arg_min(feats, tok_id) AS feats FROM g GROUP BY ALL) SELECT {K}, first, regexp_extract(feats, 'Gender=([^|]*)', 1) AS gender, regexp_extract(feats, 'Number=([^|]*)', 1) AS number FROM m")
def morphology_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of four tokens with the features of their first noun that has some."""
    ud = _ud(spark, sf_dir)
    feats = F.when(F.col("tok_id") % 3 == 0, F.create_map(F.lit("Gender"), F.col("upos"), F.lit("Number"), (F.col("tok_id") % 2).cast("string")))
    nouns = ud.withColumn("feats", feats).where(F.col("upos").isin("NOUN", "PROPN") & F.col("feats").isNotNull())
    # a noun belongs to the four spans that start at it or up to three tokens before it
    reach = nouns.withColumn("first", F.explode(F.sequence(F.col("tok_id") - 3, F.col("tok_id")))).where("first >= 1")
    best = reach.groupBy(*G.KEY, "first").agg(F.min_by(F.struct(F.col("feats")["Gender"].alias("gender"), F.col("feats")["Number"].alias("number")), "tok_id").alias("f"))
    return best.select(*G.KEY, "first", "f.*")


@query(
    f"""WITH {UD}, c AS (SELECT {K}, tok_id AS first, tok_id + 2 AS last, deprel, head FROM ud WHERE upos IN ('NOUN', 'PROPN')) SELECT a.doc_id, a.sent_id, a.first, min(b.first) AS parent FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.sent_id = a.sent_id AND a.head BETWEEN b.first AND b.last AND b.first <> a.first GROUP BY ALL"""
)
def sibling_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span that holds the governor of a span's head token, the first of several."""
    spans = _ud(spark, sf_dir).where("upos in ('NOUN', 'PROPN')").select(*G.KEY, F.col("tok_id").alias("first"), "head")
    # a span of three tokens holds a governor at its start or one or two tokens further
    by_place = spans.select(*G.KEY, F.col("first").alias("parent"), F.explode(F.sequence(F.col("first"), F.col("first") + 2)).alias("head"))
    return spans.join(by_place, [*G.KEY, "head"]).where("parent <> first").groupBy(*G.KEY, "first").agg(F.min("parent").alias("parent"))
