"""Evaluation queries over labels, embeddings and derived spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derived as D
from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import spans as S
from ..registry import query, table
from ..storage import written

GUESS = "guess AS (SELECT vec_id, label AS truth, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 WHEN vec_id % 11 = 0 THEN (label * 3) % 10 ELSE label END AS guess, ((vec_id * 37) % 100) / 100.0::DOUBLE AS score FROM embeddings)"
CONF = f"{GUESS}, l AS (SELECT DISTINCT truth AS label FROM guess UNION SELECT DISTINCT guess FROM guess), c AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (truth <> label AND guess = label) AS fp, count(*) FILTER (truth = label AND guess <> label) AS fn FROM l, guess GROUP BY label)"


def _guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).when(F.col("vec_id") % 11 == 0, (F.col("label") * 3) % 10).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), g.alias("guess"), (((F.col("vec_id") * 37) % 100) / F.lit(100.0)).alias("score"))


@query(f"WITH {CONF} SELECT label, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2, tp + fn AS support FROM c")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.report(_guess(spark, sf_dir), "truth", "guess")
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f2")], "support")


@query(f"WITH {CONF}, f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c WHERE tp + fn > 0) SELECT round(avg(f), 6) AS macro, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro, round(sum(f * (tp + fn)) / sum(tp + fn), 6) AS weighted FROM f")
def f1_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.averages(_guess(spark, sf_dir), "truth", "guess").select(*[F.round(c, 6).alias(c) for c in ("macro", "micro", "weighted")])


GRID = f"{GUESS}, g AS (SELECT truth, t, count(*) FILTER (hit AND p >= t) AS tp, count(*) FILTER (NOT hit AND p >= t) AS fp, count(*) FILTER (hit AND p < t) AS fn FROM (SELECT truth, truth = guess AS hit, least(floor(round(score * 100, 9)), 99) AS p FROM guess), (SELECT unnest(range(1, 100)) AS t) GROUP BY ALL)"


@query(f"WITH {GRID} SELECT truth, t, tp, fp, fn FROM g")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_counts(_guess(spark, sf_dir), "score", F.col("truth") == F.col("guess"), ["truth"])


@query(f"WITH {GRID}, f AS (SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f FROM g) SELECT truth, arg_max(t, (f, -t)) AS t, round(max(f), 6) AS f1 FROM f GROUP BY truth")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_threshold(_guess(spark, sf_dir), "score", F.col("truth") == F.col("guess"), ["truth"]).withColumn("f1", F.round("f1", 6))


@query("WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT *, least(pow(sum(n) OVER () / (count(*) OVER () * n), 0.5), 10) AS raw FROM n) SELECT lang, n, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weights(table(spark, sf_dir, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query(f"WITH {GUESS} SELECT truth, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, round(median(score), 6) AS middle FROM guess GROUP BY truth")
def batch_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guess(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.percentile("score", 0.5), 6).alias("middle"))


@query(f"WITH {GUESS} SELECT vec_id, score FROM guess ORDER BY score, vec_id LIMIT 10")
def lowest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guess(spark, sf_dir).orderBy("score", "vec_id").limit(10).select("vec_id", "score")


@query("SELECT round(avg(abs(x - y)), 6) AS mae, round(quantile_cont(abs(x - y), 0.99), 6) AS p99, round(max(abs(x - y)), 6) AS worst FROM (SELECT x, round(x * 16) / 16 AS y FROM (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings))")
def quantization_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far coarse values are from the exact ones."""
    values = table(spark, sf_dir, "embeddings").select(F.explode(V.doubles(F.col("embedding"))).alias("x"))
    gap = F.abs(F.col("x") - F.round(F.col("x") * 16) / 16)
    return values.agg(F.round(F.avg(gap), 6).alias("mae"), F.round(F.percentile(gap, 0.99), 6).alias("p99"), F.round(F.max(gap), 6).alias("worst"))


@query("WITH p AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT pos, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END, 6) AS std FROM p GROUP BY pos")
def zscore_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of each dimension; a deviation of 0 becomes 1."""
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    std = F.stddev_pop("x")
    return rows.groupBy("pos").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.when(std == 0, 1.0).otherwise(std), 6).alias("std"))


@query(
    "WITH t AS (SELECT label, vec_id % 3 AS ref, vec_id % 5 <> 0 AS mask, unnest(range(0, len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, ref, pos, sum(x * mask::INT) / sum(mask::INT) AS m FROM t GROUP BY ALL HAVING sum(mask::INT) > 0), n AS (SELECT label, ref, sqrt(sum(m * m)) AS n FROM m GROUP BY ALL) SELECT label, ref, pos, round(m / n, 6) AS pooled FROM m JOIN n USING (label, ref)"
)
def masked_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the token vectors that a mask allows, at length 1."""
    mask = (F.col("vec_id") % 5 != 0).cast("int").alias("mask")
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).alias("ref"), mask, F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    means = rows.groupBy("label", "ref", "pos").agg((F.sum(F.col("x") * F.col("mask")) / F.nullif(F.sum("mask"), F.lit(0))).alias("m")).where("m IS NOT NULL")
    vectors = means.groupBy("label", "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return vectors.select("label", "ref", F.posexplode(V.unit(F.col("v"))).alias("pos", "u")).select("label", "ref", "pos", F.round("u", 6).alias("pooled"))


@query(
    "WITH t AS (SELECT label, vec_id % 4 AS ref, unnest(range(0, len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, ref, pos, avg(x) AS m FROM t GROUP BY ALL) SELECT label, ref, arg_max(pos, (round(m, 9), -pos)) AS best FROM m GROUP BY ALL"
)
def averaged_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits averaged over repeats of a candidate, then the best class."""
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4).alias("ref"), F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    means = rows.groupBy("label", "ref", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("label", "ref").agg(F.max_by("pos", F.struct(F.round("m", 9), -F.col("pos"))).alias("best"))


@query(
    "WITH t AS (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT vec_id, pos % 5 AS family, round(max(x) + ln(sum(exp(x - m))), 6) AS lse FROM (SELECT *, max(x) OVER (PARTITION BY vec_id, pos % 5) AS m FROM t) GROUP BY vec_id, pos % 5"
)
def group_log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role logits summed up to coarse roles."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    grouped = rows.groupBy("vec_id", (F.col("pos") % 5).alias("family")).agg(F.collect_list("x").alias("v"))
    return grouped.select("vec_id", "family", F.round(V.log_sum_exp(F.col("v")), 6).alias("lse"))


GP = D.with_spans(("ent", 1, 10), ("arg", 2, 12))
HOW = f"""m AS (SELECT g.doc_id, g.sent_id, g."start", g."end", g.coarse, coalesce(g.coarse = p.coarse, false) AS typed, CASE WHEN p.doc_id IS NULL THEN 5 WHEN g."start" = p."start" AND g."end" = p."end" THEN 1 WHEN lower(g.text) = lower(p.text) THEN 2
  WHEN greatest(0, least(g."end", p."end") - greatest(g."start", p."start")) / greatest(g."end" - g."start", p."end" - p."start") >= 0.5 THEN 3 ELSE 4 END AS level FROM ent g LEFT JOIN arg p ON g.doc_id = p.doc_id AND g.sent_id = p.sent_id AND g."start" < p."end" AND p."start" < g."end"),
  b AS (SELECT doc_id, sent_id, "start", "end", coarse, arg_min(typed, (NOT typed, level)) AS typed, arg_min(level, (NOT typed, level)) AS level FROM m GROUP BY ALL), ladder AS (SELECT doc_id, sent_id, "start", "end", coarse, (['exact', 'text', 'partial', 'overlap', 'missed'])[level] AS how, typed FROM b)"""


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_ladder(D.spans(spark, sf_dir, 1, 10), D.spans(spark, sf_dir, 2, 12))


@query(f"WITH {GP}, {HOW} SELECT * FROM ladder")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ladder(spark, sf_dir)


@query(f"WITH {GP}, {HOW} SELECT coarse, count(*) FILTER (how = 'exact') AS exact, count(*) FILTER (how = 'text') AS \"text\", count(*) FILTER (how = 'partial') AS partial, count(*) FILTER (how = 'overlap') AS overlap, count(*) FILTER (how = 'missed') AS missed, round(count(*) FILTER (how <> 'missed' AND typed) / count(*), 6) AS recall FROM ladder GROUP BY coarse")
def recall_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("how") == h).alias(h) for h in ("exact", "text", "partial", "overlap", "missed")]
    return _ladder(spark, sf_dir).groupBy("coarse").agg(*counts, F.round(F.count_if((F.col("how") != "missed") & F.col("typed")) / F.count("*"), 6).alias("recall"))


@query(
    f"""WITH {GP}, o AS (SELECT g.doc_id, g.sent_id, g."start" AS gs, g."end" AS ge, p."start" AS ps, p."end" AS pe FROM ent g JOIN arg p ON g.doc_id = p.doc_id AND g.sent_id = p.sent_id AND g."start" < p."end" AND p."start" < g."end"
      WHERE 2 * (least(g."end", p."end") - greatest(g."start", p."start")) >= g."end" - g."start" AND 2 * (least(g."end", p."end") - greatest(g."start", p."start")) >= p."end" - p."start"),
    n AS (SELECT (SELECT count(*) FROM ent) AS gold, (SELECT count(*) FROM arg) AS pred, (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent_id, gs, ge FROM o)) AS found, (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent_id, ps, pe FROM o)) AS right_)
    SELECT round(right_ / pred, 6) AS precision, round(found / gold, 6) AS recall FROM n"""
)
def relaxed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that share at least half of both spans."""
    gold, pred = (written(D.spans(spark, sf_dir, *a).select(*S.KEY, "start", "end")) for a in ((1, 10), (2, 12)))
    shared = S.overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    both = written(S.pairs(gold, pred).where((2 * shared >= F.col("a_end") - F.col("a_start")) & (2 * shared >= F.col("b_end") - F.col("b_start"))))
    counts = [gold.agg(F.count("*").alias("gold")), pred.agg(F.count("*").alias("pred")), both.select(*S.KEY, "a_start", "a_end").distinct().agg(F.count("*").alias("found")), both.select(*S.KEY, "b_start", "b_end").distinct().agg(F.count("*").alias("hit"))]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])  # four single rows
    return one.select(F.round(F.col("hit") / F.col("pred"), 6).alias("precision"), F.round(F.col("found") / F.col("gold"), 6).alias("recall"))


@query("SELECT left(event_type, 1) AS category, count(*) AS n, round(count(*) FILTER (value > 50) / count(*), 6) AS pass_rate FROM events GROUP BY 1")
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of passed cases by category prefix."""
    return table(spark, sf_dir, "events").groupBy(F.substring("event_type", 1, 1).alias("category")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("value") > 50) / F.count("*"), 6).alias("pass_rate"))


@query(f"WITH {GUESS} SELECT vec_id, round(CASE WHEN truth <> guess THEN least(1 + score * 1.5, 2) ELSE greatest(1 + (score - 1) * 0.9, 0.5) END, 6) AS weight FROM guess")
def example_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors gain weight up to a cap, the rest decay to a floor."""
    w = F.when(F.col("truth") != F.col("guess"), F.least(1 + F.col("score") * 1.5, F.lit(2.0))).otherwise(F.greatest(1 + (F.col("score") - 1) * 0.9, F.lit(0.5)))
    return _guess(spark, sf_dir).select("vec_id", F.round(w, 6).alias("weight"))


@query(f"WITH {GUESS} SELECT CASE WHEN guess IS NULL THEN 'FN_BOUNDARY' WHEN truth % 3 <> guess % 3 THEN 'COARSE_ERR' WHEN truth <> guess THEN 'FINE_ERR' ELSE 'OK' END AS kind, count(*) AS n FROM guess GROUP BY 1")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = M.error_kind(F.col("guess").isNotNull(), F.col("truth") % 3 == F.col("guess") % 3, F.col("truth") == F.col("guess"))
    return _guess(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, CASE WHEN before IS NULL THEN 'first' WHEN before = event_type THEN 'same' ELSE 'change' END AS step FROM w")
def sequence_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step against the one before it, as tag sequences are checked."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("before", before)
    return rows.select("event_id", F.when(F.col("before").isNull(), "first").when(F.col("before") == F.col("event_type"), "same").otherwise("change").alias("step"))
