"""Span queries: joins, suppression, islands and negatives over spans derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import derived as D
from ..operators import spans as S
from ..registry import query

ENT, ARG = ("ent", 1, 10), ("arg", 2, 6)
BOTH = D.with_spans(ENT, ARG)
ONE = D.with_spans(ENT)
OVER = 'greatest(0, least(a."end", b."end") - greatest(a."start", b."start"))'
SAME = 'a.doc_id = b.doc_id AND a.sent_id = b.sent_id'
TOUCH = f'{SAME} AND a."start" < b."end" AND b."start" < a."end"'
SPAN = 'STRUCT("start" BIGINT, "end" BIGINT, score DOUBLE, coarse VARCHAR, fine VARCHAR)'


def _ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 1, 10)


def _arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 2, 6)


def _fold_sql(order: str, clash: str, group: str = "doc_id, sent_id") -> str:
    """Greedy suppression in SQL. clash compares a kept span k with a candidate c."""
    return f"""WITH {ONE}, l AS (SELECT {group}, list({{'start': "start", 'end': "end", 'score': score, 'coarse': coarse, 'fine': fine}}::{SPAN} ORDER BY {order}) AS s FROM ent GROUP BY {group}),
    f AS (SELECT {group}, list_reduce(s, lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_append(acc, c) END, []::{SPAN}[]) AS kept FROM (SELECT {group}, list_transform(s, lambda x: x) AS s FROM l))
    SELECT doc_id, sent_id, x."start", x."end", x.fine FROM (SELECT doc_id, sent_id, unnest(kept) AS x FROM f)"""


IOU_KC = 'greatest(0, least(k."end", c."end") - greatest(k."start", c."start")) / ((k."end" - k."start") + (c."end" - c."start") - greatest(0, least(k."end", c."end") - greatest(k."start", c."start")))'
OVER_KC = 'greatest(0, least(k."end", c."end") - greatest(k."start", c."start"))'


def _slim(df: DataFrame) -> DataFrame:
    return df.select(*S.KEY, "start", "end", "score", "coarse", "fine")


@query(f'WITH {D.SENTENCES_SQL}, {D.TOKENS_SQL} SELECT doc_id, sent_id, tok, word, "start", "end" FROM toks')
def tokens_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tokens(spark, sf_dir)


@query(f'WITH {ONE} SELECT doc_id, sent_id, tok, n, "start", "end", text, round(score, 6) AS score, coarse, fine FROM ent')
def ngram_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ent(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f'WITH {ONE} SELECT doc_id, sent_id, "start", "end", row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY "start", "start" - "end") AS place FROM ent')
def span_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by start, then longest first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*S.KEY).orderBy("start", F.col("start") - F.col("end"))
    return _ent(spark, sf_dir).select(*S.KEY, "start", "end", F.row_number().over(w).alias("place"))


@query(f'WITH {BOTH} SELECT a.doc_id, a.sent_id, a."start" AS a_start, a."end" AS a_end, b."start" AS b_start, b."end" AS b_end, round({OVER} / ((a."end" - a."start") + (b."end" - b."start") - {OVER}), 6) AS iou FROM ent a JOIN arg b ON {TOUCH}')
def span_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = S.pairs(_ent(spark, sf_dir).select(*S.KEY, "start", "end"), _arg(spark, sf_dir).select(*S.KEY, "start", "end"))
    return both.withColumn("iou", F.round(S.iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")), 6))


@query(
    f"""WITH {BOTH}, m AS (SELECT a.doc_id, a.sent_id, a."start" AS a_start, a."end" AS a_end, b.fine AS b_fine, b."start" AS bs, b."end" AS be, b.score * {OVER} / (a."end" - a."start") AS w FROM ent a LEFT JOIN arg b ON {TOUCH}),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, a_start, a_end ORDER BY w DESC NULLS LAST, bs, be) AS r FROM m) SELECT doc_id, sent_id, a_start, a_end, b_fine FROM r WHERE r = 1"""
)
def role_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity with the argument of the greatest role probability times covered share; lone entities stay."""
    shared = S.overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    weight = F.col("b_score") * shared / (F.col("a_end") - F.col("a_start"))
    return S.best_match(_ent(spark, sf_dir).select(*S.KEY, "start", "end"), _arg(spark, sf_dir), weight, ["b_fine"]).drop("w")


@query(
    f"""WITH {BOTH}, m AS (SELECT a.doc_id, a.sent_id, a."start" AS a_start, a."end" AS a_end, b."start" AS b_start, b."end" AS b_end, b.score FROM arg a JOIN ent b ON {TOUCH}),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, a_start, a_end ORDER BY b_end - b_start DESC, score DESC, b_start) AS r FROM m) SELECT doc_id, sent_id, a_start, a_end, b_start, b_end FROM r WHERE r = 1"""
)
def slot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each argument with the longest overlapping entity, then the best scored."""
    both = S.pairs(_arg(spark, sf_dir).select(*S.KEY, "start", "end"), _ent(spark, sf_dir).select(*S.KEY, "start", "end", "score"))
    best = F.max_by(F.struct("b_start", "b_end"), F.struct(F.col("b_end") - F.col("b_start"), "b_score", -F.col("b_start"))).alias("m")
    return both.groupBy(*S.KEY, "a_start", "a_end").agg(best).select(*S.KEY, "a_start", "a_end", "m.*")


@query(
    f"""WITH {BOTH}, m AS (SELECT a.doc_id, a.sent_id, a."start" AS a_start, a."end" AS a_end, b."start" AS b_start, b."end" AS b_end, b.score FROM arg a JOIN ent b ON {TOUCH} AND {OVER} / least(a."end" - a."start", b."end" - b."start") >= 0.6 AND b.coarse IN ('PER', 'ORG', 'LOC') AND b.score >= 0.3),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, a_start, a_end ORDER BY score DESC, b_start, b_end) AS r FROM m) SELECT doc_id, sent_id, a_start, a_end, b_start, b_end, round(score, 6) AS w FROM r WHERE r = 1"""
)
def snap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw argument snapped to the best entity that shares 60 percent of the shorter one and is of an allowed type."""
    shared = S.overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    near = shared / F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")) >= 0.6
    ents = _ent(spark, sf_dir).where(F.col("coarse").isin("PER", "ORG", "LOC") & (F.col("score") >= 0.3))
    on = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & near
    found = S.best_match(_arg(spark, sf_dir).select(*S.KEY, "start", "end"), ents, F.col("b_score"), ["b_start", "b_end"], on)
    return found.where("w is not null").withColumn("w", F.round("w", 6))


@query(f'WITH {BOTH} SELECT a.doc_id, a.sent_id, a."start", a."end" FROM arg a WHERE NOT EXISTS (SELECT 1 FROM ent b WHERE {TOUCH})')
def uncovered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments that no entity overlaps."""
    return S.not_overlapping(_arg(spark, sf_dir), _ent(spark, sf_dir)).select(*S.KEY, "start", "end")


@query(f'WITH {BOTH} SELECT a.doc_id, a.sent_id, a."start", a."end" FROM arg a WHERE EXISTS (SELECT 1 FROM ent b WHERE {TOUCH} AND b.coarse = a.coarse)')
def confirmed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments that an entity of the same type confirms."""
    on = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("a_coarse") == F.col("b_coarse"))
    return S.pairs(_arg(spark, sf_dir).select(*S.KEY, "start", "end", "coarse"), _ent(spark, sf_dir).select(*S.KEY, "start", "end", "coarse"), "left_semi", on).select(*S.KEY, F.col("a_start").alias("start"), F.col("a_end").alias("end"))


@query(
    f"""WITH {BOTH}, m AS (SELECT a.doc_id, a.sent_id, a."start", a."end", max(CASE WHEN b.doc_id IS NULL THEN 0 WHEN b."start" = a."start" AND b."end" = a."end" THEN 2 ELSE 1 END) AS k FROM ent a LEFT JOIN arg b ON {TOUCH} GROUP BY ALL)
    SELECT doc_id, sent_id, "start", "end", CASE k WHEN 2 THEN 'exact' WHEN 1 THEN 'overlap' ELSE 'none' END AS how FROM m"""
)
def exact_or_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match by equal bounds, else by the greatest overlap."""
    shared = S.overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    same = (F.col("a_start") == F.col("b_start")) & (F.col("a_end") == F.col("b_end"))
    found = S.best_match(_ent(spark, sf_dir).select(*S.KEY, "start", "end"), _arg(spark, sf_dir), F.when(same, 1e9).otherwise(shared), ["b_start"])
    how = F.when(F.col("b_start").isNull(), "none").when(F.col("w") >= 1e9, "exact").otherwise("overlap")
    return found.select(*S.KEY, F.col("a_start").alias("start"), F.col("a_end").alias("end"), how.alias("how"))


@query(
    f"""WITH {ONE}, m AS (SELECT a.doc_id, a.sent_id, a."start", a."end", b."start" AS ps, b."end" AS pe FROM ent a LEFT JOIN ent b ON {SAME} AND b."start" <= a."start" AND b."end" >= a."end" AND b."end" - b."start" > a."end" - a."start"),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, "start", "end" ORDER BY pe - ps NULLS LAST, ps) AS r FROM m) SELECT doc_id, sent_id, "start", "end", ps AS parent_start, pe AS parent_end FROM r WHERE r = 1"""
)
def smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.smallest_container(_ent(spark, sf_dir).select(*S.KEY, "start", "end"))


@query(f'WITH {ONE} SELECT a.doc_id, a.sent_id, a."start", a."end", min(b.tok) AS first_tok, max(b.tok) AS last_tok FROM ent a LEFT JOIN toks b ON {TOUCH} GROUP BY ALL')
def char_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cover_tokens(_ent(spark, sf_dir), D.tokens(spark, sf_dir))


@query(f'WITH {ONE}, a AS MATERIALIZED (SELECT doc_id, sent_id, "start" AS s, "end" AS e, unnest(range(tok, tok + n)) AS tok FROM ent) SELECT doc_id, sent_id, s AS "start", e AS "end", tok, word FROM a JOIN (SELECT doc_id, sent_id, tok, word FROM toks) USING (doc_id, sent_id, tok)')
def words_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = S.pairs(_ent(spark, sf_dir).select(*S.KEY, "start", "end"), D.tokens(spark, sf_dir))
    return both.select(*S.KEY, F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_tok").alias("tok"), F.col("b_word").alias("word"))


ORDER_LONG = '"start" - "end", -score, "start", fine'


@query(_fold_sql(ORDER_LONG, OVER_KC + " > 0"))
def longest_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _slim(_ent(spark, sf_dir)).withColumn("len", F.col("end") - F.col("start"))
    kept = S.greedy(s, [("len", True), ("score", True), ("start", False), ("end", False)], lambda k, c: S.struct_overlap(k, c) > 0)
    return kept.select(*S.KEY, "start", "end", "fine")


@query(_fold_sql('-score, "start", "end"', OVER_KC + " > 0"))
def slot_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any overlap suppresses, best score first."""
    kept = S.greedy(_slim(_ent(spark, sf_dir)), [("score", True), ("start", False), ("end", False)], lambda k, c: S.struct_overlap(k, c) > 0)
    return kept.select(*S.KEY, "start", "end", "fine")


@query(_fold_sql('-score, "start", "end"', f"k.coarse = c.coarse AND {IOU_KC} >= 0.5"))
def same_type_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.greedy(_slim(_ent(spark, sf_dir)), [("score", True), ("start", False), ("end", False)], lambda k, c: (k["coarse"] == c["coarse"]) & (S.struct_iou(k, c) >= 0.5))
    return kept.select(*S.KEY, "start", "end", "fine")


@query(_fold_sql('-score, "start", "end"', f'k.fine = c.fine AND {OVER_KC} / least(k."end" - k."start", c."end" - c."start") > 0.5'))
def role_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same role and more than half of the shorter span shared."""
    kept = S.greedy(
        _slim(_ent(spark, sf_dir)), [("score", True), ("start", False), ("end", False)], lambda k, c: (k["fine"] == c["fine"]) & (S.struct_overlap(k, c) / F.least(k["end"] - k["start"], c["end"] - c["start"]) > 0.5)
    )
    return kept.select(*S.KEY, "start", "end", "fine")


@query(_fold_sql(ORDER_LONG, f"k.coarse = c.coarse AND CASE WHEN c.coarse IN ('ORG', 'LOC') THEN {OVER_KC} > 0 ELSE k.\"start\" <= c.\"start\" AND k.\"end\" >= c.\"end\" END"))
def type_aware_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that keep their longest span lose all overlaps; the others only what a kept one contains."""
    s = _slim(_ent(spark, sf_dir)).withColumn("len", F.col("end") - F.col("start"))
    kept = S.greedy(s, [("len", True), ("score", True), ("start", False), ("end", False)], lambda k, c: (k["coarse"] == c["coarse"]) & F.when(c["coarse"].isin("ORG", "LOC"), S.struct_overlap(k, c) > 0).otherwise(S.contains(k, c)))
    return kept.select(*S.KEY, "start", "end", "fine")


@query(
    f"""WITH {ONE}, adj AS (SELECT doc_id, sent_id, "start", "end", score + CASE WHEN coarse IN ('ORG', 'LOC') THEN 0.05 * ln(1 + n) ELSE 0 END - 0.02 * pow(greatest(n - 2, 0), 2) AS score, coarse, fine FROM ent),
    l AS (SELECT doc_id, sent_id, list({{'start': "start", 'end': "end", 'score': score, 'coarse': coarse, 'fine': fine}}::{SPAN} ORDER BY -round(score, 9), "start", "end") AS s FROM adj GROUP BY ALL),
    f AS (SELECT doc_id, sent_id, list_reduce(s, lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: {IOU_KC} >= 0.4)) > 0 THEN acc ELSE list_append(acc, c) END, []::{SPAN}[]) AS kept FROM l)
    SELECT doc_id, sent_id, x."start", x."end", x.fine FROM (SELECT doc_id, sent_id, unnest(kept) AS x FROM f)"""
)
def adjusted_score_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a bonus for length by type and a penalty for excess, then suppression by shared area."""
    bonus = F.when(F.col("coarse").isin("ORG", "LOC"), 0.05 * F.log1p("n")).otherwise(0.0)
    adjusted = F.col("score") + bonus - 0.02 * F.pow(F.greatest(F.col("n") - 2, F.lit(0)), 2)
    s = _ent(spark, sf_dir).withColumn("score", F.round(adjusted, 9)).select(*S.KEY, "start", "end", "score", "coarse", "fine")
    return S.greedy(s, [("score", True), ("start", False), ("end", False)], lambda k, c: S.struct_iou(k, c) >= 0.4).select(*S.KEY, "start", "end", "fine")


KIDS = 'STRUCT("start" BIGINT, "end" BIGINT, score DOUBLE, fine VARCHAR, parent BIGINT)'


@query(
    f"""WITH {ONE}, l AS (SELECT doc_id, sent_id, list({{'start': "start", 'end': "end", 'score': score, 'fine': fine, 'parent': NULL}}::{KIDS} ORDER BY "start" - "end", -score, "start") AS s FROM ent GROUP BY ALL),
    f AS (SELECT doc_id, sent_id, list_reduce(s, lambda acc, c: CASE
      WHEN len(list_filter(acc, lambda k: k.parent IS NULL AND k."start" <= c."start" AND k."end" >= c."end")) > 0 THEN CASE WHEN list_filter(acc, lambda k: k.parent IS NULL AND k."start" <= c."start" AND k."end" >= c."end")[1].fine <> c.fine
        THEN list_append(acc, {{'start': c."start", 'end': c."end", 'score': c.score, 'fine': c.fine, 'parent': list_filter(acc, lambda k: k.parent IS NULL AND k."start" <= c."start" AND k."end" >= c."end")[1]."start"}}::{KIDS}) ELSE acc END
      WHEN len(list_filter(acc, lambda k: k.parent IS NULL AND {IOU_KC} >= 0.5)) > 0 THEN acc ELSE list_append(acc, c) END, []::{KIDS}[]) AS kept FROM l)
    SELECT doc_id, sent_id, x."start", x."end", x.fine, x.parent FROM (SELECT doc_id, sent_id, unnest(kept) AS x FROM f)"""
)
def compound_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compound_children(_ent(spark, sf_dir).select(*S.KEY, "start", "end", "score", "fine")).select(*S.KEY, "start", "end", "fine", "parent")


@query(
    f"""WITH {ONE}, d AS (SELECT DISTINCT doc_id, sent_id, "start", "end" FROM ent UNION ALL SELECT DISTINCT doc_id, sent_id, "start", "end" FROM ent) SELECT doc_id, sent_id, "start", "end" FROM d GROUP BY ALL"""
)
def exact_duplicates_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ent(spark, sf_dir).select(*S.KEY, "start", "end")
    return e.unionAll(e).dropDuplicates()


@query(
    f"""WITH {ONE}, r AS (SELECT *, max("end") OVER (PARTITION BY doc_id, sent_id, coarse ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ent),
    i AS (SELECT *, sum(CASE WHEN coalesce("start" - reach > 1 OR coarse = 'PER', true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_id, coarse ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT doc_id, sent_id, coarse, min("start") AS "start", max("end") AS "end", round(min(score), 6) AS score, count(*) AS parts FROM i GROUP BY doc_id, sent_id, coarse, island"""
)
def consecutive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: neighbouring spans of one type become one; persons never do."""
    return S.merge_adjacent(_ent(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {ONE}, z AS (SELECT doc_id, sent_id, max(tok) + 1 AS size FROM toks GROUP BY ALL), g AS (SELECT e.doc_id, e.sent_id, tok, n, df AS d_first, dl AS d_last, tok + df AS first, tok + n - 1 + dl AS last FROM ent e JOIN z USING (doc_id, sent_id), (SELECT unnest(range(-2, 3)) AS df), (SELECT unnest(range(-2, 3)) AS dl)
      WHERE tok + df >= 0 AND tok + n - 1 + dl < size AND tok + n - 1 + dl >= tok + df AND NOT (df = 0 AND dl = 0)), o AS (SELECT *, greatest(0, least(last + 1, tok + n) - greatest(first, tok)) AS ov FROM g)
    SELECT doc_id, sent_id, tok, n, first, last, round(ov / (last + 1 - first + n - ov), 6) AS iou FROM o WHERE ov > 0"""
)
def boundary_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.boundary_negatives(_ent(spark, sf_dir), D.tokens(spark, sf_dir))
    return found.select(*S.KEY, "tok", "n", "first", "last", F.round("iou", 6).alias("iou"))


@query(
    f"""WITH {ONE}, z AS (SELECT doc_id, sent_id, max(tok) + 1 AS size FROM toks GROUP BY ALL) SELECT e.doc_id, e.sent_id, tok, n, tok - l AS first, tok + n - 1 + r AS last, 1.5::DOUBLE AS weight FROM ent e JOIN z USING (doc_id, sent_id), (SELECT unnest(range(0, 5)) AS l), (SELECT unnest(range(0, 5)) AS r)
    WHERE l + r BETWEEN 2 AND 8 AND tok - l >= 0 AND tok + n - 1 + r < size AND n + l + r <= 10"""
)
def enclosing_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.enclosing_negatives(_ent(spark, sf_dir), D.tokens(spark, sf_dir))


@query(
    f"""WITH {ONE}, g AS (SELECT *, lead("start") OVER w AS ns, lead("end") OVER w AS ne FROM ent WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY "start", "end")) SELECT doc_id, sent_id, "start", ne AS "end", 2.0::DOUBLE AS weight FROM g WHERE ns - "end" BETWEEN 0 AND 5"""
)
def multi_entity_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_pairs(_ent(spark, sf_dir))


TAU = "CAST(CASE coarse WHEN 'PER' THEN 0.4 WHEN 'ORG' THEN 0.5 WHEN 'LOC' THEN 0.45 WHEN 'TIME' THEN 0.3 ELSE 0.6 END AS DOUBLE)"


@query(f"WITH {ONE} SELECT doc_id, sent_id, \"start\", \"end\" FROM ent WHERE score >= 0.2 AND n <= CASE coarse WHEN 'PER' THEN 2 ELSE 3 END AND score >= {TAU}")
def gate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates by score, by a threshold of the type, and by the type's longest span."""
    cap = F.when(F.col("coarse") == "PER", 2).otherwise(3)
    return _ent(spark, sf_dir).where((F.col("score") >= 0.2) & (F.col("n") <= cap) & (F.col("score") >= F.expr(TAU))).select(*S.KEY, "start", "end")


@query(f"WITH {ONE} SELECT doc_id, sent_id, \"start\", \"end\", round(({TAU}) + CAST(CASE WHEN n >= 3 THEN 0.1 WHEN n = 1 THEN -0.05 ELSE 0 END AS DOUBLE), 6) AS tau FROM ent WHERE score >= ({TAU}) + CAST(CASE WHEN n >= 3 THEN 0.1 WHEN n = 1 THEN -0.05 ELSE 0 END AS DOUBLE)")
def dynamic_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tau = F.expr(TAU).cast("double") + F.when(F.col("n") >= 3, 0.1).when(F.col("n") == 1, -0.05).otherwise(0.0)
    return _ent(spark, sf_dir).where(F.col("score") >= tau).select(*S.KEY, "start", "end", F.round(tau, 6).alias("tau"))


@query(f"WITH {ONE} SELECT coarse, t / 100.0::DOUBLE AS threshold, count(*) FILTER (score >= t / 100.0::DOUBLE) AS n FROM ent, (SELECT unnest(range(0, 101, 5)) AS t) GROUP BY ALL")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each type pass each threshold of a grid. Scores are counted once, the small counts meet the grid."""
    by_score = _ent(spark, sf_dir).groupBy("coarse", "score").agg(F.count("*").alias("c"))  # at most a thousand scores a type
    grid = by_score.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(5))))
    threshold = F.col("t") / F.lit(100.0)
    return grid.groupBy("coarse", threshold.alias("threshold")).agg(F.sum(F.when(F.col("score") >= threshold, F.col("c")).otherwise(0)).alias("n"))
