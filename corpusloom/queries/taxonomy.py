"""Queries of labels: what they stand for, their export; words' labels as spans; predictions put to annotated sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derived as D
from ..functions import taxonomy as X
from ..operators import sequences as Q
from ..operators import spans as S
from ..registry import query
from ..storage import scratch

K = "doc_id, sent_id"
ONE, BOTH = D.with_spans(("ent", 1, 10)), D.with_spans(("ent", 1, 10), ("arg", 2, 6))
LABELS = [*(x for values in X.COARSE.values() for x in values), "hint_state", "hint_rate", "verb_trigger"]
_list = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_case = lambda table: "CASE " + " ".join(f"WHEN label IN ({', '.join(repr(x) for x in values)}) THEN '{key}'" for key, values in table.items())
_LABELLED = f"{ONE}, lb AS (SELECT {K}, tok, n, ({_list})[(tok * 7 + n + doc_id) % {len(LABELS)} + 1] AS label FROM ent), ds AS (SELECT *, {_case(X.KINDS)} END AS kind, {_case(X.COARSE)} ELSE 'NONE' END AS coarse FROM lb), gs AS (SELECT *, CASE WHEN label IN ({', '.join(repr(x) for x in X.CONCRETE)}) THEN 'concrete' WHEN coarse <> 'NONE' THEN 'abstract' END AS grp FROM ds)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.expr(f"int((tok * 7 + n + doc_id) % {len(LABELS)}) + 1"))
    return D.spans(spark, sf_dir, 1, 10).select(*S.KEY, "tok", "n", label.alias("label"))


@query(f"WITH {_LABELLED} SELECT {K}, tok, n, label, kind, coarse, grp FROM gs")
def labels_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with the kind, coarse type and group of their label."""
    label = F.col("label")
    return _labelled(spark, sf_dir).withColumns({"kind": X.kind_of(label), "coarse": X.coarse_of(label), "grp": X.group_of(label)})


@query(f"WITH {_LABELLED}, fine AS (SELECT unnest(range(0, {len(LABELS) - 3})) AS id, unnest({_list}[1:{len(LABELS) - 3}]) AS label), u AS (SELECT label, count(*) AS used FROM lb GROUP BY label) SELECT id, label AS name, {_case(X.COARSE)} END AS coarse, {_case(X.KINDS)} END AS kind, CASE WHEN label IN ({', '.join(repr(x) for x in X.CONCRETE)}) THEN 'concrete' ELSE 'abstract' END AS grp, coalesce(used, 0) AS used FROM fine LEFT JOIN u USING (label)")
def taxonomy_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels with how often each is used, exported as JSON, checked and read again."""
    used = {r.label: r["count"] for r in _labelled(spark, sf_dir).where(X.kind_of(F.col("label")).isNotNull() | (X.coarse_of(F.col("label")) != X.NONE)).groupBy("label").count().collect()}  # a row a label
    place = scratch(spark, "taxonomy")
    X.export(spark, used, place)
    return X.load(spark, place)


BIO = ("O", "B-PER", "I-PER", "I-PER", "B-ORG", "I-ORG")
_PIECE = "(doc_id * 3 + sent_id * 5 + tok * 11 + piece * 7 + (tok // 3) * 5) % 6"


@query(
    f"""WITH {D.SENTENCES_SQL}, {D.TOKENS_SQL}, l AS (SELECT {K}, tok, word, "start", "end", (['O', 'B-PER', 'I-PER', 'I-PER', 'B-ORG', 'I-ORG'])[(doc_id * 3 + sent_id * 5 + tok * 11 + (tok // 3) * 5) % 6 + 1] AS label FROM toks), b AS (SELECT *, left(label, 1) AS sign, nullif(substr(label, 3), '') AS type, sum(CASE WHEN label LIKE 'B%' THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY tok) AS run FROM l),
    o AS (SELECT *, first(type) OVER (PARTITION BY {K}, run ORDER BY tok) AS own FROM b WHERE run > 0), c AS (SELECT *, max(CASE WHEN sign = 'B' OR (sign = 'I' AND type = own) THEN 0 ELSE 1 END) OVER (PARTITION BY {K}, run ORDER BY tok) AS broken FROM o)
    SELECT {K}, own AS label, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY tok) AS text FROM c WHERE broken = 0 GROUP BY {K}, run, own"""
)
def word_labels_to_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of words' pieces as spans of the words joined by spaces: a word has its first piece's label, and a stray inside label ends a span."""
    label = F.element_at(F.array(*[F.lit(x) for x in BIO]), F.expr(f"int({_PIECE.replace('//', 'div')}) + 1"))
    pieces = D.tokens(spark, sf_dir).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("int(tok % 3)")))).withColumn("label", label)
    return Q.laid_piece_spans(pieces)


@query(
    f"""WITH {BOTH}, ex AS (SELECT {K}, tok, n, "start", "end", (['svo_verb', 'svo_iobj', 'svo_subject', 'svo_object', 'svo_subject', 'svo_verb', 'svo_object'])[(tok + n) % 7 + 1] AS label FROM arg), has AS (SELECT DISTINCT {K} FROM ex WHERE label = 'svo_iobj'), l AS (SELECT {K}, list({{'start': "start", 'end': "end", 'score': score, 'coarse': coarse}}::STRUCT("start" BIGINT, "end" BIGINT, score DOUBLE, coarse VARCHAR) ORDER BY -score, "start", "end") AS s FROM ent GROUP BY {K}),
    k AS (SELECT {K}, unnest(list_reduce(s, lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: k.coarse = c.coarse AND greatest(0, least(k."end", c."end") - greatest(k."start", c."start")) / (greatest(k."end", c."end") - least(k."start", c."start")) >= 0.5)) > 0 THEN acc ELSE list_append(acc, c) END, []::STRUCT("start" BIGINT, "end" BIGINT, score DOUBLE, coarse VARCHAR)[])) AS x FROM l),
    b AS (SELECT {K}, 0 AS side, "start", "end", label FROM ex UNION ALL SELECT {K}, 1, x."start", x."end", x.coarse FROM k) SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY side, "start", "end", label) - 1 AS pos, "start", "end", label FROM b SEMI JOIN has USING ({K})"""
)
def predictions_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that have an oblique, with their spans and the predictions that are left when like ones overlap."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("svo_verb", "svo_iobj", "svo_subject", "svo_object", "svo_subject", "svo_verb", "svo_object")]), F.expr("int((tok + n) % 7) + 1"))
    existing = D.spans(spark, sf_dir, 2, 6).select(*S.KEY, "start", "end", label.alias("label"))
    predicted = D.spans(spark, sf_dir, 1, 10).select(*S.KEY, "start", "end", "score", "coarse")
    left = S.greedy(predicted, [("score", True), ("start", False), ("end", False)], lambda k, c: (k["coarse"] == c["coarse"]) & (S.struct_iou(k, c) >= 0.5))
    both = existing.withColumn("side", F.lit(0)).unionByName(left.select(*S.KEY, "start", "end", F.col("coarse").alias("label"), F.lit(1).alias("side")))
    some = existing.where("label = 'svo_iobj'").select(*S.KEY).distinct()
    order = Window.partitionBy(*S.KEY).orderBy("side", "start", "end", "label")
    return both.join(some, S.KEY, "left_semi").select(*S.KEY, (F.row_number().over(order) - 1).cast("long").alias("pos"), "start", "end", "label")
