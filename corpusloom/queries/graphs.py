"""Dependency-graph queries over trees made from tokens: token i hangs below i div 2, so every sentence is one tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import derived as D
from ..operators import graph as G
from ..registry import query

POS = ("NOUN", "PROPN", "VERB", "ADJ", "DET", "ADP", "PUNCT")
REL = ("nsubj", "obj", "iobj", "obl", "amod", "flat:name", "conj", "det", "aux", "aux:pass", "advmod", "case")
_P, _R = (", ".join(f"'{x}'" for x in xs) for xs in (POS, REL))
UD = f"""{D.SENTENCES_SQL}, {D.TOKENS_SQL}, ud AS MATERIALIZED (SELECT doc_id, sent_id, tok + 1 AS tok_id, (tok + 1) // 2 AS head, word, ([{_P}])[(doc_id + sent_id * 3 + tok * 5) % 7 + 1] AS upos, CASE WHEN tok = 0 THEN 'root' ELSE ([{_R}])[(doc_id * 5 + sent_id + tok * 7) % 12 + 1] END AS deprel FROM toks)"""


def _ud(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.tokens(spark, sf_dir)
    pick = lambda xs, e: F.element_at(F.array(*[F.lit(x) for x in xs]), F.expr(f"int({e} + 1)"))
    return t.select(
        *G.KEY, (F.col("tok") + 1).cast("long").alias("tok_id"), F.expr("(tok + 1) div 2").alias("head"), "word", pick(POS, "(doc_id + sent_id * 3 + tok * 5) % 7").alias("upos"),
        F.when(F.col("tok") == 0, "root").otherwise(pick(REL, "(doc_id * 5 + sent_id + tok * 7) % 12")).alias("deprel"),
    )


@query(
    f"""WITH RECURSIVE {UD}, e AS (SELECT doc_id, sent_id, tok_id AS x, head AS y FROM ud WHERE head > 0 UNION ALL SELECT doc_id, sent_id, head, tok_id FROM ud WHERE head > 0),
    r AS (SELECT doc_id, sent_id, tok_id, 0 AS hops FROM ud WHERE tok_id = 3 UNION SELECT r.doc_id, r.sent_id, e.y, hops + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.sent_id = r.sent_id AND e.x = r.tok_id WHERE hops < 3)
    SELECT doc_id, sent_id, tok_id, min(hops) AS hops FROM r GROUP BY ALL"""
)
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected steps from each sentence's third token, at most three."""
    ud = _ud(spark, sf_dir)
    return G.hops(ud, F.col("tok_id") == 3, 3).select(*G.KEY, "tok_id", "hops")


@query(
    f"""WITH RECURSIVE {UD}, e AS (SELECT doc_id, sent_id, tok_id AS x, head AS y FROM ud WHERE head > 0 UNION ALL SELECT doc_id, sent_id, head, tok_id FROM ud WHERE head > 0),
    r AS (SELECT doc_id, sent_id, tok_id AS source, tok_id, 0 AS hops FROM ud WHERE upos = 'VERB' UNION SELECT r.doc_id, r.sent_id, r.source, e.y, hops + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.sent_id = r.sent_id AND e.x = r.tok_id WHERE hops < 5),
    m AS (SELECT doc_id, sent_id, source, tok_id, min(hops) AS hops FROM r GROUP BY ALL)
    SELECT v.doc_id, v.sent_id, v.tok_id AS source, t.tok_id, coalesce(m.hops, 99) AS hops FROM ud v JOIN ud t USING (doc_id, sent_id) LEFT JOIN m ON m.doc_id = v.doc_id AND m.sent_id = v.sent_id AND m.source = v.tok_id AND m.tok_id = t.tok_id WHERE v.upos = 'VERB'"""
)
def trigger_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected steps from each verb to every token of its sentence, at most five, and 99 beyond."""
    ud = _ud(spark, sf_dir)
    return G.all_hops(ud, F.col("upos") == "VERB").select(*G.KEY, "source", "tok_id", "hops")


@query(
    f"""WITH {UD}, s AS (SELECT DISTINCT doc_id, sent_id, tok_id AS first, tok_id + 3 AS last FROM ud WHERE tok_id % 4 = 1), i AS (SELECT s.*, t.tok_id, t.head FROM s JOIN ud t USING (doc_id, sent_id) WHERE t.tok_id BETWEEN first AND last)
    SELECT doc_id, sent_id, first, last, min(tok_id) AS head_tok FROM i WHERE head = 0 OR NOT head BETWEEN first AND last GROUP BY ALL"""
)
def span_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = _ud(spark, sf_dir)
    spans = ud.where("tok_id % 4 = 1").select(*G.KEY, F.col("tok_id").alias("first"), (F.col("tok_id") + 3).alias("last"))
    return G.span_heads(ud, spans)


@query(
    f"""WITH {UD}, s AS (SELECT DISTINCT doc_id, sent_id, tok_id AS first, tok_id + 3 AS last FROM ud WHERE tok_id % 4 = 1), t AS (SELECT s.*, min(tok_id) FILTER (upos NOT IN ('DET', 'ADP', 'PUNCT')) AS trim_first, max(tok_id) FILTER (upos NOT IN ('PUNCT', 'ADP')) AS trim_last FROM s JOIN ud t USING (doc_id, sent_id) WHERE t.tok_id BETWEEN first AND last GROUP BY ALL)
    SELECT * FROM t WHERE trim_first <= trim_last"""
)
def boundary_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = _ud(spark, sf_dir)
    spans = ud.where("tok_id % 4 = 1").select(*G.KEY, F.col("tok_id").alias("first"), (F.col("tok_id") + 3).alias("last"))
    return G.trim_bounds(ud, spans)


@query(
    f"""WITH RECURSIVE {UD}, e AS (SELECT * FROM ud WHERE deprel IN ({", ".join(f"'{k}'" for k in G.KEPT)})), r AS (SELECT doc_id, sent_id, tok_id AS root, tok_id FROM ud WHERE upos IN ('NOUN', 'PROPN') UNION SELECT r.doc_id, r.sent_id, r.root, e.tok_id FROM r JOIN e ON e.doc_id = r.doc_id AND e.sent_id = r.sent_id AND e.head = r.tok_id)
    SELECT doc_id, sent_id, root, min(tok_id) AS first, max(tok_id) AS last, count(DISTINCT tok_id) AS size FROM r GROUP BY ALL"""
)
def nominal_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nominal's subtree through kept relations."""
    ud = _ud(spark, sf_dir)
    return G.closure(ud, F.col("upos").isin("NOUN", "PROPN"))


@query(
    f"""WITH RECURSIVE {UD}, r AS (SELECT doc_id, sent_id, tok_id, head AS at, 1 AS d FROM ud UNION ALL SELECT r.doc_id, r.sent_id, r.tok_id, u.head, d + 1 FROM r JOIN ud u ON u.doc_id = r.doc_id AND u.sent_id = r.sent_id AND u.tok_id = r.at WHERE d < 4),
    v AS (SELECT r.doc_id, r.sent_id, r.tok_id, arg_min(r.at, d) AS verb FROM r JOIN ud u ON u.doc_id = r.doc_id AND u.sent_id = r.sent_id AND u.tok_id = r.at WHERE u.upos = 'VERB' GROUP BY ALL)
    SELECT ud.doc_id, ud.sent_id, ud.tok_id, v.verb FROM ud LEFT JOIN v USING (doc_id, sent_id, tok_id)"""
)
def governing_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.governing_verb(_ud(spark, sf_dir), 4)


ROLE = "CASE WHEN deprel IN ('nsubj', 'nsubj:pass', 'csubj') THEN 'SUBJECT' WHEN deprel IN ('obj', 'ccomp') THEN 'OBJECT' WHEN deprel = 'iobj' THEN 'IOBJ' WHEN deprel IN ('obl', 'obl:arg') THEN 'OBLIQUE' WHEN deprel = 'appos' THEN 'APPOS' WHEN deprel = 'nmod' THEN 'NMOD' END"


@query(f"WITH {UD} SELECT doc_id, sent_id, tok_id, {ROLE} AS role FROM ud")
def role_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ud(spark, sf_dir).select(*G.KEY, "tok_id", G.role_of(F.col("deprel")).alias("role"))


@query(
    f"""WITH RECURSIVE {UD}, x AS (SELECT doc_id, sent_id, tok_id, head, deprel, {ROLE} AS role FROM ud), r AS (SELECT doc_id, sent_id, tok_id, head, role, 0 AS d FROM x WHERE role IS NULL AND deprel = 'conj'
      UNION ALL SELECT r.doc_id, r.sent_id, r.tok_id, p.head, p.role, d + 1 FROM r JOIN x p ON p.doc_id = r.doc_id AND p.sent_id = r.sent_id AND p.tok_id = r.head WHERE r.role IS NULL AND d < 4 AND (p.role IS NOT NULL OR p.deprel = 'conj')),
    f AS (SELECT doc_id, sent_id, tok_id, max(role) AS role FROM r GROUP BY ALL) SELECT x.doc_id, x.sent_id, x.tok_id, coalesce(x.role, f.role) AS role FROM x LEFT JOIN f USING (doc_id, sent_id, tok_id)"""
)
def conjunct_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ud(spark, sf_dir).withColumn("role", G.role_of(F.col("deprel")))
    return G.propagate_roles(rows, "role", 4).select(*G.KEY, "tok_id", "role")


@query(
    f"""WITH {UD}, k AS (SELECT doc_id, sent_id, head AS verb, tok_id AS kid, deprel, lower(word) AS w FROM ud WHERE deprel IN ('aux', 'aux:pass', 'advmod'))
    SELECT v.doc_id, v.sent_id, v.tok_id AS verb, least(min(kid) FILTER (k.deprel LIKE 'aux%'), v.tok_id) AS first, greatest(max(kid) FILTER (k.deprel LIKE 'aux%'), v.tok_id) AS last, coalesce(bool_or(k.deprel = 'aux:pass'), false) AS passive, coalesce(bool_or(w IN ('not', 'ne', 'pas')), false) AS negated
    FROM ud v LEFT JOIN k ON k.doc_id = v.doc_id AND k.sent_id = v.sent_id AND k.verb = v.tok_id WHERE v.upos = 'VERB' GROUP BY v.doc_id, v.sent_id, v.tok_id"""
)
def verb_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.verb_groups(_ud(spark, sf_dir))


RULES = """rules AS (SELECT doc_id, sent_id, tok_id AS child, head AS parent, CASE WHEN deprel = 'amod' THEN 1 WHEN deprel = 'flat:name' THEN 2 ELSE 3 END AS rule, 0.9::DOUBLE AS confidence FROM ud WHERE deprel IN ('amod', 'flat:name', 'case') AND head > 0
  UNION ALL SELECT doc_id, sent_id, tok_id, tok_id - 1, 4, 0.7::DOUBLE FROM ud WHERE tok_id > 1 AND upos = 'PROPN')"""


def _rule_edges(ud: DataFrame) -> DataFrame:
    by_relation = ud.where(F.col("deprel").isin("amod", "flat:name", "case") & (F.col("head") > 0))
    rule = F.when(F.col("deprel") == "amod", 1).when(F.col("deprel") == "flat:name", 2).otherwise(3)
    one = by_relation.select(*G.KEY, F.col("tok_id").alias("child"), F.col("head").alias("parent"), rule.alias("rule"), F.lit(0.9).alias("confidence"))
    two = ud.where("tok_id > 1 and upos = 'PROPN'").select(*G.KEY, F.col("tok_id").alias("child"), (F.col("tok_id") - 1).alias("parent"), F.lit(4).alias("rule"), F.lit(0.7).alias("confidence"))
    return one.union(two)


@query(f"WITH {UD}, {RULES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, child ORDER BY rule, confidence DESC, parent) AS r FROM rules) SELECT doc_id, sent_id, child, parent, rule, confidence FROM r WHERE r = 1")
def rule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by ordered rules; the first rule of a child wins."""
    return G.first_edge(_rule_edges(_ud(spark, sf_dir)))


@query(
    f"""WITH {UD}, {RULES}, a AS (SELECT doc_id, sent_id, child, arg_min(parent, (rule, -confidence, parent)) AS ap, arg_min(confidence, (rule, -confidence, parent)) AS ac FROM rules GROUP BY ALL), b AS (SELECT doc_id, sent_id, tok_id AS child, head AS bp, 0.8::DOUBLE AS bc FROM ud WHERE head > 0 AND upos IN ('NOUN', 'PROPN'))
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.sent_id, b.sent_id) AS sent_id, coalesce(a.child, b.child) AS child, coalesce(ap, bp) AS parent, round(CASE WHEN bp IS NULL THEN ac WHEN ap IS NULL THEN bc WHEN ap = bp THEN least(1.0, greatest(ac, bc) + 0.05) ELSE ac * 0.85 END, 6) AS confidence,
      CASE WHEN bp IS NULL THEN 'rule' WHEN ap IS NULL THEN 'parser' WHEN ap = bp THEN 'both' ELSE 'conflict' END AS source FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.child = b.child"""
)
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = _ud(spark, sf_dir)
    parser = ud.where("head > 0 and upos in ('NOUN', 'PROPN')").select(*G.KEY, F.col("tok_id").alias("child"), F.col("head").alias("parent"), F.lit(0.8).alias("confidence"))
    return G.merge_edges(G.first_edge(_rule_edges(ud)), parser).withColumn("confidence", F.round("confidence", 6))
