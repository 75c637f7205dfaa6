"""Relabelling rules over phrases dealt to the sentences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import derived as D
from ..functions import rules as R
from ..functions import text as T
from ..registry import ORACLES, QUERIES, query

PHRASES = (
    "120 km/h", "trois soldats", "environ dix", "40 kg", "le niveau moyen", "perte", "coût financier", "12 %", "taux de chômage", "3 GHz", "deux fois", "deux fois par jour", "2/3", "PIB", "seuil", "un vague sens", "liste",
    "rapport annuel", "grave", "totales", "nationale", "crise sanitaire", "petites", "petites et moyennes", "majeures", "stratégie", "de", "un", "beaucoup", "5 tonnes", "mille", "3-2", "2 contre 1", "1,000", "une dizaine", "12 voix",
    "la première", "traité de Rome", "le traité sur le climat", "accord de paix", "grippe aviaire", "covid", "la peste", "virus Ebola", "film", "idée", "cycle", "chimie", "conseil", "barricade", "escalier", "trappe", "piano",
    "police", "ministre", "Police de Paris", "gouvernement", "gouvernement Fillon", "ONU", "Parlement européen", "sénat", "parquets", "longue phrase sans aucun chiffre du tout", "30 points par match", "Hz", "l'armistice", "règlement général",
)
LABELS = (
    "measure percentage rate object_generic state field notion doctrine quantity law concept infra tool group_role inst_name person_name vegetal work_generic disease event_nominal document"
).split()
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
PHRASES_SQL = rf"""{D.SENTENCES_SQL}, phrases AS (SELECT doc_id, sent_id, label, text, line || ' ' || text AS line FROM (SELECT doc_id, sent_id, regexp_replace(text, '\s+', ' ', 'g') AS line,
  ({_list(PHRASES)})[(doc_id * 31 + sent_id * 7) % {len(PHRASES)} + 1] AS text, ({_list(LABELS)})[(doc_id * 13 + sent_id * 5 + (doc_id * 31 + sent_id * 7) // {len(PHRASES)}) % {len(LABELS)} + 1] AS label FROM sentences))"""
# a word's bound is one of ASCII letters there, so accents are folded on both sides
_FOLD = str.maketrans("àâäçéèêëîïôöùûüœ", "aaaceeeeiioouuuo")
DUCK = {"match": "regexp_matches(translate({c}, 'àâäçéèêëîïôöùûüœ', 'aaaceeeeiioouuuo'), '{p}')", "flags": "(?i)", "quote": lambda p: p.translate(_FOLD).replace("'", "''")}


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.sentences(spark, sf_dir).select("doc_id", "sent_id", T.squeeze(F.col("text")).alias("line"))
    pick = lambda xs, e: F.element_at(F.array(*[F.lit(x) for x in xs]), F.expr(f"int({e} % {len(xs)}) + 1"))
    phrase, label = pick(PHRASES, "(doc_id * 31 + sent_id * 7)"), pick(LABELS, f"(doc_id * 13 + sent_id * 5 + (doc_id * 31 + sent_id * 7) div {len(PHRASES)})")
    return rows.select("doc_id", "sent_id", label.alias("label"), phrase.alias("text"), F.concat("line", F.lit(" "), phrase).alias("line"))


def _register(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _phrases(spark, sf_dir).select("doc_id", "sent_id", "label", "text", R.relabel(R.RULES[name]).alias("new_label"))

    run.__name__, run.__module__ = f"relabel_{name}", __name__
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = f"WITH {PHRASES_SQL} SELECT doc_id, sent_id, label, text, {R.ladder(R.RULES[name], **DUCK)} AS new_label FROM phrases"


for _name in R.RULES:
    _register(_name)

_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_SUCC = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.SUCCESSORS.items()) + " ELSE label END"


@query(
    f"""WITH {PHRASES_SQL}, n AS (SELECT *, {_SUCC} AS new_label FROM phrases) SELECT doc_id, sent_id, label, new_label, CASE WHEN label IN {_in(R.ANIMATE)} THEN 'animate' ELSE 'inanimate' END AS animacy, CASE WHEN label IN {_in((*R.ANIMATE, "vegetal"))} THEN 'living' ELSE 'non_living' END AS living,
    CASE WHEN new_label IN {_in(R.ABSTRACT)} OR label = 'state' THEN 'abstract' ELSE 'concrete' END AS abstract, CASE WHEN new_label IN {_in(R.EVENTS)} THEN CASE WHEN label = 'state' OR new_label = 'disease' THEN 'stative' ELSE 'dynamic' END END AS dynamicity, CASE WHEN new_label IN {_in(R.WORKS)} THEN 'work' ELSE 'non_work' END AS work FROM n"""
)
def relabel_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old labels' successors and the attributes that follow from the old ones."""
    rows = _phrases(spark, sf_dir)
    return rows.select("doc_id", "sent_id", "label", R.successor(F.col("label")).alias("new_label"), *R.attributes(F.col("label")))


REASONS = ("acronyme connu", "un nom officiel", "sans raison", "rien")
CORRECTIONS_SQL = f"""said AS (SELECT label, lower(text) AS span, ({_list(LABELS)})[(doc_id * 3 + sent_id) % 3 + 14] AS suggestion, ({_list(REASONS)})[(doc_id + sent_id) % 4 + 1] AS reason FROM phrases),
  votes AS (SELECT label, span, suggestion, count(*) AS n, bool_or(regexp_matches(reason, '(?i)acronyme|officiel')) AS resolved FROM said WHERE suggestion <> label GROUP BY ALL),
  best AS (SELECT label, span, arg_max(suggestion, (n, suggestion)) AS suggestion, max(n) AS n, count(*) AS ways, arg_max(resolved, (n, suggestion)) AS resolved FROM votes GROUP BY label, span),
  corrections AS (SELECT label, span, suggestion FROM best WHERE NOT (ways > 1 AND n = 1) AND span NOT IN ('police', 'film') AND (length(span) > 8 OR resolved))"""


@query(f"WITH {PHRASES_SQL}, {CORRECTIONS_SQL} SELECT p.doc_id, p.sent_id, coalesce(c.suggestion, p.label) AS new_label, c.span IS NOT NULL AS corrected FROM phrases p LEFT JOIN corrections c ON c.label = p.label AND c.span = lower(p.text)")
def corrections_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels corrected by vote: no contradiction, no listed span, and a reason that resolves the short ones."""
    from ..operators.corpus import corrections, correct

    rows = _phrases(spark, sf_dir)
    pick = lambda xs, e: F.element_at(F.array(*[F.lit(x) for x in xs]), F.expr(f"int({e}) + 1"))
    said = rows.select("label", "text", pick(LABELS[13:16], "(doc_id * 3 + sent_id) % 3").alias("suggestion"), pick(REASONS, "(doc_id + sent_id) % 4").alias("reason"))
    table = corrections(said, ("police", "film"), "(?i)acronyme|officiel", 8)
    return correct(rows, table).select("doc_id", "sent_id", "new_label", "corrected")
