"""Filters, rankings, samples, roles and small joins over documents, spans and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derived as D
from ..functions import roles as R
from ..functions import text as T
from ..operators import spans as S
from ..operators.ordering import placed_in
from ..registry import query, table
from ..storage import written

K = "doc_id, sent_id"
ONE, BOTH = D.with_spans(("ent", 1, 10)), D.with_spans(("ent", 1, 10), ("arg", 2, 6))
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_pick = lambda xs, e: F.element_at(F.array(*[F.lit(x) for x in xs]), F.expr(f"int({e} % {len(xs)}) + 1"))
# Signs of markup, words that lack their accents, and clitic pronouns.
MARKUP = ("__NOTOC__", "__TOC__", "colspan", "rowspan", "{|", "|}", "[[", "]]", "{{", "}}", "<ref", "</ref", "<br", "<!--")
BARE = r"\b(prsid|lect|dfai|scur|dcid|supri|rpubli|gnral|fvri|dcem|franai|cono|scurit|rcent|minist|dmont|ncessai|spcial|dclar|amnag|intress|organis)"
CLITICS = "je j me m moi tu te t toi il elle le la lui se s soi nous vous ils elles les leur eux y en dont que qui où quoi -moi -toi -lui -nous -vous -leur -le -la -les -en -y".split()


def _ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 1, 10)


@query(
    f"""WITH {D.SENTENCES_SQL}, {D.TOKENS_SQL}, p AS (SELECT {K}, CASE WHEN sent_id % 9 = 2 THEN text || ' [[x]]' ELSE text END AS text, sent_id % 40 AS predictions FROM sentences), q AS (SELECT {K}, list_filter([CASE WHEN {" OR ".join(f"contains(text, '{m}')" for m in MARKUP)} THEN 'markup' END,
    CASE WHEN length(text) > 80 AND NOT regexp_matches(text, '[àâäéèêëïîôùûüçœæÀÂÄÉÈÊËÏÎÔÙÛÜÇŒÆ]') AND len(list_distinct(regexp_extract_all(lower(text), '{BARE}'))) >= 2 THEN 'accents' END, CASE WHEN predictions > 25 THEN 'predictions' END], lambda x: x IS NOT NULL) AS problems FROM p) SELECT {K}, array_to_string(problems, ',') AS problems, len(problems) = 0 AS good FROM q"""
)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with sentences: markup, missing accents, too many predictions."""
    text = F.when(F.col("sent_id") % 9 == 2, F.concat("text", F.lit(" [[x]]"))).otherwise(F.col("text"))
    rows = D.sentences(spark, sf_dir).withColumns({"text": text, "predictions": F.col("sent_id") % 40})
    markup = F.lit(False)
    for m in MARKUP:
        markup = markup | F.contains("text", F.lit(m))
    bare = F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(BARE), F.lit(0)))) >= 2
    accents = (F.length("text") > 80) & ~F.col("text").rlike("[àâäéèêëïîôùûüçœæÀÂÄÉÈÊËÏÎÔÙÛÜÇŒÆ]") & bare
    problems = F.array_compact(F.array(F.when(markup, "markup"), F.when(accents, "accents"), F.when(F.col("predictions") > 25, "predictions")))
    return rows.withColumn("p", problems).select(*S.KEY, F.array_join("p", ",").alias("problems"), (F.size("p") == 0).alias("good"))


@query(f"WITH {D.SENTENCES_SQL} SELECT {K}, length(text) AS n FROM sentences WHERE length(text) BETWEEN 40 AND 600 AND sent_id % 40 <= 25")
def length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 40 to 600 signs with at most 25 predictions."""
    return D.sentences(spark, sf_dir).where(F.length("text").between(40, 600) & (F.col("sent_id") % 40 <= 25)).select(*S.KEY, F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE n_chars BETWEEN 40 AND 3000 AND lang IN ('en', 'fr')")
def length_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("n_chars").between(40, 3000) & F.col("lang").isin("en", "fr")).select("doc_id", "lang")


MAP = {"PER": "PERSON", "LOC": "PLACE", "TIME": None}


@query(f"WITH {ONE} SELECT {K}, tok, n, CASE coarse WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'PLACE' ELSE coarse END AS label FROM ent WHERE coarse <> 'TIME'")
def labels_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels kept, renamed or dropped by a table."""
    gone = [k for k, v in MAP.items() if v is None]
    names = F.create_map(*[F.lit(x) for k, v in MAP.items() if v for x in (k, v)])
    return _ent(spark, sf_dir).where(~F.col("coarse").isin(*gone)).select(*S.KEY, "tok", "n", F.coalesce(names[F.col("coarse")], "coarse").alias("label"))


@query(f"WITH {ONE} SELECT {K}, tok, n FROM ent WHERE NOT (length(text) <= 2 OR rtrim(lower(text), '''') IN {R.listed(tuple(CLITICS))} OR NOT regexp_matches(text, '[a-zA-ZÀ-ÿ]'))")
def clitics_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that aren't too short, clitic pronouns or without a letter."""
    bare = F.rtrim(F.lower("text"), F.lit("'"))
    return _ent(spark, sf_dir).where(~((F.length("text") <= 2) | bare.isin(*CLITICS) | ~F.col("text").rlike("[a-zA-ZÀ-ÿ]"))).select(*S.KEY, "tok", "n")


@query(f"WITH {ONE} SELECT {K}, tok, n FROM ent WHERE NOT (coarse IN ('OBJECT', 'TIME') AND regexp_matches(text, '\\p{{Ll}}') AND NOT regexp_matches(text, '\\p{{Lu}}') AND NOT contains(text, ' '))")
def bare_nominals_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal spans other than a single word in small letters."""
    bare = F.col("coarse").isin("OBJECT", "TIME") & F.col("text").rlike(r"\p{Ll}") & ~F.col("text").rlike(r"\p{Lu}") & ~F.contains("text", F.lit(" "))
    return _ent(spark, sf_dir).where(~bare).select(*S.KEY, "tok", "n")


ROLES = ("SUBJECT", "OBJECT", "OBLIQUE", "OBLIQUE_CAUSE", "APPOS", "NONE", "OBLIQUE")
HINTS = (*R.TIME[:1], *R.PLACE[:2], *R.MEASURE[:1], *R.DOMAIN[:1], "law", "document", *R.EVENT[:2], "weapon", "food", "norp", "inst_name", "org_name", "person_name", "group_role", "disease", "other")
FAMILIES = ("Communication", "Cognition", "Causality", "State_Change", "Conflict", "Temporal", "Possession", "Relation", "Social", "Perception", "OTHER", "Movement")
RELS = ("APPOS", "POSS", "SOURCE", "LOC", "TIME", "NMOD", "NMOD", "AMOD", "MISC")
CASES = f"""cases AS (SELECT {K}, tok, n, "end", ({_list(ROLES)})[(doc_id + tok) % 7 + 1] AS role, ({_list(HINTS)})[(doc_id * 3 + sent_id + tok * 5 + n) % {len(HINTS)} + 1] AS label, ({_list(FAMILIES)})[(sent_id * 7 + tok) % 12 + 1] AS family, CASE WHEN (tok + n) % 5 = 0 THEN 'passive' ELSE 'active' END AS voice,
  CASE WHEN tok % 4 > 0 THEN ({_list(RELS)})[(tok * 3 + sent_id) % 9 + 1] END AS relation, ({_list(HINTS)})[(doc_id + sent_id * 5 + tok) % {len(HINTS)} + 1] AS parent_label, "end" + tok % 2 AS parent_end FROM ent)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ent(spark, sf_dir).select(
        *S.KEY, "tok", "n", "end", _pick(ROLES, "(doc_id + tok)").alias("role"), _pick(HINTS, "(doc_id * 3 + sent_id + tok * 5 + n)").alias("label"), _pick(FAMILIES, "(sent_id * 7 + tok)").alias("family"), F.expr("CASE WHEN (tok + n) % 5 = 0 THEN 'passive' ELSE 'active' END").alias("voice"),
        F.when(F.col("tok") % 4 > 0, _pick(RELS, "(tok * 3 + sent_id)")).alias("relation"), _pick(HINTS, "(doc_id + sent_id * 5 + tok)").alias("parent_label"), (F.col("end") + F.col("tok") % 2).alias("parent_end"),
    )


@query(f"WITH {ONE}, {CASES} SELECT {K}, tok, n, {R.semantic_sql()} AS semantic, {R.nominal_sql()} AS nominal FROM cases")
def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic roles by syntactic role, label and verb family, and those that follow from nominal relations."""
    return _cases(spark, sf_dir).select(*S.KEY, "tok", "n", R.semantic_role().alias("semantic"), R.nominal_role().alias("nominal"))


@query(f"WITH {ONE}, {CASES}, s AS (SELECT *, {R.semantic_sql()} AS now, CASE WHEN tok % 3 = 0 THEN NULL WHEN tok % 3 = 1 THEN 'AGENT' ELSE {R.semantic_sql()} END AS before FROM cases) SELECT CASE WHEN before IS NOT DISTINCT FROM now THEN 'unchanged' WHEN before IS NULL THEN 'newly assigned' ELSE 'changed' END AS what, before, now, count(*) AS n FROM s GROUP BY ALL")
def semantic_role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles computed anew beside those a corpus has, counted by what changed."""
    before = F.when(F.col("tok") % 3 == 0, None).when(F.col("tok") % 3 == 1, "AGENT").otherwise(R.semantic_role())
    rows = _cases(spark, sf_dir).select(R.semantic_role().alias("now"), before.alias("before"))
    what = F.when(F.col("before").eqNullSafe(F.col("now")), "unchanged").when(F.col("before").isNull(), "newly assigned").otherwise("changed")
    return rows.groupBy(what.alias("what"), "before", "now").agg(F.count("*").alias("n"))


DEPRELS = (*R.RELATIONS, "obl:tmod", "xcomp", "nmod:loc")
_REL = "CASE deprel " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.RELATIONS.items()) + " END"
_BASE = "CASE string_split(deprel, ':')[1] " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.RELATIONS.items()) + " END"


@query(
    f"""WITH {ONE}, {CASES}, d AS (SELECT *, ({_list(DEPRELS)})[(doc_id + sent_id * 3 + tok) % {len(DEPRELS)} + 1] AS deprel FROM cases), f AS (SELECT *, coalesce({_REL}, {_BASE}, 'MISC') AS found, string_split(deprel, ':')[1] IN ('obl', 'advmod', 'nmod') AS loose FROM d)
    SELECT {K}, tok, n, CASE WHEN found IN ('MISC', 'NMOD') AND loose AND label IN {R.listed(R.TIME)} THEN 'TIME' WHEN found IN ('MISC', 'NMOD') AND loose AND label IN {R.listed(R.PLACE)} THEN 'LOC' ELSE found END AS relation FROM f"""
)
def nominal_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select(*S.KEY, "tok", "n", R.relation(_pick(DEPRELS, "(doc_id + sent_id * 3 + tok)"), F.col("label")).alias("relation"))


@query(
    """WITH r AS (SELECT vec_id, embedding AS v FROM embeddings), c AS (SELECT vec_id, unnest(range(0, 8)) AS c, v FROM r), s AS (SELECT vec_id, c, v[c + 1]::DOUBLE AS score, list_transform(range(0, 7), lambda i: v[8 + c * 7 + i + 1]::DOUBLE) AS fine FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, c) AS r FROM s WHERE score >= 0.0) SELECT vec_id, c AS coarse, list_position(fine, list_max(fine))::BIGINT - 1 AS best, list_position(fine, list_sort(fine, 'DESC')[2])::BIGINT - 1 AS second FROM k WHERE r <= 2"""
)
def top_two_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best coarse classes above a bound, and the best and second-best fine class inside each family."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    scored = F.filter(F.transform(F.slice("v", 1, 8), lambda x, i: F.struct((-x).alias("s"), i.cast("long").alias("c"))), lambda x: x["s"] <= 0.0)
    chosen = rows.select("vec_id", "v", F.explode(F.slice(F.array_sort(scored), 1, 2)).alias("k"))
    fine = F.slice("v", (F.col("k.c") * 7 + 9).cast("int"), 7)
    place = lambda n: F.array_position(fine, F.get(F.sort_array(fine, False), F.lit(n))) - 1
    return chosen.select("vec_id", F.col("k.c").alias("coarse"), place(0).alias("best"), place(1).alias("second"))


@query("SELECT vec_id, list_transform(list_sort(list_transform(range(0, len(embedding)), lambda i: {'s': -embedding[i + 1]::DOUBLE, 'i': i}))[1:3], lambda x: x.i) AS top FROM embeddings")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best places of each row of logits."""
    ranked = F.array_sort(F.transform("embedding", lambda x, i: F.struct((-x.cast("double")).alias("s"), i.cast("long").alias("i"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice(ranked, 1, 3), lambda x: x["i"]).alias("top"))


@query("SELECT vec_id, round(1 / (1 + exp(-embedding[2]::DOUBLE)), 9) AS entailed, round(exp(embedding[3]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)), 9) AS softmax, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS place FROM embeddings WHERE label = 3")
def cross_encoder_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of one query (here those of one label) by the sigmoid of their second logit, and the softmax of the third; all come back."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = table(spark, sf_dir, "embeddings").where("label = 3")
    softmax = F.exp(e(2)) / (F.exp(e(0)) + F.exp(e(1)) + F.exp(e(2)))
    order = Window.orderBy(F.desc(F.get("embedding", F.lit(1))), "vec_id")  # one query's candidates
    return rows.select("vec_id", F.round(1 / (1 + F.exp(-e(1))), 9).alias("entailed"), F.round(softmax, 9).alias("softmax"), F.row_number().over(order).alias("place"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '-inf'::DOUBLE ELSE n_chars / 7.0::DOUBLE END AS score FROM documents")
def remote_scores_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that come back by index, without those of some: these get minus infinity, and the order stays."""
    docs = table(spark, sf_dir, "documents")
    scores = docs.where("doc_id % 4 <> 3").select(F.col("doc_id").alias("index"), (F.col("n_chars") / F.lit(7.0)).alias("score"))
    return docs.join(scores, F.col("doc_id") == F.col("index"), "left").select("doc_id", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


@query(
    f"""WITH {BOTH}, p AS (SELECT a.doc_id, a.sent_id, a."start" AS gs, a."end" AS ge, b."start", b."end", (least(a."end", b."end") - greatest(a."start", b."start")) / (greatest(a."end", b."end") - least(a."start", b."start"))::DOUBLE AS iou FROM ent a JOIN arg b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a."start" < b."end" AND b."start" < a."end" AND NOT (a."start" = b."start" AND a."end" = b."end")),
    r AS (SELECT *, row_number() OVER (PARTITION BY {K}, gs, ge ORDER BY iou DESC, "start", "end") AS r FROM p) SELECT {K}, "start", "end", round(max(iou), 9) AS iou FROM r WHERE r <= 4 GROUP BY ALL"""
)
def top_overlaps_for_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each gold span the four candidates that overlap it most, each candidate once."""
    gold, other = _ent(spark, sf_dir).select(*S.KEY, "start", "end"), D.spans(spark, sf_dir, 2, 6).select(*S.KEY, "start", "end")
    apart = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & ~((F.col("a_start") == F.col("b_start")) & (F.col("a_end") == F.col("b_end")))
    both = S.pairs(gold, other, "inner", apart)
    iou = S.iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    item = F.struct((-iou).alias("d"), F.col("b_start").alias("start"), F.col("b_end").alias("end"))
    best = both.groupBy(*S.KEY, "a_start", "a_end").agg(F.slice(F.array_sort(F.collect_list(item)), 1, 4).alias("best")).select(*S.KEY, F.explode("best").alias("b"))
    return best.groupBy(*S.KEY, "b.start", "b.end").agg(F.round(-F.min("b.d"), 9).alias("iou"))


@query("SELECT vec_id, round(64 * (s * cos(0.5::DOUBLE) - sqrt(greatest(0, 1 - s * s)) * sin(0.5::DOUBLE)), 6) AS logit FROM (SELECT vec_id, greatest(-1.0, least(1.0, embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))) AS s FROM embeddings)")
def angular_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s * cos(angle + margin) of each vector against the first axis."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get("embedding", F.lit(0)).cast("double") / norm))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cos.alias("s"))
    return rows.select("vec_id", F.round(64 * (F.col("s") * F.cos(F.lit(0.5)) - F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("s") * F.col("s"))) * F.sin(F.lit(0.5))), 6).alias("logit"))


@query("SELECT vec_id, round(1 / (1 + exp(-(0.25 + list_sum(list_transform(range(0, len(embedding)), lambda i: (embedding[i + 1]::DOUBLE - 0.01) / 0.5 * ((i % 3) - 1) * 0.1))))), 9) AS p FROM embeddings")
def logistic_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised vectors through a linear model and the sigmoid."""
    terms = F.transform("embedding", lambda x, i: (x.cast("double") - 0.01) / 0.5 * ((i % 3) - 1) * 0.1)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-(total + 0.25))), 9).alias("p"))


@query("SELECT doc_id, 0.1 + (0.9 - 0.1) * least(1.0, greatest(0.0, (doc_id - 20) / 50.0::DOUBLE)) AS weight FROM documents")
def curriculum_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight that grows from its warm-up value to its target over some steps."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("doc_id") - 20) / F.lit(50.0)))
    return table(spark, sf_dir, "documents").select("doc_id", (F.lit(0.1) + F.expr("0.9D - 0.1D") * share).alias("weight"))


@query("SELECT source, avg(n_chars)::DOUBLE AS mean, median(n_chars)::DOUBLE AS median, quantile_cont(n_chars, 0.95)::DOUBLE AS p95, max(n_chars) AS most FROM documents GROUP BY source")
def summary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and 95th percentile by source."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.95).alias("p95"), F.max(n).alias("most"))


@query("SELECT id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM (SELECT id, ('0x' || substr(md5('7' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT 'abstract_' || doc_id AS id FROM documents WHERE lang = 'en'))")
def prefixed_rows_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a prefix, dealt to train, val and test by a seeded hash, and others left out."""
    from ..operators import corpus as C

    rows = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("lang") == "en", "abstract_").otherwise("other_"), "doc_id").alias("id"))
    return C.split(rows.where(F.col("id").startswith("abstract_")), 7, (0.8, 0.1, 0.1), ("train", "val", "test"), "id")


@query(
    f"""WITH {ONE}, z AS (SELECT {K}, max(tok) + 1 AS size FROM toks GROUP BY {K}), g AS (SELECT z.doc_id, z.sent_id, first, first + n - 1 AS last FROM z, (SELECT unnest(range(1, 9, 3)) AS n), (SELECT unnest(range(0, 400, 4)) AS first) WHERE first + n <= size),
    f AS (SELECT g.*, row_number() OVER (PARTITION BY g.doc_id, g.sent_id ORDER BY md5('3' || g.doc_id || '_' || g.sent_id || '_' || first || '_' || last)) AS r FROM g WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = g.doc_id AND e.sent_id = g.sent_id AND e.tok <= g.last AND g.first <= e.tok + e.n - 1))
    SELECT {K}, first, last FROM f WHERE r <= 2"""
)
def soft_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans a sentence that no gold span overlaps, picked by a seeded hash."""
    sizes = D.tokens(spark, sf_dir).groupBy(*S.KEY).agg((F.max("tok") + 1).cast("long").alias("size"))
    gold = _ent(spark, sf_dir).groupBy(*S.KEY).agg(F.collect_list(F.struct("tok", "n")).alias("gold"))
    grid = sizes.join(gold, S.KEY, "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(7), F.lit(3)))).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(396), F.lit(4))))
    grid = grid.withColumn("last", F.col("first") + F.col("n") - 1).where("first + n <= size")
    hit = F.exists("gold", lambda g: (g["tok"] <= F.col("last")) & (F.col("first") <= g["tok"] + g["n"] - 1))
    h = F.md5(F.concat(F.lit("3"), "doc_id", F.lit("_"), "sent_id", F.lit("_"), "first", F.lit("_"), "last").cast("binary"))
    place = F.row_number().over(Window.partitionBy(*S.KEY).orderBy("h"))
    return grid.where(~F.coalesce(hit, F.lit(False))).withColumn("h", h).withColumn("r", place).where("r <= 2").select(*S.KEY, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"""WITH {BOTH} SELECT {K}, "start", "end", 'a' AS side FROM ent UNION ALL SELECT {K}, "start", "end", 'b' FROM arg""")
def candidates_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both sources, by start within a sentence."""
    return D.sides(spark, sf_dir, {"a": (1, 10), "b": (2, 6)}).select(*S.KEY, "start", "end", "side").sortWithinPartitions(*S.KEY, "start")


@query(f"""WITH {ONE} SELECT DISTINCT {K}, "start" - "start" % 3 AS source, "end" - "end" % 3 AS target, coarse AS syntactic, fine AS semantic FROM ent""")
def edges_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, each combination of ends and relations once."""
    rows = _ent(spark, sf_dir).select(*S.KEY, F.expr("start - start % 3").alias("source"), F.expr("end - end % 3").alias("target"), F.col("coarse").alias("syntactic"), F.col("fine").alias("semantic"))
    twice = rows.select(*rows.columns, F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return twice.select(*rows.columns).dropDuplicates()


@query(f"""WITH {BOTH} SELECT {K}, "start", "end", max(s) AS verb_score FROM (SELECT e.doc_id, e.sent_id, e."start", e."end", coalesce(a.score, 0.0) AS s FROM ent e LEFT JOIN arg a ON a.doc_id = e.doc_id AND a.sent_id = e.sent_id AND a."start" <= e."start" AND a."end" >= e."end") GROUP BY {K}, "start", "end" """)
def containment_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest score among the argument spans that contain a span."""
    known = D.spans(spark, sf_dir, 2, 6).groupBy(*S.KEY).agg(F.collect_list(F.struct("start", "end", "score")).alias("a"))
    over = F.filter("a", lambda x: (x["start"] <= F.col("start")) & (x["end"] >= F.col("end")))
    best = F.coalesce(F.array_max(F.transform(over, lambda x: x["score"])), F.lit(0.0))
    return _ent(spark, sf_dir).join(known, S.KEY, "left").select(*S.KEY, "start", "end", best.alias("verb_score"))


@query(f"""WITH {ONE}, w AS (SELECT e.doc_id, e.tok, e.n, e.sent_id, row_number() OVER (PARTITION BY e.doc_id, e.sent_id, e.tok, e.n ORDER BY s.sent_id) AS r, s.sent_id AS found FROM ent e JOIN sentences s ON s.doc_id = e.doc_id AND s.sent_id * 100 <= e.sent_id * 100 + e.tok % 50 AND s.sent_id * 100 + 100 >= e.sent_id * 100 + e.tok % 50 + 1) SELECT {K}, tok, n, found FROM w WHERE r = 1""")
def sentence_of_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence (a stretch of 100 places here) that contains a span: an equi-join on the stretch, not on ranges."""
    place = F.col("sent_id") * 100 + F.col("tok") % 50
    stretches = D.sentences(spark, sf_dir).select("doc_id", F.col("sent_id").alias("found"))
    spans = _ent(spark, sf_dir).withColumn("place", place)
    candidates = spans.withColumn("found", F.explode(F.array(F.floor((F.col("place") - 99) / 100), F.floor(F.col("place") / 100))))
    inside = candidates.join(stretches, ["doc_id", "found"]).where((F.col("found") * 100 <= F.col("place")) & (F.col("found") * 100 + 100 >= F.col("place") + 1))
    return inside.groupBy(*S.KEY, "tok", "n").agg(F.min("found").alias("found"))


@query(
    f"""WITH {BOTH}, m AS (SELECT a.doc_id, a.sent_id, a."start", a."end", b."start" AS best, row_number() OVER (PARTITION BY a.doc_id, a.sent_id, a."start", a."end" ORDER BY least(a."end", b."end") - greatest(a."start", b."start") DESC NULLS LAST, b."start", b."end") AS r FROM ent a LEFT JOIN arg b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND (least(a."end", b."end") - greatest(a."start", b."start")) >= 0.6 * (a."end" - a."start"))
    SELECT {K}, "start", "end", best FROM m WHERE r = 1"""
)
def best_span_for_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span that covers most of a range, at least 60 percent of it."""
    known = D.spans(spark, sf_dir, 2, 6).groupBy(*S.KEY).agg(F.collect_list(F.struct("start", "end")).alias("b"))
    shared = lambda x: F.least(x["end"], F.col("end")) - F.greatest(x["start"], F.col("start"))
    near = F.filter("b", lambda x: shared(x) >= F.expr("0.6D") * (F.col("end") - F.col("start")))
    ranked = F.transform(near, lambda x: F.struct(shared(x).alias("n"), (-x["start"]).alias("s"), (-x["end"]).alias("e")))
    return _ent(spark, sf_dir).join(known, S.KEY, "left").select(*S.KEY, "start", "end", (-F.array_max(ranked)["s"]).alias("best")).distinct()


@query(f"""WITH {ONE}, f AS (SELECT {K}, "start" // 10 AS place, arg_min(coarse, (tok, n)) AS voice FROM ent GROUP BY ALL) SELECT e.doc_id, e.sent_id, tok, n, voice FROM ent e JOIN f ON f.doc_id = e.doc_id AND f.sent_id = e.sent_id AND f.place = e."end" // 10""")
def verb_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index by place in which the first entry wins, looked up by spans."""
    rows = _ent(spark, sf_dir)
    index = rows.groupBy(*S.KEY, F.expr("start div 10").alias("place")).agg(F.min_by("coarse", F.struct("tok", "n")).alias("voice"))
    return rows.withColumn("place", F.expr("end div 10")).join(index, [*S.KEY, "place"]).select(*S.KEY, "tok", "n", "voice")


@query(f"WITH {D.SENTENCES_SQL}, t AS (SELECT doc_id, list(text ORDER BY sent_id) AS s, list(length(text) ORDER BY sent_id) AS v FROM sentences GROUP BY doc_id) SELECT doc_id, unnest(range(0, len(s))) AS place, unnest(s) AS text, unnest(v) AS vector FROM t")
def zipped_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and results in order, put together by an explicit position."""
    rows = D.sentences(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id")) - 1)
    vectors = rows.select("doc_id", "place", F.length("text").cast("long").alias("vector"))
    return rows.select("doc_id", "place", "text").join(vectors, ["doc_id", "place"])


FEATS = "'number=' || lang || '|GENDER=' || source || '|Mood=x'"


@query("SELECT doc_id, lang AS number, source AS gender, NULL::VARCHAR AS tense, 'x' AS other FROM documents")
def typed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by name in whatever case; those without a column of their own go into `other`."""
    feats = T.feature_map(F.expr(FEATS))
    lower = F.transform_keys(feats, lambda k, _: F.lower(k))
    known = ("number", "gender", "tense")
    other = F.map_filter(lower, lambda k, _: ~k.isin(*known))
    return table(spark, sf_dir, "documents").select("doc_id", *[F.try_element_at(lower, F.lit(k)).alias(k) for k in known], F.array_join(F.map_values(other), ",").alias("other"))


@query(f"WITH {ONE} SELECT {K}, tok, n, '[SPAN] ' || text || ' [CONTEXT] ' || left(line, 120) AS formatted FROM ent JOIN (SELECT {K}, regexp_replace(text, '\\s+', ' ', 'g') AS line FROM sentences) USING ({K})")
def spans_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.sentences(spark, sf_dir).select(*S.KEY, T.squeeze(F.col("text")).alias("line"))
    return _ent(spark, sf_dir).join(lines, S.KEY).select(*S.KEY, "tok", "n", F.concat(F.lit("[SPAN] "), "text", F.lit(" [CONTEXT] "), F.substring("line", 1, 120)).alias("formatted"))


@query(
    f"""WITH {ONE}, v AS (SELECT coarse AS label, lower(trim(text)) AS span, min((tok + n) % 3) AS k FROM ent WHERE tok % 4 = 0 GROUP BY ALL) SELECT e.doc_id, e.sent_id, tok, n, CASE WHEN k = 1 THEN 'REVIEWED' WHEN k = 2 AND coarse = 'LOC' THEN 'PLACE' ELSE coarse END AS label FROM ent e LEFT JOIN v ON v.label = e.coarse AND v.span = lower(trim(e.text)) WHERE NOT coalesce(k = 2 AND coarse <> 'LOC', false)"""
)
def review_verdicts_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by label and text: keep, relabel or remove; removal of one label is a renaming."""
    rows = _ent(spark, sf_dir)
    key = F.lower(F.trim("text"))
    verdicts = rows.where("tok % 4 = 0").groupBy("coarse", key.alias("span")).agg(F.min((F.col("tok") + F.col("n")) % 3).alias("k"))
    joined = rows.withColumn("span", key).join(verdicts, ["coarse", "span"], "left")
    removed = F.coalesce((F.col("k") == 2) & (F.col("coarse") != "LOC"), F.lit(False))
    label = F.when(F.col("k") == 1, "REVIEWED").when((F.col("k") == 2) & (F.col("coarse") == "LOC"), "PLACE").otherwise(F.col("coarse"))
    return joined.where(~removed).select(*S.KEY, "tok", "n", label.alias("label"))


@query(
    f"""WITH {ONE}, x AS (SELECT {K}, tok, coarse, max(n) AS longest FROM ent WHERE (doc_id + tok) % 2 = 0 GROUP BY ALL), h AS (SELECT e.*, longest, max(n) OVER (PARTITION BY e.doc_id, e.sent_id, e.tok, e.coarse) AS there FROM ent e LEFT JOIN x USING ({K}, tok, coarse)) SELECT {K}, tok, CASE WHEN longest IS NOT NULL AND n < longest THEN longest ELSE n END AS n, coarse FROM h WHERE NOT coalesce(n < longest AND there >= longest, false)"""
)
def span_extensions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted extensions: a short span goes if the long one is there, else it is widened."""
    rows = _ent(spark, sf_dir).select(*S.KEY, "tok", "n", "coarse")
    group = [*S.KEY, "tok", "coarse"]
    of = Window.partitionBy(*group)
    joined = rows.withColumns({"longest": F.max(F.when(F.expr("(doc_id + tok) % 2 = 0"), F.col("n"))).over(of), "there": F.max("n").over(of)})
    short = F.coalesce(F.col("n") < F.col("longest"), F.lit(False))
    return joined.where(~(short & (F.col("there") >= F.col("longest")))).select(*S.KEY, "tok", F.when(short, F.col("longest")).otherwise(F.col("n")).alias("n"), "coarse")


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, source FROM documents), b AS (SELECT source, place // 10 AS batch, list(doc_id ORDER BY place) AS ids FROM o GROUP BY ALL), v AS (SELECT source, batch, list_transform(list_filter(ids, lambda x: x % 7 <> 0), lambda x: CASE WHEN x % 2 = 0 THEN 'CORRECT' ELSE 'SUSPECT' END) AS verdicts FROM b)
    SELECT o.doc_id, coalesce(verdicts[place % 10 + 1], 'PARSE_MISSING') AS verdict FROM o JOIN v ON v.source = o.source AND v.batch = o.place // 10"""
)
def verdicts_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of verdicts put to the rows of their batch by position; rows without one are marked."""
    rows = written(placed_in(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", [F.col("doc_id")]).withColumn("batch", F.expr("place div 10")))
    ids = rows.groupBy("source", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    reply = F.to_json(F.transform(F.filter("ids", lambda x: x % 7 != 0), lambda x: F.when(x % 2 == 0, "CORRECT").otherwise("SUSPECT")))
    verdicts = ids.select("source", "batch", F.from_json(reply, "array<string>").alias("verdicts"))
    return rows.join(verdicts, ["source", "batch"]).select("doc_id", F.coalesce(F.get("verdicts", (F.col("place") % 10).cast("int")), F.lit("PARSE_MISSING")).alias("verdict"))


@query(f"WITH {D.SENTENCES_SQL}, n AS (SELECT doc_id, sent_id, lower(trim(text)) AS key FROM sentences), k AS (SELECT key, min(doc_id) AS d FROM n WHERE key NOT IN (SELECT lower(trim(text)) FROM benchmark WHERE text IS NOT NULL) AND doc_id % 5 <> 0 GROUP BY key HAVING NOT bool_or(key IN (SELECT key FROM n WHERE doc_id % 5 = 0))) SELECT key, 'new_' || md5(key) AS id, d AS doc_id FROM k")
def new_corpus_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sentences that neither the benchmark nor the known corpus (every fifth document) has, once each, with an id made for them."""
    rows = D.sentences(spark, sf_dir).select("doc_id", F.lower(F.trim("text")).alias("key"))
    known = rows.where("doc_id % 5 = 0").select("key").union(table(spark, sf_dir, "benchmark").select(F.lower(F.trim("text")))).distinct()
    new = rows.where("doc_id % 5 <> 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(known, "key", "left_anti")
    return new.select("key", F.concat(F.lit("new_"), F.md5(F.col("key").cast("binary"))).alias("id"), "doc_id")
