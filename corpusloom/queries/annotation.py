"""Queries of splits under quotas, labels and offsets mended, spans extended, and feeds read until there is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import derived as D
from ..functions import text as T
from ..operators import labels as B
from ..operators import offsets as O
from ..operators import quotas
from ..operators import spans as S
from ..registry import query, table
from ..storage import scratch
from ..streaming import feeds
from .corpora import RARITY, _tagged

K = "doc_id, sent_id"
ONE = D.with_spans(("ent", 1, 10))

_QUOTAS = f"""{RARITY}, n AS (SELECT count(*) AS n FROM documents), rare AS (SELECT label, df, row_number() OVER (ORDER BY df, label) AS k, least(10, df // 3) AS share FROM f WHERE df < 60),
cand AS MATERIALIZED (SELECT k, share, list(doc_id ORDER BY round(score, 6) DESC, doc_id) AS ids FROM (SELECT doc_id, unnest(t) AS label FROM tags) JOIN rare USING (label) JOIN s USING (doc_id) GROUP BY k, share),
fold(k, val, test) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT k, list_concat(val, free[1:share]), list_concat(test, free[share + 1:2 * share])
  FROM (SELECT c.k, val, test, share, list_filter(ids, lambda x: NOT list_contains(val, x) AND NOT list_contains(test, x)) AS free FROM fold JOIN cand c ON c.k = fold.k + 1)),
done AS (SELECT * FROM fold ORDER BY k DESC LIMIT 1), taken AS (SELECT unnest(val) AS doc_id, 'val' AS split FROM done UNION ALL SELECT unnest(test), 'test' FROM done),
rest AS (SELECT doc_id, row_number() OVER (ORDER BY md5('8' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM taken)),
need AS (SELECT greatest(0, n // 8 - (SELECT count(*) FROM taken WHERE split = 'val')) AS v, greatest(0, n // 8 - (SELECT count(*) FROM taken WHERE split = 'test')) AS t FROM n)"""


@query(f"WITH RECURSIVE {_QUOTAS} SELECT doc_id, split FROM taken UNION ALL SELECT doc_id, CASE WHEN r <= v THEN 'val' WHEN r <= v + t THEN 'test' ELSE 'train' END FROM rest, need")
def rare_quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split so that rare labels have their quota in val and test."""
    rows = _tagged(spark, sf_dir)
    size = rows.count() // 8
    return quotas.rare_quota_split(rows, "doc_id", "tags", 60, 10, size, size, 8)


FINE = [f"{c}_{i}" for c in D.COARSE for i in (0, 1)]


def said_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as annotators may write them: known ones, in another case, with signs lost or taken from the span, or words."""
    spans = D.spans(spark, sf_dir, 1, 10)
    ways = [F.col("fine"), F.lower("fine"), F.concat(F.substring("fine", 2, 9), F.substring("text", 1, 1)), F.concat(F.substring("fine", 1, 4), F.substring("text", 1, 3)), F.concat(F.reverse(F.substring("fine", 1, 3)), F.substring("fine", 4, 9)), F.substring("text", 1, 6)]
    return spans.select(F.element_at(F.array(*ways), F.expr(f"int(tok % {len(ways)}) + 1")).alias("label")).distinct()


@query()
def labels_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each written label with the known one it stands for."""
    known = spark.createDataFrame([(x, i) for i, x in enumerate(FINE)], "label string, place int")
    return B.map_labels(said_labels(spark, sf_dir), known)


def _shifted(column: str) -> Column:
    moved = F.when(F.col("tok") % 5 == 3, None).when(F.col("tok") % 4 == 2, F.col(column) + 7).otherwise(F.col(column))
    return moved + F.when(F.col("sent_id") % 3 == 1, 1).otherwise(0)


_MOVE = """CASE WHEN tok % 5 = 3 THEN NULL WHEN tok % 4 = 2 THEN "{0}" + 7 ELSE "{0}" END + CASE WHEN sent_id % 3 = 1 THEN 1 ELSE 0 END"""
_FIND = "CASE WHEN instr(substr(line, {0} + 1), own) > 0 THEN {0} + instr(substr(line, {0} + 1), own) - 1 WHEN instr(lower(substr(line, {0} + 1)), lower(own)) > 0 THEN {0} + instr(lower(substr(line, {0} + 1)), lower(own)) - 1 END"
_SQUEEZED = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(
    rf"""WITH RECURSIVE {ONE}, sp AS MATERIALIZED (SELECT {K}, row_number() OVER w AS i, coarse AS label, {_MOVE.format("start")} AS s, {_MOVE.format("end")} AS e, CASE tok % 7 WHEN 0 THEN lower(text) WHEN 4 THEN text || '?' WHEN 5 THEN NULL ELSE text END AS own FROM ent WINDOW w AS (PARTITION BY {K} ORDER BY "start", "end")),
    ln AS MATERIALIZED (SELECT {K}, regexp_replace(text, '\s+', ' ', 'g') AS line, CASE WHEN (SELECT min(s) FROM sp WHERE sp.doc_id = t.doc_id AND sp.sent_id = t.sent_id) >= 1 THEN 1 ELSE 0 END AS sh FROM sentences t),
    f(doc_id, sent_id, i, cur, label, b, e, line) AS (SELECT {K}, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, line FROM ln UNION ALL
      SELECT {K}, i, CASE WHEN moves THEN last ELSE cur END, label, coalesce(first, whole), coalesce(last, whole + length(own)), line FROM (
        SELECT *, CASE WHEN good AND fits THEN st WHEN good THEN coalesce(near, st) WHEN NOT stated THEN near END AS first, CASE WHEN good AND fits THEN en WHEN good THEN coalesce(near + length(own), en) WHEN NOT stated THEN near + length(own) END AS last, CASE WHEN good THEN fits OR near IS NOT NULL WHEN NOT stated THEN near IS NOT NULL ELSE false END AS moves FROM (
          SELECT *, own IS NULL OR {_SQUEEZED.format("own")} = {_SQUEEZED.format("substr(line, st + 1, en - st)")} AS fits, CASE WHEN length(own) > 0 THEN {_FIND.format("cur")} END AS near, CASE WHEN length(own) > 0 THEN {_FIND.format("0")} END AS whole FROM (
            SELECT f.doc_id, f.sent_id, sp.i, f.cur, f.line, sp.label, sp.own, sp.s - sh AS st, sp.e - sh AS en, sp.s IS NOT NULL AND sp.e IS NOT NULL AS stated, coalesce(sp.e > sp.s, false) AS good FROM f JOIN sp ON sp.doc_id = f.doc_id AND sp.sent_id = f.sent_id AND sp.i = f.i + 1 JOIN ln ON ln.doc_id = f.doc_id AND ln.sent_id = f.sent_id))))
    SELECT {K}, label, b AS "start", e AS "end", substr(line, b + 1, e - b) AS text FROM f WHERE i > 0 AND b IS NOT NULL"""
)
def offsets_by_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose offsets count from 1, are wrong or missing, put where their texts stand, in order."""
    own = F.when(F.col("tok") % 7 == 0, F.lower("text")).when(F.col("tok") % 7 == 4, F.concat("text", F.lit("?"))).when(F.col("tok") % 7 == 5, None).otherwise(F.col("text"))
    rows = D.spans(spark, sf_dir, 1, 10).select(*S.KEY, F.struct("start", "end").alias("o"), F.struct(F.col("coarse").alias("label"), _shifted("start").alias("start"), _shifted("end").alias("end"), own.alias("text")).alias("s"))
    listed = rows.groupBy(*S.KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]).alias("spans"))
    lines = D.sentences(spark, sf_dir).select(*S.KEY, T.squeeze(F.col("text")).alias("line"))
    return lines.join(listed, S.KEY).select(*S.KEY, F.explode(O.repaired_spans(F.col("line"), F.col("spans"))).alias("x")).select(*S.KEY, "x.*")


# Labels of spans that reach out, of what they reach for, and of those that stand apart.
EXTENSIBLE = ("hint_group_role", "hint_person_role", "hint_inst_role", "hint_org_role", "hint_org_name", "hint_person_name", "hint_loc_generic", "hint_vehicle", "hint_object_generic")
NORP = "hint_norp"
APART = ("verb_trigger", "pron_subj", "pron_obj")
HINTS = {"PER": "hint_person_name", "ORG": "hint_org_name", "LOC": NORP, "TIME": "verb_trigger", "OBJECT": "hint_vehicle"}
_HINT = "CASE coarse " + " ".join(f"WHEN '{c}' THEN '{h}'" for c, h in HINTS.items()) + " END"
_SPAN = 'STRUCT("start" BIGINT, "end" BIGINT, label VARCHAR)'
_EXT = ", ".join(f"'{x}'" for x in EXTENSIBLE)


@query(
    rf"""WITH RECURSIVE {D.with_spans(("ent", 1, 40), most=1)}, l AS (SELECT {K}, list({{'start': "start", 'end': "end", 'label': {_HINT}}}::{_SPAN} ORDER BY "start") AS s FROM ent GROUP BY {K}),
    st(doc_id, sent_id, pass, s, line) AS (SELECT l.doc_id, l.sent_id, 0, s, regexp_replace(text, '\s+', ' ', 'g') FROM l JOIN sentences USING ({K}) UNION ALL
      SELECT {K}, pass + 1, CASE WHEN c IS NULL THEN s ELSE list_transform(s, lambda x, k: CASE WHEN k = c.i THEN {{'start': c.low, 'end': c.high, 'label': x.label}}::{_SPAN} ELSE x END) END, line FROM (
        SELECT *, list_filter(flatten(list_transform(range(1, len(s) + 1), lambda i: list_transform(range(greatest(1, i - 11), least(len(s), i + 11) + 1), lambda j: CASE WHEN i <> j AND s[i].label IN ({_EXT}) AND s[j].label = '{NORP}' AND NOT (s[i]."start" <= s[j]."start" AND s[i]."end" >= s[j]."end")
          AND (s[i]."end" <= s[j]."start" OR s[j]."end" <= s[i]."start") AND greatest(s[i]."start", s[j]."start") - least(s[i]."end", s[j]."end") <= 2 AND regexp_full_match(substr(line, least(s[i]."end", s[j]."end") + 1, greatest(s[i]."start", s[j]."start") - least(s[i]."end", s[j]."end")), '\s*')
          AND len(list_filter(s[greatest(1, i - 24):i + 24], lambda x, k: k + greatest(1, i - 24) - 1 <> i AND k + greatest(1, i - 24) - 1 <> j AND x."start" < greatest(s[i]."end", s[j]."end") AND x."end" > least(s[i]."start", s[j]."start"))) = 0
          THEN {{'i': i, 'low': least(s[i]."start", s[j]."start"), 'high': greatest(s[i]."end", s[j]."end")}} END))), lambda x: x IS NOT NULL)[1] AS c FROM st WHERE pass < 10) WHERE c IS NOT NULL),
    last AS (SELECT {K}, arg_max(s, pass) AS s FROM st GROUP BY {K})
    SELECT {K}, x."start", x."end", x.label FROM (SELECT {K}, unnest(s) AS x FROM last)"""
)
def adjacent_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named spans that take in the group name beside them, until nothing changes.

    Spans here are single words, so the SQL looks at no more neighbours than there are steps.
    """
    hint = F.element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), F.col("coarse"))
    rows = D.spans(spark, sf_dir, 1, 40, 1).groupBy(*S.KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", hint.alias("label")))).alias("s"))
    lines = D.sentences(spark, sf_dir).select(*S.KEY, T.squeeze(F.col("text")).alias("line"))
    grown = O.extended_spans(lines.join(rows, S.KEY), "line", "s", EXTENSIBLE, NORP, APART)
    return grown.select(*S.KEY, F.explode("s").alias("x")).select(*S.KEY, "x.*")


FEED = "feed long, entry long, source string, lang string, text string"
LANGS = ("en", "fr")


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of feeds, one for each tenth of the sources."""
    feed = F.regexp_extract("source", r"(\d+)$", 1).cast("long") % 10
    return table(spark, sf_dir, "documents").select(feed.alias("feed"), F.col("doc_id").alias("entry"), "source", "lang", "text").where("feed IS NOT NULL")


def feed_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each feed, written one after another, that names the folder of its entries; these are written at once."""
    folder, whole = scratch(spark, "feeds"), scratch(spark, "entries")
    entries = feed_entries(spark, sf_dir)
    entries.withColumn("part", F.col("feed")).write.partitionBy("part").json(whole)
    for part in sorted(r[0] for r in entries.select("feed").distinct().collect()):  # ten at most
        spark.createDataFrame([(f"{whole}/part={part}",)], f"{feeds.PARTS} string").coalesce(1).write.mode("append").json(folder)
    return folder


_NEWS = r"""parts AS (SELECT feed, doc_id, source, lang, unnest(range(0, len(p))) AS pos, unnest(p) AS text FROM (SELECT *, regexp_extract(source, '(\d+)$', 1)::BIGINT % 10 AS feed, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE lang IN ('en', 'fr')))"""


@query(
    f"""WITH {_NEWS}, new AS (SELECT *, row_number() OVER (PARTITION BY source, lang, text ORDER BY feed, doc_id, pos) AS r FROM parts WHERE length(text) BETWEEN 40 AND 300), n AS (SELECT greatest(10, count(*) // 3) AS n FROM new WHERE r = 1)
    SELECT feed, entry, pos, source, lang, text FROM (SELECT feed, doc_id AS entry, pos, source, lang, text, row_number() OVER (ORDER BY feed, doc_id, pos) AS k FROM new WHERE r = 1), n WHERE k <= n"""
)
def feeds_until_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sentences of feeds, read as a stream until a third of all there are."""
    folder = feed_files(spark, sf_dir)
    wanted = feeds.sentences_of(feed_entries(spark, sf_dir), LANGS, 40, 300).select(*feeds.KEY).distinct()
    return feeds.collect_until(spark, folder, FEED, scratch(spark, "sentences"), scratch(spark, "stream"), max(10, wanted.count() // 3), LANGS, 40, 300)
