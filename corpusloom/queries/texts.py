"""Text functions over documents, pages and derived spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import derived as D
from ..functions import text as T
from ..operators import spans as S
from ..registry import query, table

ONE = D.with_spans(("ent", 1, 10))
SQUEEZED = r"sq AS (SELECT doc_id, sent_id, regexp_replace(text, '\s+', ' ', 'g') AS line FROM sentences)"
TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _pieces(spark: SparkSession, sf_dir: str, split) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(split(F.col("text"))).alias("pos", "sentence"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their squeezed sentence as `line`."""
    lines = D.sentences(spark, sf_dir).select(*S.KEY, T.squeeze(F.col("text")).alias("line"))
    return D.spans(spark, sf_dir, 1, 10).join(lines, S.KEY)


def _split_sql(expr: str, keep: str) -> str:
    return f"SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split({expr}, chr(1)), lambda x: {TRIM('x')}), lambda x: {keep}) AS s FROM documents)"


@query(_split_sql(r"""regexp_replace(text, '([.!?])\s+([A-ZÀ-ÝŒ0-9"«''])', '\1' || chr(1) || '\2', 'g')""", "length(x) BETWEEN 20 AND 500"))
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that a capital, digit or quote follows, within a length band."""
    return _pieces(spark, sf_dir, T.sentences)


@query(_split_sql(r"regexp_replace(regexp_replace(text, '(?m)^=+.*?=+\s*$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g')", "length(x) > 5 AND length(x) < 1000"))
def wiki_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, T.wiki_sentences)


@query(_split_sql(r"regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')", "x <> ''"))
def news_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, T.loose_sentences)


def _wiki_sql() -> str:
    out = "text"
    for pattern, by in T.WIKI_PASSES:
        quoted, to = pattern.replace("'", "''"), by.replace("$1", "\\1")
        to = "chr(10) || chr(10)" if "\n" in to else f"'{to}'"
        out = f"regexp_replace({out}, '{quoted}', {to}, 'g')"
    return out


WIKI_SQL = "'== ' || lang || ' ==' || chr(10) || '* [[' || source || '|' || substr(text, 1, 1) || ']] {{x|y}} ''''''' || text || ''''''' [http://a.b c d]' || chr(10) || '[[Category:' || source || ']]'"


@query(f"SELECT doc_id, {TRIM(_wiki_sql())} AS plain FROM (SELECT doc_id, {WIKI_SQL} AS text FROM documents)")
def wiki_markup_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in wiki markup, without it."""
    marked = F.concat(F.lit("== "), F.col("lang"), F.lit(" ==\n* [["), F.col("source"), F.lit("|"), F.substring("text", 1, 1), F.lit("]] {{x|y}} '''"), F.col("text"), F.lit("''' [http://a.b c d]\n[[Category:"), F.col("source"), F.lit("]]"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_wiki(marked).alias("plain"))


@query(rf"SELECT page_id, {TRIM(r'''regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')''')} AS plain FROM pages")
def html_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


#: Letters with marks of their own, and others that only decomposing finds.
COMPOSED = "é ǟ Ệ ć ő"


@query(f"SELECT doc_id, lower(strip_accents(text || '{COMPOSED}')) AS folded FROM documents")
def accents_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without accents, on whatever letters."""
    return _documents(spark, sf_dir).select("doc_id", T.fold_accents(F.concat("text", F.lit(COMPOSED))).alias("folded"))


@query(f"""SELECT doc_id, translate(nfc_normalize(text || '–x’{COMPOSED}'), '‐‑‒–—−' || chr(160) || chr(8239) || '’‘“”', '------  ' || chr(39) || chr(39) || '""') AS plain FROM documents""")
def signs_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed texts with dashes, hard spaces and curly quotes as plain ones."""
    return _documents(spark, sf_dir).select("doc_id", T.unify_signs(F.concat("text", F.lit(f"–x’{COMPOSED}"))).alias("plain"))


@query(rf"""SELECT doc_id, {TRIM(r"regexp_replace(regexp_replace(regexp_replace(translate('<b>' || text || '</b> [ORG] l’été fin 1 A 1' || chr(8260) || '2', '’‘`´', ''''''''''), '<[^>]+>', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')")} AS plain FROM documents""")
def signs_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated text in compatible forms, without tags and bracketed labels."""
    return _documents(spark, sf_dir).select("doc_id", T.clean_signs(F.concat(F.lit("<b>"), "text", F.lit("</b> [ORG] l’été ﬁn ① Ａ ½"))).alias("plain"))


LEAD = "|".join(T.LEADING_WORDS)


@query(
    rf"""WITH {ONE}, a AS (SELECT *, regexp_replace(text, '^[\s,;:.!?()"«»]+', '') AS one FROM ent), b AS (SELECT *, regexp_replace(one, '(?i)^(?:{LEAD})\s+|^(?:l|d)''', '') AS two FROM a), c AS (SELECT *, regexp_replace(two, '[\s,;:.!?()"«»]+$', '') AS bare, "start" + length(text) - length(two) AS s FROM b)
    SELECT doc_id, sent_id, tok, n, s AS "start", s + length(bare) AS "end", bare FROM c"""
)
def spans_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans without outer signs and one leading article."""
    found = D.spans(spark, sf_dir, 1, 10).withColumn("c", T.sanitize_span(F.col("text"), F.col("start")))
    return found.select(*S.KEY, "tok", "n", "c.start", "c.end", F.col("c.text").alias("bare"))


@query(
    rf"""WITH {ONE}, {SQUEEZED}, w AS (SELECT e.doc_id, e.sent_id, tok, n, greatest("start" - 1, 0) AS s, least("end" + 1, length(line)) AS e, line FROM ent e JOIN sq USING (doc_id, sent_id)), o AS (SELECT *, substr(line, s + 1, e - s) AS own FROM w)
    SELECT doc_id, sent_id, tok, n, s + length(own) - length(ltrim(own)) AS "start", s + length(own) - length(ltrim(own)) + length(trim(own)) AS "end" FROM o"""
)
def spans_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans a sign too wide on both sides, cut back to what isn't white space."""
    wide = _lines(spark, sf_dir).withColumns({"s": F.greatest(F.col("start") - 1, F.lit(0)), "e": F.least(F.col("end") + 1, F.length("line"))})
    return wide.withColumn("c", T.clean_span(F.col("line"), F.col("s"), F.col("e"))).select(*S.KEY, "tok", "n", "c.start", "c.end")


@query(
    rf"""WITH {ONE}, {SQUEEZED} SELECT e.doc_id, e.sent_id, tok, n, k, NOT regexp_matches(CASE WHEN "start" + k > 0 THEN substr(line, "start" + k, 1) ELSE '' END, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substr(line, "end" + 1, 1), '[\p{{L}}\p{{N}}]') AS whole
    FROM ent e JOIN sq USING (doc_id, sent_id), (SELECT unnest([0, 1]) AS k)"""
)
def spans_on_word_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether spans, and spans that begin one sign later, are bounded by words."""
    rows = _lines(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(*S.KEY, "tok", "n", "k", T.on_word_bounds(F.col("line"), F.col("start") + F.col("k"), F.col("end")).alias("whole"))


RAW_LABEL = "CASE (tok + n) % 4 WHEN 0 THEN '[Verb_' || fine || ']' WHEN 1 THEN 'verb-' || text WHEN 2 THEN ' ' || coarse || ' ' ELSE lower(fine) END"


@query(rf"WITH {ONE} SELECT doc_id, sent_id, tok, n, lower(regexp_replace(regexp_replace(regexp_replace({TRIM(RAW_LABEL)}, '^[\[\]]+|[\[\]]+$', '', 'g'), '(?i)^verb[_\-\s]*', ''), '[^a-zA-Z0-9]+', '', 'g')) AS label FROM ent")
def labels_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 1, 10).select(*S.KEY, "tok", "n", T.canonical_label(F.expr(RAW_LABEL)).alias("label"))


@query(
    rf"""WITH {ONE}, {SQUEEZED}, w AS (SELECT e.*, line, greatest("start" + (tok * 37 + n) % 181 - 90, 0) AS s FROM ent e JOIN sq USING (doc_id, sent_id)), v AS (SELECT *, greatest(s - 60, 0) AS lo, least(length(line), s + length(text) + 60) AS hi FROM w),
    f AS (SELECT *, instr(substr(line, lo + 1, greatest(hi - lo, 0)), text) AS near, instr(line, text) AS anywhere FROM v) SELECT doc_id, sent_id, tok, n, CASE WHEN near > 0 THEN lo + near - 1 WHEN anywhere > 0 THEN anywhere - 1 END AS found FROM f"""
)
def offsets_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated offsets up to 90 signs off, found again within 60 or anywhere."""
    stated = F.greatest(F.col("start") + F.expr("(tok * 37 + n) % 181 - 90"), F.lit(0))
    return _lines(spark, sf_dir).select(*S.KEY, "tok", "n", T.repair_offset(F.col("line"), F.col("text"), stated).cast("long").alias("found"))


@query(
    rf"""WITH {ONE}, {SQUEEZED}, w AS (SELECT e.doc_id, e.sent_id, tok, n, line, CASE tok % 4 WHEN 1 THEN text || ' ' WHEN 2 THEN text || '~' ELSE text END AS own, CASE WHEN tok % 5 = 1 THEN -1 ELSE "start" + (tok % 3 = 2)::INT END AS s, "end" AS e FROM ent e JOIN sq USING (doc_id, sent_id)),
    g AS (SELECT *, s >= 0 AND s < e AND e <= length(line) AS good, instr(line, own) - 1 AS own_at, {TRIM("own")} AS bare FROM w), h AS (SELECT *, good AND substr(line, s + 1, e - s) = own AS same, instr(line, bare) - 1 AS bare_at FROM g)
    SELECT doc_id, sent_id, tok, n, (CASE WHEN same THEN s WHEN own_at >= 0 THEN own_at WHEN good AND bare_at >= 0 THEN bare_at END)::BIGINT AS "start", (CASE WHEN same THEN e WHEN own_at >= 0 THEN own_at + length(own) WHEN good AND bare_at >= 0 THEN bare_at + length(bare) END)::BIGINT AS "end" FROM h"""
)
def offsets_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with wrong bounds or texts, put right or dropped (null)."""
    own = F.expr("CASE tok % 4 WHEN 1 THEN text || ' ' WHEN 2 THEN text || '~' ELSE text END")
    start = F.expr("CASE WHEN tok % 5 = 1 THEN -1L ELSE start + int(tok % 3 = 2) END")
    rows = _lines(spark, sf_dir).withColumn("v", T.verified_offset(F.col("line"), own, start, F.col("end")))
    return rows.select(*S.KEY, "tok", "n", "v.start", "v.end")


STATED = "CASE tok % 3 WHEN 0 THEN text WHEN 1 THEN lower(text) || ' ' ELSE text || '!' END"


@query(rf"WITH {ONE} SELECT doc_id, sent_id, tok, n, CASE WHEN s = text THEN 'exact' WHEN lower(regexp_replace({TRIM('s')}, '\s+', ' ', 'g')) = lower(regexp_replace({TRIM('text')}, '\s+', ' ', 'g')) THEN 'soft' ELSE 'hard' END AS class FROM (SELECT *, {STATED} AS s FROM ent)")
def text_match_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 1, 10).select(*S.KEY, "tok", "n", T.match_class(F.expr(STATED), F.col("text")).alias("class"))


MARKED = [m + d for k, ms in enumerate((T.PURPOSE_MARKERS, T.MEMBER_MARKERS, T.OWNER_MARKERS)) for m in ms[::4] for d in ("", "la ", "x ")]
PREFIX = "substr(line, 1, least(\"start\", 60)) || ' ' || ({})[(doc_id * 31 + sent_id * 7 + tok) % {} + 1]".format("[" + ", ".join("'" + m.replace("'", "''") + "'" for m in MARKED) + "]", len(MARKED))


def _marker_sql() -> str:
    ends = lambda m: "regexp_matches(tail, '" + T.marker_pattern(m).replace("'", "''") + "')"
    return f"CASE WHEN {ends(T.MEMBER_MARKERS)} THEN 'MEMBER_OF' WHEN {ends(T.OWNER_MARKERS)} THEN 'OWNER' WHEN {ends(T.PURPOSE_MARKERS)} THEN 'PURPOSE' END"


@query(f"WITH {ONE}, {SQUEEZED}, p AS (SELECT e.doc_id, e.sent_id, tok, n, lower(right({PREFIX}, 40)) AS tail FROM ent e JOIN sq USING (doc_id, sent_id)) SELECT doc_id, sent_id, tok, n, {_marker_sql()} AS relation FROM p")
def case_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation that a case marker right before a span expresses."""
    marker = F.element_at(F.array(*[F.lit(m) for m in MARKED]), F.expr(f"int((doc_id * 31 + sent_id * 7 + tok) % {len(MARKED)}) + 1"))
    prefix = F.concat(F.substring(F.col("line"), F.lit(1), F.least(F.col("start"), F.lit(60)).cast("int")), F.lit(" "), marker)
    return _lines(spark, sf_dir).select(*S.KEY, "tok", "n", T.marker_relation(prefix).alias("relation"))


POSSESSIVE = "|".join(T.POSSESSIVES)
OWNED = "CASE (doc_id + tok) % 3 WHEN 0 THEN 'dans leurs ' WHEN 1 THEN 'avec sa' ELSE 'the old ' END"


@query(rf"WITH {ONE} SELECT doc_id, sent_id, tok, n, regexp_matches(lower(right({OWNED}, 8)), '(?:^|\s)(?:{POSSESSIVE})\s+$') AS owned FROM ent")
def possessive_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spans(spark, sf_dir, 1, 10).select(*S.KEY, "tok", "n", T.after_possessive(F.expr(OWNED)).alias("owned"))


@query(
    rf"""WITH {ONE}, {SQUEEZED}, o AS (SELECT *, max("end") OVER (PARTITION BY doc_id, sent_id ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ent), k AS (SELECT * FROM o WHERE reach IS NULL OR "start" >= reach),
    b AS (SELECT doc_id, sent_id, "start", "end", coarse, coalesce(lag("end") OVER w, 0) AS before FROM k WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY "start")),
    j AS (SELECT doc_id, sent_id, string_agg(substr(line, before + 1, "start" - before) || '[' || substr(line, "start" + 1, "end" - "start") || '](' || coarse || ')', '' ORDER BY "start") || substr(any_value(line), max("end") + 1) AS rendered FROM b JOIN sq USING (doc_id, sent_id) GROUP BY doc_id, sent_id)
    SELECT doc_id, sent_id, rendered FROM j"""
)
def annotations_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with the spans that overlap none before them in brackets."""
    from pyspark.sql import Window

    reach = F.max("end").over(Window.partitionBy(*S.KEY).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    free = _lines(spark, sf_dir).withColumn("reach", reach).where("reach is null or start >= reach")
    grouped = free.groupBy(*S.KEY, "line").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("coarse").alias("label")))).alias("s"))
    return grouped.select(*S.KEY, T.bracketed(F.col("line"), F.col("s")).alias("rendered"))


REPLY = """'Here: ' || '["' || lang || '", " ' || upper(lang) || '", "' || source || '", "' || lang || source || '"]' || ' done'"""


@query(f"SELECT doc_id, [lang, source, lang || source] AS items FROM documents WHERE lang <> source")
def json_array_from_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of the JSON array inside a reply, without blank ones and repeats."""
    docs = table(spark, sf_dir, "documents").where("lang <> source")
    return docs.select("doc_id", T.json_strings(F.expr(REPLY)).alias("items"))


@query("SELECT doc_id, json_extract_string(r, '$.choices[0].message.content') AS content FROM (SELECT doc_id, to_json({'choices': [{'message': {'role': 'a', 'content': substr(text, 1, 200)}}]}) AS r FROM documents)")
def json_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content inside nested replies."""
    content = F.struct(F.lit("a").alias("role"), F.substring("text", 1, 200).alias("content")).alias("message")
    reply = F.to_json(F.struct(F.array(F.struct(content)).alias("choices")))
    return _documents(spark, sf_dir).select("doc_id", F.get_json_object(reply, "$.choices[0].message.content").alias("content"))


@query("SELECT doc_id, lang AS number, source AS gender, n_chars::VARCHAR AS person FROM documents")
def features_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`k=v|k=v` features as columns."""
    feats = T.feature_map(F.concat(F.lit("Number="), "lang", F.lit("|Gender="), "source", F.lit("|Person="), F.col("n_chars").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", *[feats[k].alias(k.lower()) for k in ("Number", "Gender", "Person")])


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'it is about ' || source WHEN 'fr' THEN 'il parle de ' || source ELSE 'it is about ' || source END AS hypothesis FROM documents")
def hypothesis_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hypothesis in the document's language, else in English."""
    texts = F.create_map(F.lit("en"), F.concat(F.lit("it is about "), "source"), F.lit("fr"), F.concat(F.lit("il parle de "), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(texts[F.col("lang")], texts["en"]).alias("hypothesis"))
