"""Corpus queries: dedup, contamination, splits, rarity, profiles. lang and source stand in for labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..registry import query, table

NORM = r"lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
UNIT = "(('0x' || left(md5('{seed}' || doc_id), 8))::BIGINT / 4294967296.0::DOUBLE)"
LINES = r"lines AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"SELECT doc_id, md5({NORM}) AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORM}")
def dedup_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_normalized(_docs(spark, sf_dir).select("doc_id", "text"), [F.col("doc_id")]).select("doc_id")


@query(r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(text, '^\s+|\s+$', '', 'g')")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_exact(_docs(spark, sf_dir).select("doc_id", "text"), [F.col("doc_id")]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, lang, text")
def dedup_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_content(_docs(spark, sf_dir), ["source", "lang", "text"], [F.col("doc_id")]).select("doc_id", "source")


@query(f"SELECT doc_id, pos FROM (WITH {LINES} SELECT * FROM lines) l WHERE length(line) > 20 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(text, chr(10))) AS b FROM benchmark) WHERE lower(b) = lower(line))")
def lines_not_in_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join of lines against another corpus."""
    lines = _lines(spark, sf_dir).where("length(line) > 20")
    other = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    return C.not_in(lines, other, F.lower("line")).select("doc_id", "pos")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 3)")
def held_out_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text no held-out row has."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return C.not_in(docs, docs.where("doc_id % 10 = 3"), F.col("text")).select("doc_id")


@query("WITH a AS (SELECT doc_id, 0 AS r FROM documents UNION ALL SELECT doc_id, 1 FROM labels UNION ALL SELECT item_id * 3, 2 FROM benchmark) SELECT doc_id, min(r) AS source_rank FROM a GROUP BY doc_id")
def pool_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union in priority order, one row an id."""
    parts = [_docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))]
    return C.pool([p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)], "doc_id")


@query(f"SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {UNIT.format(seed=42)} AS u FROM documents)")
def split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split(_docs(spark, sf_dir).select("doc_id"), 42, (0.8, 0.1, 0.1), ("train", "val", "test"), "doc_id")


@query(f"SELECT doc_id, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.9 + 0.05 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {UNIT.format(seed=5)} AS u FROM documents WHERE lang <> 'en')")
def append_90_5_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _docs(spark, sf_dir).where("lang <> 'en'").select("doc_id")
    return C.split(new, 5, (0.9, 0.05, 0.05), ("train", "val", "test"), "doc_id")


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('7' || doc_id)) <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.15)) THEN 'val' ELSE 'train' END AS split FROM documents")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang"), 7, 0.15, "lang", "doc_id")


@query(
    "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('9' || doc_id)) AS n FROM labels), m AS (SELECT count(*) AS m FROM labels WHERE quality = 0) SELECT doc_id, quality FROM r, m WHERE quality = 0 OR n <= 3 * m"
)
def downsample_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three rows of the other class for each positive one."""
    return C.downsample(table(spark, sf_dir, "labels").select("doc_id", "quality"), F.col("quality") == 0, 3, 9, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('3' || doc_id) LIMIT 25")
def sample_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id").orderBy(C.hash_key(3, "doc_id")).limit(25)


SPLIT3 = f"SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {UNIT.format(seed=42)} AS u FROM documents)"


@query(
    f"""WITH c AS (SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM ({SPLIT3}) GROUP BY source)
    SELECT *, NOT (val / total BETWEEN 0.07 AND 0.13) OR NOT (test / total BETWEEN 0.07 AND 0.13) AS imbalanced FROM c"""
)
def audit_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["train", "val", "test"]
    return C.label_counts(C.split(_docs(spark, sf_dir), 42, (0.8, 0.1, 0.1), tuple(names), "doc_id"), "source", "split", names)


@query("SELECT lang, count(*) AS n, CASE WHEN count(*) < 200 THEN 'weak' WHEN count(*) < 500 THEN 'low' ELSE 'ok' END AS flag FROM documents GROUP BY lang")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.weak_labels(_docs(spark, sf_dir), "lang")


@query(
    """WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY source)
    SELECT count(*) AS docs, count(*) FILTER (lang = 'en') AS english, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS longest, count(DISTINCT source) AS sources, (SELECT round(max(c) / min(c), 6) FROM n) AS imbalance FROM documents"""
)
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage counts, means and imbalance: one pass of sums, and one small one over counts by source."""
    by_source = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("c"), F.count_if(F.col("lang") == "en").alias("e"), F.sum("n_chars").alias("s"), F.max("n_chars").alias("m"))
    return by_source.agg(F.sum("c").alias("docs"), F.sum("e").alias("english"), F.round(F.sum("s") / F.sum("c"), 6).alias("mean_chars"), F.max("m").alias("longest"), F.count("*").alias("sources"), F.round(F.max("c") / F.min("c"), 6).alias("imbalance"))


@query(f"SELECT coalesce(split, 'all') AS split, coalesce(lang, 'all') AS lang, count(*) AS n FROM ({SPLIT3}) GROUP BY ROLLUP (split, lang)")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C.split(_docs(spark, sf_dir), 42, (0.8, 0.1, 0.1), ("train", "val", "test"), "doc_id")
    return parts.rollup("split", "lang").agg(F.count("*").alias("n")).select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("lang", F.lit("all")).alias("lang"), "n")


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS r FROM lines WHERE length(line) BETWEEN 10 AND 80) SELECT line, count(*) AS n, string_agg(doc_id::VARCHAR, ' / ' ORDER BY r) FILTER (r <= 2) AS contexts FROM r GROUP BY line HAVING count(*) > 1")
def distinct_with_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines with their first two places."""
    lines = _lines(spark, sf_dir).where(F.length("line").between(10, 80))
    return C.first_contexts(lines, ["line"], [F.col("doc_id"), F.col("pos")], F.col("doc_id").cast("string")).where("n > 1")


TAGS = "tags AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) = 2)) AS t FROM documents)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), lambda w: F.length(w) == 2)
    return _docs(spark, sf_dir).select("doc_id", F.array_distinct(tags).alias("tags"))


@query(f"WITH {TAGS} SELECT label, count(*) AS df FROM (SELECT unnest(t) AS label FROM tags) GROUP BY label")
def presence_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.presence(_tagged(spark, sf_dir), "doc_id", "tags")


@query(f"WITH {TAGS}, n AS (SELECT count(*) AS n FROM documents) SELECT label, round(count(*) * 1000.0 / n, 6) AS per_thousand FROM (SELECT unnest(t) AS label FROM tags), n GROUP BY label, n")
def frequency_per_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _tagged(spark, sf_dir)
    total = tagged.agg(F.count("*").alias("total"))
    return C.presence(tagged, "doc_id", "tags").join(F.broadcast(total)).select("label", F.round(F.col("df") * 1000.0 / F.col("total"), 6).alias("per_thousand"))


RARITY = f"{TAGS}, f AS (SELECT label, count(*) AS df FROM (SELECT unnest(t) AS label FROM tags) GROUP BY label), s AS (SELECT doc_id, coalesce(sum((SELECT count(*) FROM documents) / (df * 1000.0)), 0) AS score FROM (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS label FROM tags) LEFT JOIN f USING (label) GROUP BY doc_id)"


@query(f"WITH {RARITY} SELECT doc_id, round(score, 6) AS score FROM s")
def rarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rarity(_tagged(spark, sf_dir), "doc_id", "tags").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {RARITY} SELECT doc_id FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 100")
def rarest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest rows, as a report of a fixed length."""
    return C.rarity(_tagged(spark, sf_dir), "doc_id", "tags").orderBy(F.round("score", 6).desc(), "doc_id").limit(100).select("doc_id")


@query(
    """WITH l AS (SELECT list({'kept': [doc_id], 'seen': list_distinct([lang, source])} ORDER BY doc_id) AS s FROM documents)
    SELECT unnest(list_reduce(s, lambda a, x: CASE WHEN len(list_filter(x.seen, lambda y: len(list_filter(a.seen, lambda z: z = y)) < 40)) > 0 THEN {'kept': list_concat(a.kept, x.kept), 'seen': list_concat(a.seen, x.seen)} ELSE a END, {'kept': []::BIGINT[], 'seen': []::VARCHAR[]}).kept) AS doc_id FROM l"""
)
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept while one of their labels is below its quota, in order of id."""
    rows = _docs(spark, sf_dir).select("doc_id", F.array("lang", "source").alias("labels"))
    return C.quota_fill(rows, "labels", "doc_id", 40).select("doc_id")


@query(
    "WITH s AS (SELECT doc_id AS id, n_chars % 7 AS \"start\", n_chars % 7 + 3 AS \"end\", lang AS label, 0 AS source FROM documents UNION ALL SELECT doc_id, n_chars % 5, n_chars % 5 + 3, lang, 1 FROM documents) SELECT id, \"start\", \"end\", label, min(source) AS source FROM s GROUP BY ALL"
)
def merge_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two sources by id; the first source's win."""
    docs = _docs(spark, sf_dir)
    parts = [docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") % m).alias("start"), (F.col("n_chars") % m + 3).alias("end"), F.col("lang").alias("label")) for m in (7, 5)]
    return C.merge_spans(parts)


@query(
    """WITH v AS (SELECT source, n_chars % 5 AS bucket, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY n DESC, lang) AS r, count(*) OVER (PARTITION BY source, bucket) AS kinds FROM v)
    SELECT source, bucket, lang, n FROM r WHERE r = 1 AND NOT (n = 1 AND kinds > 1)"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.majority(_docs(spark, sf_dir).select("source", (F.col("n_chars") % 5).alias("bucket"), "lang"), ["source", "bucket"], "lang")


@query("SELECT text_hash, n, langs FROM (SELECT md5(text) AS text_hash, count(*) AS n, count(DISTINCT source) AS langs FROM documents GROUP BY text) WHERE langs > 1")
def contradiction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts that carry different labels."""
    keyed = _docs(spark, sf_dir).select(F.md5("text").alias("text_hash"), "source")
    return keyed.groupBy("text_hash", "source").agg(F.count("*").alias("c")).groupBy("text_hash").agg(F.sum("c").alias("n"), F.count("*").alias("langs")).where("langs > 1")


@query("SELECT a.lang AS src, b.lang AS dst, count(*) AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 GROUP BY ALL")
def change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of label changes between one version of a row and the next."""
    docs = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("src"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("src").alias("dst"))
    return docs.join(after, "doc_id").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that stand in two tables, or twice in one."""
    both = _docs(spark, sf_dir).select("doc_id").unionAll(table(spark, sf_dir, "labels").select("doc_id"))
    return both.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"""WITH m AS (SELECT doc_id, 0 AS source, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, text FROM documents WHERE doc_id % 2 = 1), k AS (SELECT *, row_number() OVER (PARTITION BY {NORM} ORDER BY source, doc_id) AS r FROM m)
    SELECT source, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 40 THEN 'short' WHEN r > 1 THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM k GROUP BY ALL"""
)
def merge_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources merged by priority, with the reason why each row stays or goes, counted."""
    from pyspark.sql import Window

    rows = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("source"), "text")
    order = Window.partitionBy(F.sha2(T.normalize(F.col("text")), 256)).orderBy("source", "doc_id")
    marked = rows.withColumn("r", F.row_number().over(order))
    reason = F.when(F.trim("text") == "", "empty").when(F.length("text") < 40, "short").when(F.col("r") > 1, "duplicate").otherwise("kept")
    return marked.groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))
